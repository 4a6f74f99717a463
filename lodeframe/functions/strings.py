"""String similarity and grouping of linked values; small helpers for value lists of bounded length."""

from __future__ import annotations


def jaro(a: str, b: str) -> float:
    """Share of characters that match within reach, less half for those out of order."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = [True] * len(b)
    picked: list[str] = []
    for i, letter in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == letter:
                free[j] = False
                picked.append(letter)
                break
    m = len(picked)
    if not m:
        return 0.0
    other = [b[j] for j in range(len(b)) if not free[j]]
    swaps = sum(x != y for x, y in zip(picked, other)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity raised for a common start of up to four characters, when it is above .7 already."""
    score = jaro(a, b)
    if score <= 0.7:
        return score
    start = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        start += 1
    return score + 0.1 * start * (1 - score)


def clusters_of(edges: list[tuple[str, str]]) -> dict[str, str]:
    """Every linked value with the smallest value of its group."""
    parent: dict[str, str] = {}

    def root(v: str) -> str:
        parent.setdefault(v, v)
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {v: root(v) for v in parent}
