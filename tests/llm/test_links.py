import numpy as np
import pytest

from lodeframe.llm import link_trust as l
from lodeframe.llm.queries import RULES

PAGES = [
    (1, "https://A.com/en/x?q#f", '<a href="http://good.org/1">g</a> <a href="/own">o</a>'), (2, "http://good.org/", '<a href=//other.org/z>x</a><a HREF=\'http://good.org/\'>self</a>'), (3, "http://bad.net/es/1", None),
    (4, "http://friend.org", '<a class="y" href="https://BAD.net/fr/">b</a>'), (5, "http://bad.net/en/1", ""), (6, "http://www.example.com/en/a", ""), (7, "http://x.example.com/en/a", ""), (8, "http://example.com/de/", ""), (9, None, "<a href='http://bad.net/'>"),
    (10, "no scheme", ""), (11, "http://lonely.org/#x", ""), (2, "http://good.org/", ""), (12, "x://h://j/k", ""), (13, "http://notexample.com", ""), (None, "http://a.com/", ""),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "h", "t") for p in PAGES], "page_id long, url string, html string, host string, trust string")


def test_rules_hosts_and_verdicts(pages):
    rows = l.judge(pages, RULES).collect()
    assert len(rows) == len(PAGES)
    found = {r.page_id: r for r in rows}
    assert (found[1].host, found[1].path, found[1].rule) == ("a.com", "/en/x", "com/")
    assert (found[9].host, found[9].path, found[10].host, found[12].host, found[12].path) == ("", "", "", "h:", "//j/k")
    assert {i: found[i].rule for i in (3, 5, 6, 7, 8, 13)} == {3: "net/es/", 5: None, 6: "www.example.com/en/", 7: "example.com/en/", 8: "com/", 13: None}
    assert {i: r.verdict for i, r in found.items() if i in (1, 2, 3, 4, 5, 6, 7, 9, 11)} == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "block", 9: "allow", 11: "allow"}


def test_ranks_equal_power_iteration(spark):
    rng = np.random.default_rng(1)
    hosts = [f"h{i}" for i in range(12)]
    weight = rng.integers(0, 4, (12, 12)) * (rng.random((12, 12)) < 0.3)
    np.fill_diagonal(weight, 0)
    weight[3] = 0
    allowed, blocked = rng.integers(0, 3, 12), rng.integers(0, 3, 12)
    edges = spark.createDataFrame([(hosts[i], hosts[j], int(weight[i, j])) for i in range(12) for j in range(12) if weight[i, j]], "source string, target string, n long")
    seeds = spark.createDataFrame([(h, int(a), int(b)) for h, a, b in zip(hosts, allowed, blocked)], "host string, allowed long, blocked long")
    found = {r.host: r for r in l.spread_trust(seeds, edges, tolerance=1e-9).collect()}
    for name, seed, w in (("trust", allowed, weight), ("distrust", blocked, weight.T)):
        s = seed / seed.sum()
        step = w / np.maximum(w.sum(axis=1, keepdims=True), 1)
        r = s.copy()
        for _ in range(400):
            lost = r[w.sum(axis=1) == 0].sum()
            r = (1 - l.DAMPING) * s + l.DAMPING * (r @ step + lost * s)
        for i, h in enumerate(hosts):
            assert (found[h][name] if h in found else 0.0) == pytest.approx(r[i], abs=1e-6)


def test_empty_pages(spark):
    assert l.judge(spark.createDataFrame([], "page_id long, url string, html string"), RULES).count() == 0


def test_trust_reaches_the_end_of_a_long_chain(spark):
    """Seventy links and a ring at the end, so that nothing leaks away."""
    edges = [(f"h{i}", f"h{i + 1}", 1) for i in range(70)] + [("h70", "h69", 1)]
    found = l.spread_trust(spark.createDataFrame([("h0", 1, 0)], "host string, allowed long, blocked long"), spark.createDataFrame(edges, "source string, target string, n long"))
    got = {r.host: r.trust for r in found.collect()}
    assert got["h68"] > 0 and abs(got["h68"] - 0.15 * 0.85**68) < 1e-6
