"""URL filter by rules and by trust that spreads over links between hosts, in DataFrame functions only.

Rules (host, path, verdict) decide the urls that they fit; the longest that fits wins. For all others the host decides. Hosts start with
trust in proportion to their allowed pages and distrust in proportion to their blocked ones. Trust flows along links, as personalised
PageRank from the trusted seeds; distrust flows against them, from a blocked host to those that link to it. A host is blocked where distrust
makes up more than `THRESHOLD` of both; a host that neither reaches is allowed.

Links are counted by (host, host) before they are shuffled on, so a host with a third of all pages is a few rows in the graph; links inside
a host and relative ones don't count. Mass that ends at hosts without links would return to the seeds; that only scales the ranks, which are
normalised in the end. Null urls, and those without `://`, have an empty host and path, which no rule fits, no trust reaches, and so are
allowed. Repeated rows count as pages of their own. Null pages have no links.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.session import cut

DAMPING, THRESHOLD, TOLERANCE = 0.85, 0.5, 1e-6
LINK = r"""(?i)\shref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null; a rule is written host/path."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(f"/{rest}"))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def links(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """source, target, n: links from pages of one host to another host."""
    found = df.select(host_of(F.col(f"`{url}`")).alias("source"), F.explode(F.regexp_extract_all(F.col(f"`{html}`").cast("string"), F.lit(LINK), F.lit(1))).alias("target"))
    found = found.withColumn("target", F.translate("target", UPPER, LOWER)).where("source <> '' and source <> target")
    return found.groupBy("source", "target").agg(F.count("*").alias("n"))


def spread_trust(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust from seeds (host, allowed, blocked) and edges (source, target, n); each kind sums to 1 or, unseeded, to 0.

    Rounds go on until the ranks of both kinds change by less than the tolerance in all. Round k changes them by 2 (1 - damping) damping^k
    at most, as no host hands on more than it has, so the number of rounds follows from damping and tolerance; more would be a fault.
    """
    rounds = 2 + math.ceil(math.log(tolerance / (2 * (1 - damping))) / math.log(damping))
    out = edges.groupBy("source").agg(F.sum("n").alias("all"))
    into = edges.groupBy("target").agg(F.sum("n").alias("all"))
    along = edges.join(out, "source").select(F.lit("trust").alias("kind"), F.col("source").alias("from"), F.col("target").alias("to"), (F.col("n") / F.col("all")).alias("share"))
    against = edges.join(into, "target").select(F.lit("distrust").alias("kind"), F.col("target").alias("from"), F.col("source").alias("to"), (F.col("n") / F.col("all")).alias("share"))
    flow = cut(along.union(against))
    total = seeds.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()
    start = seeds.select(F.lit("trust").alias("kind"), "host", (F.col("allowed") / F.lit(float(total.a or 1))).alias("seed")).union(seeds.select(F.lit("distrust"), "host", F.col("blocked") / F.lit(float(total.b or 1)))).where("seed > 0")
    start = cut(start.withColumn("seed", F.col("seed") * (1 - damping)))
    ranks = start.select("kind", "host", F.col("seed").alias("rank"))
    for _ in range(rounds):
        moved = flow.join(ranks, (flow["kind"] == ranks["kind"]) & (flow["from"] == ranks["host"])).select(flow["kind"], F.col("to").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
        old = ranks.select("kind", "host", F.lit(0.0).alias("rank"), (-F.col("rank")).alias("change"))
        new = start.select("kind", "host", F.col("seed").alias("rank")).union(moved)
        both = new.select("kind", "host", "rank", F.col("rank").alias("change")).union(old)
        written = cut(both.groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("change").alias("change")))
        change = written.agg(F.sum(F.abs("change"))).first()[0] or 0.0
        ranks = written.select("kind", "host", "rank")
        if change < tolerance:
            break
    else:
        raise RuntimeError(f"ranks still change by {change} after {rounds} rounds")
    sums = {r.kind: r.s for r in ranks.groupBy("kind").agg(F.sum("rank").alias("s")).collect()}
    share = lambda k: F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0)) / F.lit(sums.get(k) or 1.0)
    return ranks.groupBy("host").agg(share("trust").alias("trust"), share("distrust").alias("distrust"))


def judge(df: DataFrame, rules: dict[str, str], url: str = "url", html: str = "html", id_col: str = "page_id", threshold: float = THRESHOLD) -> DataFrame:
    """id, host, path, rule, verdict, trust and distrust of the host for every row; `rules` maps host/path to allow or block."""
    place = df.select(F.col(f"`{id_col}`").alias("id"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    ruled = place.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    decided = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        decided = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(decided)
    ruled = ruled.withColumn("decided", decided)
    count = lambda v: F.sum((F.col("decided") == v).cast("long"))
    seeds = ruled.where("decided is not null").groupBy("host").agg(count("allow").alias("allowed"), count("block").alias("blocked"))
    ranks = spread_trust(seeds, cut(links(df, url, html)))
    out = ruled.join(ranks, "host", "left").na.fill(0.0, ["trust", "distrust"])
    own = F.when(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("decided", own).alias("verdict"), "trust", "distrust")
