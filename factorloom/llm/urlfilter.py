"""URL filters: host and path rules, and for other pages trust and distrust propagated over the host graph.

Links in the pages give edges between hosts. Trust is a personalised PageRank that starts from the hosts with pages that
a rule allows and follows links; distrust starts from the hosts with pages that a rule blocks and follows links backwards,
because who links to a bad host is suspect. Both are scaled to the pages that started them, so that they compare. A host
is blocked where its distrust exceeds ``RATIO`` times its trust by more than ``FLOOR`` of the mean rank of a host. A page's
own rule decides before its host.

Ranks are iterated until all that is still on its way is under a tenth of that floor, so no verdict depends on a number of
steps: their count follows from the damping and the logarithm of the number of hosts (130 for a million hosts).

Edges are counted for each pair of hosts before anything else happens, and ranks are summed map-side, so a host that
holds a third of all pages is one node. Hosts alone, not pages, take part in the iterations; each one is a stored table.

Nulls: a null url or one without ``://`` has an empty host and path, fits no rule and is allowed; a null html has no links.
Repeated rows count their links once for each row and get equal verdicts. Empty tables give empty tables. Other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

DAMPING = 0.85
RATIO = 2.0
FLOOR = 1e-3


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


# The rules.
RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, both null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        name = F.when(r.fits(host, path), F.lit(r.name)).otherwise(name)
        verdict = F.when(r.fits(host, path), F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links): links from one host to another, counted."""
    targets = F.regexp_extract_all("html", F.lit("(?i)\\bhref\\s*=\\s*[\"']?((?:https?:)?//[^\"'\\s>]+)"), F.lit(1))
    # The host is cut out before the links are spread, so that no link carries its page's url along.
    linking = pages.where(F.col("html").rlike("(?i)href\\s*=\\s*[\"']?(https?:)?//")).select(host_of(F.col("url")).alias("src"), targets.alias("targets"))
    found = linking.select("src", F.explode("targets").alias("to"))
    whole = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to"))
    return found.select("src", host_of(whole).alias("dst")).where("src != dst and src != '' and dst != ''").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = 1e-6, damping: float = DAMPING) -> DataFrame:
    """(host, rank): personalised PageRank from ``seeds`` (host, weight, summing to 1) along ``edges`` (src, dst, links).

    What would leave from a host without links goes back to the seeds; ranks sum to 1. Their total error is at most
    ``tolerance``.
    """
    out = edges.groupBy("src").agg(F.sum("links").alias("total"))
    share = stored(edges.join(out, "src").select("src", "dst", (F.col("links") / F.col("total")).alias("share")), "url-shares")
    start = seeds.select("host", F.col("weight").alias("rank"))
    ranks = stored(start, "url-ranks")
    if share.isEmpty():
        return ranks
    # Without the returns, the visits x = seeds + damping * x along the edges only grow, by less each time; what is to
    # come is bounded by the last growth. The returns multiply all of them alike, so they are settled by the division.
    total = ranks.agg(F.sum("rank")).first()[0] or 0.0
    growth = total
    while growth * damping / (1 - damping) > tolerance * total:
        moved = ranks.join(share, ranks["host"] == share["src"]).select(F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
        ranks = stored(moved.unionByName(start).groupBy("host").agg(F.sum("rank").alias("rank")), "url-ranks")
        before, total = total, ranks.agg(F.sum("rank")).first()[0]
        growth = total - before
    return ranks.select("host", (F.col("rank") / total).alias("rank"))


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, ratio: float = RATIO, floor: float = FLOOR) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every page."""
    url = F.col("url")
    parsed = stored(pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path")), "url-parsed")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parsed.withColumn("rule", name).withColumn("own", verdict)
    edges = stored(host_edges(pages), "url-edges")
    by_host = ruled.where("own is not null and host != ''").groupBy("host").agg(
        F.count_if(F.col("own") == "allow").alias("allowed"), F.count_if(F.col("own") == "block").alias("blocked")
    )
    by_host = stored(by_host, "url-seeds")
    total = by_host.agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")).first()
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("host")).unionByName(by_host.select("host")).distinct().count()
    least = floor / max(1, nodes)
    empty = by_host.where("false").select("host", F.lit(0.0).alias("weight"))
    seeds = {c: by_host.where(F.col(c) > 0).select("host", (F.col(c) / total[c]).alias("weight")) if total[c] else empty for c in ("allowed", "blocked")}
    scale = {c: (total[c] or 0) / max(1, (total["allowed"] or 0) + (total["blocked"] or 0)) for c in ("allowed", "blocked")}
    trust = propagate(edges, seeds["allowed"], least / 10).select("host", (F.col("rank") * scale["allowed"]).alias("trust"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    distrust = propagate(back, seeds["blocked"], least / 10).select("host", (F.col("rank") * scale["blocked"]).alias("distrust"))
    hosts = trust.join(distrust, "host", "full").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    # A table, so that its true size decides the join, and so that a host of a third of all pages can be split.
    joined = ruled.join(stored(hosts, "url-hosts"), "host", "left")
    suspect = F.coalesce("distrust", F.lit(0.0)) > F.coalesce("trust", F.lit(0.0)) * ratio + least
    return joined.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("own", F.when(suspect, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
