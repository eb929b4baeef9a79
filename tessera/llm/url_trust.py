"""URL filters: host and path rules, and trust carried along links for the hosts no rule fits.

Host edges come from the absolute links of the pages' HTML, counted per pair
of hosts (pre-aggregated). Two personalised PageRanks run over them together:
trust from the hosts that an allow rule fits, along links, and distrust from
those that a block rule for the whole host (path /) fits, against them. Every seed starts each round with
1 - DAMPING, so scores mean the same in a small graph and a large one. What a
host is handed shrinks with the number of hosts that share it, so there are
shares as well: what reached a host from seeds, of what reaches it when every
host starts with 1 - DAMPING (a seed's share is 1). A host is blocked if its
distrust is over the threshold and over its trust, as scores or as shares.

A round is one join and one pre-aggregated sum over (host, kind) rows; rounds
end when the changes of all hosts add up to at most ``tolerance``, and for the
rows that start everywhere to that part of what they started with, or after
``rounds``. A hub's edges meet in
the join, whose partitions Spark splits. The rounds are tables in the shared
folder, so lost executors cost no more than the round.

Defined cases: a null url, or one without ``://``, has an empty host and path,
which only links and rules could judge, so it is allowed; null HTML has no
links; repeated pages and ids count their links each and are judged each.
Links to the page's own host carry nothing. Of rules of one length that fit,
the later one in the list wins; equal trust and distrust don't block. An empty
table gives no rows; very long pages are read whole; extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, staged

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING, THRESHOLD, TOLERANCE, ROUNDS = 0.85, 0.05, 1e-4, 50
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    # (?s) and \z: a line end in a url is a character like any other
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The rule that fits, as text, and its verdict: the longest one, or null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, what).otherwise(verdict)
    return text, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links from one host's pages to another's."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.expr(r"regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*[\"'']?((?:[a-z][a-z0-9+.-]*:)?//[^\"''\\s>]*)', 1)")).alias("link"))
    to = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), F.col("link"))).otherwise(F.col("link"))
    return links.select("src", host_of(to).alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """host, trust, distrust, their shares and whether rounds ended by the tolerance, from edges (src, dst, n) and seeds (host, kind), where kind is trust or distrust."""
    edges = staged(edges, "edges")
    start = staged(seeds.select("host", "kind", F.lit(1.0 - damping).alias("score")), "seeds")
    ahead = edges.groupBy("src").agg(F.sum("n").alias("all")).join(edges, "src").select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("all")).alias("share"))
    back = edges.groupBy("dst").agg(F.sum("n").alias("all")).join(edges, "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), (F.col("n") / F.col("all")).alias("share"))
    flow = ahead.union(back)
    flow = staged(flow.union(flow.withColumn("kind", F.concat("kind", F.lit("_all")))), "flow")
    hosts = flow.select("host", "kind").union(flow.select("to", "kind")).where("kind like '%_all'").distinct()
    start = staged(start.union(hosts.withColumn("score", F.lit(1.0 - damping))), "starts")
    mass = {r["kind"]: r["mass"] for r in start.groupBy("kind").agg(F.sum("score").alias("mass")).collect()}
    scores, settled = start, flow.isEmpty()
    for _ in range(0 if settled else rounds):
        moved = flow.join(scores, ["host", "kind"]).select(F.col("to").alias("host"), "kind", (F.col("share") * F.col("score") * damping).alias("score"))
        now = staged(moved.union(start).groupBy("host", "kind").agg(F.sum("score").alias("score")), "scores")
        change = F.sum(F.abs(F.col("score") - F.coalesce("old", F.lit(0.0)))).alias("change")
        changes = now.join(scores.withColumnRenamed("score", "old"), ["host", "kind"], "left").groupBy("kind").agg(change).collect()  # at most four rows
        if scores is not start:
            release(scores)
        scores = now
        settled = all(r["change"] <= tolerance * (mass[r["kind"]] if r["kind"].endswith("_all") else 1.0) for r in changes)
        if settled:
            break
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    own = start.where("kind in ('trust', 'distrust')").groupBy("host").agg(*[F.max(F.col("kind") == k).alias(f"{k}_seed") for k in ("trust", "distrust")])
    out = scores.groupBy("host").agg(*[of(k) for k in ("trust", "distrust", "trust_all", "distrust_all")]).join(own, "host", "left")
    reached = lambda kind: F.col(f"{kind}_all") - (1.0 - damping)
    share = lambda kind: F.when(F.col(f"{kind}_seed"), 1.0).when(reached(kind) > 0, F.least(F.col(kind) / reached(kind), F.lit(1.0))).otherwise(0.0).alias(f"{kind}_share")
    return out.select("host", "trust", "distrust", share("trust"), share("distrust"), F.lit(settled).alias("converged"))


def filter_urls(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, the host's trust and distrust, and whether the rounds converged (null: no edge or seed has the host)."""
    text, verdict = best_rule(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).select("page_id", "host", "path", text.alias("rule"), verdict.alias("__v"))
    whole = [h + p for what, h, p in rules if what == "block" and p == "/"]
    fits = judged.where("host <> ''").where((F.col("__v") == "allow") | F.col("rule").isin(whole))
    seeds = fits.select("host", F.when(F.col("__v") == "allow", "trust").otherwise("distrust").alias("kind")).distinct()
    scores = propagate(host_edges(pages), seeds)
    out = judged.join(scores, "host", "left").select("page_id", "host", "path", "rule", "__v", "converged", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust", "trust_share", "distrust_share")])
    by_score = (F.col("distrust") > threshold) & (F.col("distrust") > F.col("trust"))
    by_share = (F.col("distrust_share") > threshold) & (F.col("distrust_share") > F.col("trust_share") + 1e-9)  # equal shares differ by rounding
    method = F.when(by_score | by_share, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("__v", method).alias("verdict"), "trust", "distrust", "converged")
