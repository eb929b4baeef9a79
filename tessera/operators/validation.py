"""Hold results against exact ones: values, intervals, coverage, read counts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import normal_quantile, t_quantile

ENOUGH = 100  # trials below which one replicate says nothing about coverage
KEY = ["query_ordinal", "measure", "aggregate"]


def judged(results: DataFrame, oracle: DataFrame) -> DataFrame:
    """Results with truth, relative_error and verdicts; oracle: the rows of one exact method.

    exact_ok: exact rows have equal counts, and sums and means within 1e-6 of
    max(1, truth). near: within the error bound. covered: the interval holds
    the truth. brackets: it holds the estimate. same_query: equal rectangles.
    """
    truth = oracle.select(*KEY, F.col("estimate").alias("truth"), F.col("lower").alias("__l"), F.col("upper").alias("__u"))
    e, t = F.col("estimate"), F.col("truth")
    both_nan, size = F.isnan(e) & F.isnan(t), F.greatest(F.lit(1.0), F.abs(t))
    counts = F.col("aggregate").isin("COUNT", "COUNT_STAR")
    slack = 1e-9 * F.greatest(F.lit(1.0), F.abs(e))
    inside = lambda v: (F.col("ci_low") <= v + slack) & (v - slack <= F.col("ci_high"))
    return results.join(truth, KEY, "left").select(
        *results.columns, "truth",
        F.when(both_nan, 0.0).otherwise(F.abs(e - t) / size).alias("relative_error"),
        (~F.col("exact") | both_nan | F.when(counts, e == t).otherwise(F.abs(e - t) <= 1e-6 * size)).alias("exact_ok"),
        (both_nan | (F.abs(e - t) / size <= F.greatest(F.col("error_bound"), F.lit(1e-6)))).alias("near"),
        (both_nan | inside(t)).alias("covered"),
        (F.isnan(e) | inside(e)).alias("brackets"),
        ((F.col("lower") == F.col("__l")) & (F.col("upper") == F.col("__u"))).alias("same_query"),
    )


def status_ok(results: DataFrame, measures: int) -> DataFrame:
    """method, replicate, query_ordinal, ok: an exact status has exact rows only; the values read, which tasks count, are rows times measures; a frontier's parts add up; and without held-out rows none are read."""
    whole = F.bool_and("exact") | ~F.max(F.col("status").isin("exact", "exactified"))
    reads = F.bool_and((F.col("measure_reads") == (F.col("sampled_rows") + F.col("exactified_rows") + F.col("outlier_rows")) * measures))
    frontier = F.bool_and(F.col("frontier_partitions") == F.col("exact_contributors") + F.col("reusable_sampled_strata") + F.col("reusable_absent_strata") + F.col("query_local_strata"))
    return results.groupBy("method", "replicate", "query_ordinal").agg((whole & reads & frontier).alias("ok"), reads.alias("reads_ok"), frontier.alias("frontier_ok"))


def inert(results: DataFrame) -> DataFrame:
    """method, ok: runs without held-out rows (outlier budget 0) read none."""
    return results.groupBy("method").agg((F.max("outlier_rows") == 0).alias("ok"))


def complete(oracle: DataFrame) -> DataFrame:
    """ok: the ordinals run from 0 without a gap."""
    return oracle.agg((F.coalesce(F.max("query_ordinal") + 1, F.lit(0)) == F.count_distinct("query_ordinal")).alias("ok"))


def coverage(rows: DataFrame) -> list[dict]:
    """For each method, measure and aggregate the share of covered non-exact rows and a verdict: ok, low or insufficient.

    With several replicates the upper one-sided 95 % Student bound of their
    mean coverage is held against the confidence; with one the binomial with
    continuity correction; below ENOUGH rows in all nothing is said. never:
    queries sampled in every replicate that none covered. A row a replicate
    comes to the driver.
    """
    group = ["method", "measure", "aggregate"]
    sampled = rows.where(~F.col("exact") & F.col("truth").isNotNull())
    by = sampled.groupBy(*group, "replicate").agg(F.avg(F.col("covered").cast("int")).alias("share"), F.count("*").alias("n"), F.max("confidence").alias("confidence"))
    found: dict[tuple, list] = {}
    for r in by.collect():
        found.setdefault(tuple(r[g] for g in group), []).append(r)
    places = sampled.groupBy(*group, "query_ordinal").agg(F.max("covered").alias("any"), F.count_distinct("replicate").alias("seen"))
    runs = sampled.groupBy(*group).agg(F.count_distinct("replicate").alias("runs"))
    never = {tuple(r[g] for g in group): r["never"] for r in places.join(runs, group).groupBy(*group).agg(F.count_if(~F.col("any") & (F.col("seen") == F.col("runs"))).alias("never")).collect()}
    out = []
    for key, reps in sorted(found.items()):
        shares, n, want = [r["share"] for r in reps], sum(r["n"] for r in reps), reps[0]["confidence"]
        mean = sum(shares) / len(shares)
        if n < ENOUGH:
            verdict = "insufficient"
        elif len(reps) >= 2:
            error = math.sqrt(sum((s - mean) ** 2 for s in shares) / (len(shares) - 1) / len(shares))
            verdict = "ok" if mean + t_quantile(0.95, len(shares) - 1) * error >= want else "low"
        else:
            z = (mean * n + 0.5 - want * n) / math.sqrt(n * want * (1 - want))
            verdict = "ok" if z >= -normal_quantile(0.95) else "low"
        out.append(dict(zip(group, key, strict=True)) | {"coverage": mean, "trials": n, "never": never[key], "verdict": verdict})
    return out


def diagnostics(results: DataFrame) -> list[dict]:
    """What methods should do, against what they did: check, status (PASS, WARN or FAIL) and detail. A row a method comes to the driver."""
    by = {r["method"]: r for r in costs(results).collect()}
    out = []

    def expect(check: str, ok: bool, detail: str, soft: bool = False) -> None:
        out.append({"check": check, "status": "PASS" if ok else "WARN" if soft else "FAIL", "detail": detail})

    def pair(a: str, b: str, what: str, factor: float = 1.0, slack: float = 0.0, soft: bool = False) -> None:
        if a in by and b in by:
            expect(f"{a} {what} {b}", by[a][what] <= factor * by[b][what] + slack, f"{by[a][what]:,.1f} and {by[b][what]:,.1f}", soft)

    full = [m for m in ("scan", "kd", "akd") if m in by]
    if "scan" in by:
        expect("no method reads more than scan", all(r["measure_reads"] <= by["scan"]["measure_reads"] + 2 for r in by.values()), ", ".join(f"{m} {r['measure_reads']:,.0f}" for m, r in sorted(by.items())))
    if len(full) > 1:
        reads = [by[m]["measure_reads"] for m in full]
        expect("exact methods without summaries read the same", max(reads) - min(reads) <= 2, ", ".join(f"{m} {n:,.0f}" for m, n in zip(full, reads, strict=True)))
    for index in ("kd", "akd"):
        pair(f"{index}_agg", index, "measure_reads")
    pair("kd_agg", "kd", "measure_reads", 0.9, soft=True)
    for near in ("akd_approx", "akd_agg_approx", "grid_akd_agg_approx"):
        if full:
            pair(near, full[-1], "measure_reads", slack=2)
        pair(near, "scan", "total_ms", soft=near.startswith("grid"))
    pair("akd_agg_approx", "akd_agg", "measure_reads", soft=True)
    pair("akd_agg_approx", "akd_approx", "measure_reads", 1.05, soft=True)
    pair("grid_akd_agg_approx", "akd_agg_approx", "measure_reads", soft=True)
    pair("grid_akd_agg_approx", "kd_agg", "init_ms", soft=True)
    return out


def shared(results: DataFrame, axis: str):
    """The one value that all results have on an axis (null apart); ValueError if they differ, for then they can't be compared."""
    found = [r[0] for r in results.select(axis).where(F.col(axis).isNotNull()).distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"results differ in {axis}: {sorted(found)}, ...")
    return found[0] if found else None


def several(results: DataFrame, axis: str) -> bool:
    """Whether results have more than one value on an axis, such as the version that made them."""
    return results.select(axis).where(F.col(axis).isNotNull()).distinct().limit(2).count() > 1


def cost_and_accuracy(cost: DataFrame, accuracy: DataFrame, keys: list[str]) -> DataFrame:
    """Every row of cost with its accuracy; null keys are equal to null keys."""
    right = accuracy.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in accuracy.columns if c not in keys])
    return cost.join(right, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left").drop(*[f"__{k}" for k in keys])


def costs(results: DataFrame, baseline: str = "scan") -> DataFrame:
    """method: init, total and tail latencies, reads, and the speed against the baseline."""
    once = results.dropDuplicates(["method", "replicate", "query_ordinal"])
    runs = once.groupBy("method", "replicate").agg(F.max("init_ms").alias("init_ms"), F.sum("latency_ms").alias("sum_ms"), F.sum("measure_reads").alias("reads"))
    tails = once.groupBy("method").agg(*[F.percentile("latency_ms", p).alias(f"p{round(100 * p)}") for p in (0.5, 0.95, 0.99)])
    means = runs.groupBy("method").agg(F.avg("init_ms").alias("init_ms"), F.avg(F.col("init_ms") + F.col("sum_ms")).alias("total_ms"), F.avg("reads").alias("measure_reads"))
    base = F.max(F.when(F.col("method") == baseline, F.col("total_ms"))).over(Window.partitionBy())  # a row a method
    return means.join(tails, "method").withColumn("speedup", base / F.col("total_ms"))


def reads_fall(results: DataFrame) -> DataFrame:
    """method, error_bound, reads, ok: a looser bound never reads more than the tighter one before it."""
    once = results.dropDuplicates(["method", "error_bound", "replicate", "query_ordinal"]).groupBy("method", "error_bound").agg(F.sum("measure_reads").alias("reads"))
    before = F.lag("reads").over(Window.partitionBy("method").orderBy("error_bound"))
    return once.withColumn("ok", F.coalesce(F.col("reads") <= before, F.lit(True)))
