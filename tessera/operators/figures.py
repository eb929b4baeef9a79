"""The rows behind each figure about methods, from rows as ``plans.runner.run`` gives them.

Replicates of a query are first brought to their median, so a method counts
once however often it ran. ``axis`` names a column that tells settings apart
(error_bound, or one that the caller has added: measures, selectivity, rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_query(results: DataFrame, *axis: str) -> DataFrame:
    """method, axis, query_ordinal: init_ms, latency_ms and measure_reads, the medians over replicates."""
    numbers = ("init_ms", "latency_ms", "measure_reads")
    runs = results.groupBy("method", *axis, "replicate", "query_ordinal").agg(*[F.first(c).alias(c) for c in numbers])  # equal in a query's rows
    return runs.groupBy("method", *axis, "query_ordinal").agg(*[F.median(c).alias(c) for c in numbers])


def cumulative_time(results: DataFrame) -> DataFrame:
    """Time from the start of a method's set-up to the end of each query."""
    so_far = Window.partitionBy("method").orderBy("query_ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return by_query(results).select("method", "query_ordinal", "latency_ms", "measure_reads", (F.col("init_ms") + F.sum("latency_ms").over(so_far)).alias("cumulative_ms"))


def latency_tail(results: DataFrame, *axis: str) -> DataFrame:
    tails = [F.percentile("latency_ms", p).alias(f"p{round(100 * p)}") for p in (0.5, 0.95, 0.99)]
    return by_query(results, *axis).groupBy("method", *axis).agg(*tails, F.max("latency_ms").alias("worst"))


def sweep(results: DataFrame, axis: str) -> DataFrame:
    """Total time and reads of each method at each setting, and the time against the least one of that method."""
    totals = by_query(results, axis).groupBy("method", axis).agg((F.max("init_ms") + F.sum("latency_ms")).alias("total_ms"), F.sum("measure_reads").alias("measure_reads"))
    return totals.withColumn("relative", F.col("total_ms") / F.min("total_ms").over(Window.partitionBy("method")))


def achieved_error(results: DataFrame, exact: str = "scan") -> DataFrame:
    """Quantiles of the relative error that methods achieved, for each bound asked for; the truth is the exact method's."""
    keys = ["query_ordinal", "measure", "aggregate"]
    truth = results.where(F.col("method") == exact).groupBy(*keys).agg(F.first("estimate").alias("truth"))
    error = F.abs(F.col("estimate") - F.col("truth")) / F.greatest(F.lit(1.0), F.abs("truth"))
    both = results.where(F.col("method") != exact).join(truth, keys).withColumn("error", error)
    return both.groupBy("method", "error_bound").agg(*[F.percentile("error", p).alias(f"p{round(100 * p)}") for p in (0.5, 0.95)], F.max("error").alias("worst"), F.avg((F.col("error") <= F.col("error_bound")).cast("int")).alias("within"))


def speedup_and_error(results: DataFrame, exact: str = "scan") -> DataFrame:
    """Each method's speed against the exact one, beside the error it achieved."""
    base = sweep(results, "error_bound")
    least = F.min(F.when(F.col("method") == exact, F.col("total_ms"))).over(Window.partitionBy())  # a row a method and bound
    speed = base.withColumn("speedup", least / F.col("total_ms")).where(F.col("method") != exact)
    return speed.select("method", "error_bound", "speedup").join(achieved_error(results, exact), ["method", "error_bound"], "left")
