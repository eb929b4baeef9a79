"""Results of runs as files: a row a query, with JSON in the cells that hold more than a number."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of a result file, in order.
COLUMNS = (
    "query_ordinal", "method", "substrate", "dataset", "workload", "query_rect", "aggregates", "target_satisfied", "status", "exactify_cause",
    "pre_exactification_error_bound", "sampling_seed", "latency_ms", "measure_reads", "sampled_rows", "exactified_rows", "outlier_rows",
    "frontier_partitions", "partitions_refined", "exact_contributors", "reusable_sampled_strata", "reusable_absent_strata", "query_local_strata",
    "adaptive_rounds", "scan_path_rows", "gather_path_rows", "scan_bytes_read", "gather_bytes_read", "round_paths",
)
CELL = "array<struct<aggregate: string, measure: string, estimate: double, ci_low: double, ci_high: double, relative_half_width: double, effective_df: double, exact: boolean>>"
PARTS = ("aggregate", "measure", "estimate", "ci_low", "ci_high", "relative_half_width", "effective_df", "exact")


def per_query(results: DataFrame, dataset: str, workload: str) -> DataFrame:
    """A row a query with all of COLUMNS, from rows of single aggregates as ``plans.runner.run`` gives them.

    What only an engine that gathers rows by id can tell (scan and gather paths,
    bytes) is 0 and an empty list.
    """
    one = F.struct(*PARTS)
    from ..plans.runner import COUNTERS

    ok = F.col("exact") | (F.col("relative_half_width") <= F.col("error_bound"))
    rows = results.groupBy("query_ordinal", "method", "replicate").agg(
        F.to_json(F.struct(F.first("lower").alias("lower"), F.first("upper").alias("upper"))).alias("query_rect"),
        F.to_json(F.array_sort(F.collect_list(one))).alias("aggregates"),
        F.bool_and(F.coalesce(ok, F.lit(False))).alias("target_satisfied"),
        *[F.first(c).alias(c) for c in ("status", "latency_ms", "measure_reads", "rounds", *COUNTERS)],
    )
    known = {
        "substrate": F.when(F.col("method").startswith("grid_akd"), "grid_akd").otherwise(F.split("method", "_")[0]), "dataset": F.lit(dataset), "workload": F.lit(workload), "sampling_seed": F.col("replicate"), "adaptive_rounds": F.col("rounds"),
        **{c: F.lit(0) for c in ("scan_path_rows", "gather_path_rows", "scan_bytes_read", "gather_bytes_read")}, "round_paths": F.lit("[]"),
    }
    given = {c: F.col(c) for c in rows.columns if c in COLUMNS}
    return rows.select(*[(given | known).get(c, F.lit(None).cast("string")).alias(c) for c in COLUMNS])


def write(queries: DataFrame, path: str, overwrite: bool = False) -> None:
    """CSV with a header; quotes inside JSON cells are doubled."""
    queries.write.mode("overwrite" if overwrite else "error").option("header", True).option("escape", '"').csv(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row an aggregate again. ValueError if a file's columns aren't COLUMNS."""
    raw = spark.read.options(header=True, escape='"').csv(path)
    if tuple(raw.columns) != COLUMNS:
        raise ValueError(f"columns {raw.columns}, expected {list(COLUMNS)}")
    corners = F.from_json("query_rect", "lower array<double>, upper array<double>")
    return raw.withColumn("rect", corners).withColumn("x", F.explode(F.from_json("aggregates", CELL))).select(
        "method", F.col("sampling_seed").cast("int").alias("replicate"), F.col("query_ordinal").cast("long").alias("query_ordinal"), "dataset", "workload",
        "rect.lower", "rect.upper", *[f"x.{p}" for p in PARTS], "status", F.col("latency_ms").cast("double").alias("latency_ms"), F.col("measure_reads").cast("long").alias("measure_reads"),
    )


def missing(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Planned runs without a result; null keys are equal to null keys."""
    return expected.join(present, [expected[k].eqNullSafe(present[k]) for k in keys], "left_anti")


def write_settings(spark: SparkSession, settings: dict, path: str, overwrite: bool = False) -> None:
    """A run's settings (method, data, workload, bounds, seeds) as one JSON text beside its results."""
    text = json.dumps(settings, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite" if overwrite else "error").text(path)


def read_settings(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def run_path(root: str, dataset: str, workload: str, method: str, setting: str, replicate: int) -> str:
    """Where a run's results are written: everything that tells runs apart is a part of the path."""
    return f"{root}/dataset={dataset}/workload={workload}/method={method}/setting={setting}/replicate={replicate}"


def discover(spark: SparkSession, root: str) -> DataFrame:
    """All results under root, written by run_path: rows as read() gives them, and setting. ValueError if a file's columns aren't COLUMNS."""
    parts = ("dataset", "workload", "method", "setting", "replicate")
    raw = spark.read.options(header=True, escape='"', basePath=root, recursiveFileLookup=False, enforceSchema=False).csv(f"{root}/dataset=*/workload=*/method=*/setting=*/replicate=*")
    if set(raw.columns) - {"setting", "replicate"} != set(COLUMNS):
        raise ValueError(f"columns {raw.columns}, expected {list(COLUMNS)} and {parts}")
    corners = F.from_json("query_rect", "lower array<double>, upper array<double>")
    return raw.withColumn("rect", corners).withColumn("x", F.explode(F.from_json("aggregates", CELL))).select(
        "dataset", "workload", "method", "setting", F.col("replicate").cast("int").alias("replicate"), F.col("query_ordinal").cast("long").alias("query_ordinal"),
        "rect.lower", "rect.upper", *[f"x.{p}" for p in PARTS], "status", F.col("latency_ms").cast("double").alias("latency_ms"), F.col("measure_reads").cast("long").alias("measure_reads"),
    )
