"""Made-up point tables: each value is a function of the seed, the column and the row's number alone."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Spread:
    """kind: uniform (a: low, b: high, not reached), normal (a: mean, b: deviation) or lognormal (of the logarithm)."""

    kind: str = "uniform"
    a: float = 0.0
    b: float = 1.0


def unit(row_id: Column, *stream: int) -> Column:
    """53 hashed bits as a number in [0, 1), whatever the partitions are."""
    return F.shiftrightunsigned(F.xxhash64(row_id, *[F.lit(s) for s in stream]), 11) / F.lit(float(1 << 53))


def value(row_id: Column, spread: Spread, seed: int, place: int) -> Column:
    u = unit(row_id, seed, place, 0)
    if spread.kind == "uniform":
        return spread.a + u * (spread.b - spread.a)
    if spread.kind not in ("normal", "lognormal"):
        raise ValueError(f"no such distribution: {spread.kind}")
    # Box and Muller's transform; 1 - u is never 0
    normal = spread.a + spread.b * F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * unit(row_id, seed, place, 1))
    return F.exp(normal) if spread.kind == "lognormal" else normal


def generate(spark: SparkSession, rows: int, columns: list[Spread], seed: int = 0) -> DataFrame:
    """row_id and col0, col1, ... of ``rows`` rows, made where they are needed, without a shuffle."""
    base = spark.range(rows).withColumnRenamed("id", "row_id")
    return base.select("row_id", *[value(F.col("row_id"), s, seed, i).alias(f"col{i}") for i, s in enumerate(columns)])


def scatter(df: DataFrame, buckets: int, path: str, seed: int = 0, row_id: str = "row_id", overwrite: bool = False) -> None:
    """Parquet parted by a hashed bucket of the row, so that a bucket is a uniform sample."""
    parted = df.withColumn("bucket", F.pmod(F.xxhash64(F.col(row_id), F.lit(seed)), F.lit(buckets)).cast("int"))
    parted.write.mode("overwrite" if overwrite else "error").option("compression", "zstd").partitionBy("bucket").parquet(path)


def verify(points: DataFrame, described: DataFrame, measures: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Statistics that differ from those told of a prepared table (``prepare.describe``): measure, statistic, told, found."""
    from .prepare import describe

    names = ["non_nan_count", "nan_count", "sum", "sum_sq", "min", "max"]
    long = lambda df, to: df.select("measure", F.explode(F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(n).cast("double").alias(to)) for n in names])).alias("x")).select("measure", "x.*")
    both = long(described, "told").join(long(describe(points, measures), "found"), ["measure", "statistic"], "full")
    near = F.abs(F.col("told") - F.col("found")) <= tolerance * F.greatest(F.lit(1.0), F.abs("told"))
    return both.where(~F.coalesce(near, F.lit(False)))
