"""A fixed random rank of each row: samples without replacement as prefixes of an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STREAM = 2654435769
MULTIPLIER = 73244475


def rank_hash(row_id: Column, k: int = STREAM) -> Column:
    """A bijection of each 2**32 ids for each stream constant k, another one for each such run of ids; the same expression runs in other SQL engines."""
    fold = lambda v: (v.bitwiseXOR(F.shiftright(v, 16)) * MULTIPLIER) % (1 << 32)
    low, high = row_id.cast("long").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(row_id.cast("long"), 32)
    return fold(fold(low.bitwiseXOR(fold(high))).bitwiseXOR(F.lit(k)))


def rank_sql(row_id: str, k: int = STREAM) -> str:
    fold = lambda v: f"((xor({v}, {v} >> 16) * {MULTIPLIER}) % 4294967296)"
    low = f"xor({row_id} & 4294967295, {fold(f'({row_id} >> 32)')})"
    return fold(f"xor({fold(low)}, {k})")


def rank_prefix(df: DataFrame, stratum: str, size: Column, row_id: str = "row_id", k: int = STREAM) -> DataFrame:
    """The first ``size`` rows of each stratum by rank: a simple random sample that grows without redrawing."""
    order = Window.partitionBy(stratum).orderBy(rank_hash(F.col(row_id), k), row_id)
    return df.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= size).drop("__n")
