"""Order-dependent figures of few, long groups: running sums, values before, quantiles. No group is sorted by one task.

A group is cut into stretches of the order column; what a stretch needs of
those before it is a sum or a last value, found from a row a stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kd import SORTED, order_statistics

STRETCH = 1 << 16  # of the order column, whole numbers


def stretches(df: DataFrame, key: str, order: str, carried: Column, width: int) -> tuple[DataFrame, DataFrame]:
    """df with __s, and key, __s and what is carried of each stretch, numbered in order."""
    cut = df.withColumn("__s", F.floor(F.col(order) / width))
    return cut, cut.groupBy(key, "__s").agg(carried.alias("__carried"))


def running_sum(df: DataFrame, key: str, order: str, value: str, name: str = "running", width: int = STRETCH) -> DataFrame:
    """df with the sum of value over the group's rows up to each one by order (distinct in a group)."""
    cut, each = stretches(df, key, order, F.sum(value), width)
    before = Window.partitionBy(key).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)  # a row a stretch
    carried = each.select(key, "__s", F.coalesce(F.sum("__carried").over(before), F.lit(0.0)).alias("__before"))
    inside = Window.partitionBy(key, "__s").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.join(carried, [key, "__s"]).withColumn(name, F.col("__before") + F.sum(value).over(inside)).select(*df.columns, name)


def lagged(df: DataFrame, key: str, order: str, value: str, name: str = "before", width: int = STRETCH) -> DataFrame:
    """df with the value of the group's row before each one by order; null for the first."""
    cut, each = stretches(df, key, order, F.max_by(F.struct(value), order), width)
    last = each.select(key, "__s", F.lag("__carried").over(Window.partitionBy(key).orderBy("__s")).alias("__last"))  # a row a stretch
    inside = Window.partitionBy(key, "__s").orderBy(order)
    own = F.when(F.row_number().over(inside) == 1, F.col("__last")[value]).otherwise(F.lag(value).over(inside))
    return cut.join(last, [key, "__s"]).withColumn(name, own).select(*df.columns, name)


def quantiles(df: DataFrame, key: str, value: str, shares: dict[str, float], sorted_rows: int = SORTED) -> DataFrame:
    """key and a column for each share: the quantile by linear interpolation between the two values beside it; null values don't count."""
    places = [f for p in shares.values() for f in (lambda n, p=p: F.floor((n - 1) * F.lit(p)), lambda n, p=p: F.ceil((n - 1) * F.lit(p)))]
    found = order_statistics(df, value, key, places, sorted_rows)
    wide = found.groupBy(key).agg(F.max("n").alias("__n"), *[F.max(F.when(F.col("which") == i, F.col("value"))).alias(f"__v{i}") for i in range(len(places))])
    part = lambda p: (F.col("__n") - 1) * F.lit(p) - F.floor((F.col("__n") - 1) * F.lit(p))
    return wide.select(key, *[(F.col(f"__v{2 * i}") + (F.col(f"__v{2 * i + 1}") - F.col(f"__v{2 * i}")) * part(p)).alias(name) for i, (name, p) in enumerate(shares.items())])
