"""Exact aggregates: one rectangle, or many at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import Points, Rect


def aggregates(spec: Points) -> list:
    """SUM (0 if empty), COUNT and AVG (null if empty) of each measure, and COUNT(*)."""
    out = []
    for m in spec.measures:
        out += [F.coalesce(F.sum(m), F.lit(0.0)).alias(f"sum_{m}"), F.count(m).alias(f"count_{m}"), F.avg(m).alias(f"avg_{m}")]
    return [*out, F.count("*").alias("count_star")]


def exact_scan(points: DataFrame, spec: Points, rect: Rect) -> DataFrame:
    return points.where(rect.predicate(list(spec.dims))).agg(*aggregates(spec))


def batch_scan(points: DataFrame, spec: Points, rects: DataFrame, cell: tuple[float, ...], most: int = 1000) -> DataFrame:
    """Every rectangle of rects (query_ordinal, lower, upper), empty ones included.

    ``most`` or fewer rectangles (counted) are sent to all tasks. More are
    joined by the cells of an equal-width grid that they overlap: cells whose
    points all lie inside answer by their sums, and only the others' points are
    looked at one by one.
    """
    small = rects.limit(most + 1).count() <= most
    inside = [(F.col(d) >= F.col("lower")[i]) & (F.col(d) < F.col("upper")[i]) for i, d in enumerate(spec.dims)]
    cond = reduce(lambda a, b: a & b, inside)
    if small:
        found = points.join(F.broadcast(rects), cond).groupBy("query_ordinal").agg(*aggregates(spec))
    else:
        found = by_cells(points, spec, rects, cell, cond)
    zero = {c: 0 for c in found.columns if c.startswith(("sum_", "count"))}
    return rects.select("query_ordinal").join(found, "query_ordinal", "left").fillna(zero)


def by_cells(points: DataFrame, spec: Points, rects: DataFrame, cell: tuple[float, ...], cond) -> DataFrame:
    keys, asked, dealt = [f"__c{i}" for i in range(len(cell))], rects, points.select(*spec.dims, *spec.measures)
    for i, (d, w, k) in enumerate(zip(spec.dims, cell, keys, strict=True)):
        asked = asked.withColumn(k, F.explode(F.sequence(F.floor(F.col("lower")[i] / w), F.floor(F.col("upper")[i] / w))))
        dealt = dealt.withColumn(k, F.floor(F.col(d) / w))
    ends = [f(d).alias(f"__{n}{i}") for i, d in enumerate(spec.dims) for n, f in (("lo", F.min), ("hi", F.max))]
    names = [c for m in spec.measures for c in (f"sum_{m}", f"count_{m}")] + ["count_star"]
    sums = aggregates(spec)
    cells = dealt.groupBy(*keys).agg(*sums, *ends)
    met = asked.join(cells, keys)
    whole = reduce(lambda a, b: a & b, [(F.col(f"__lo{i}") >= F.col("lower")[i]) & (F.col(f"__hi{i}") < F.col("upper")[i]) for i in range(len(keys))])
    apart = reduce(lambda a, b: a | b, [(F.col(f"__hi{i}") < F.col("lower")[i]) | (F.col(f"__lo{i}") >= F.col("upper")[i]) for i in range(len(keys))])
    of_cells = met.where(whole).select("query_ordinal", *names)
    edge = met.where(~whole & ~apart).select("query_ordinal", "lower", "upper", *keys)
    of_points = dealt.join(edge, keys).where(cond).groupBy("query_ordinal").agg(*sums).select("query_ordinal", *names)
    total = of_cells.union(of_points).groupBy("query_ordinal").agg(*[F.sum(n).alias(n) for n in names])
    means = [F.when(F.col(f"count_{m}") > 0, F.col(f"sum_{m}") / F.col(f"count_{m}")).alias(f"avg_{m}") for m in spec.measures]
    return total.select("query_ordinal", *[c for m, mean in zip(spec.measures, means, strict=True) for c in (f"sum_{m}", f"count_{m}", mean)], "count_star")
