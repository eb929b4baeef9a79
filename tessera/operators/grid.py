"""Equal-width tiles over the dimensions: which tile a point is in, and which a rectangle meets."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import Points, Rect


@dataclass(frozen=True)
class Grid:
    bounds: Rect
    k: int

    def width(self, axis: int) -> float:
        return (self.bounds.upper[axis] - self.bounds.lower[axis]) / self.k

    def edge(self, axis: int, i: int) -> float:
        return self.bounds.lower[axis] + i * self.width(axis)

    def refine(self, rect: Rect) -> list[int]:
        """Tiles are never cut."""
        return []

    def tile(self, dims, rect: Rect | None = None, done=()) -> Column:
        """Row-major number of a point's tile, by the same edges as box(); rect and done don't matter."""
        out = F.lit(0).cast("long")
        for axis, d in enumerate(dims):
            i = F.floor((F.col(d) - self.bounds.lower[axis]) / self.width(axis))
            low, high = (F.lit(self.bounds.lower[axis]) + (i + s) * F.lit(self.width(axis)) for s in (0, 1))
            i = F.when(F.col(d) < low, i - 1).when(F.col(d) >= high, i + 1).otherwise(i)
            out = out * self.k + F.least(F.greatest(i, F.lit(0)), F.lit(self.k - 1))
        return out

    def box(self, tile: int) -> Rect:
        at = []
        for _ in self.bounds.lower:
            tile, i = divmod(tile, self.k)
            at.append(i)
        at = at[::-1]
        return Rect(tuple(self.edge(a, i) for a, i in enumerate(at)), tuple(self.bounds.upper[a] if i == self.k - 1 else self.edge(a, i + 1) for a, i in enumerate(at)))

    def covering(self, rect: Rect, done=()) -> list[int]:
        spans = []
        for a in range(len(rect.lower)):
            lo, hi = (min(max(int((v[a] - self.bounds.lower[a]) // self.width(a)), 0), self.k - 1) for v in (rect.lower, rect.upper))
            spans.append(range(lo, hi + 1))
        out = []
        for at in itertools.product(*spans):
            number = 0
            for i in at:
                number = number * self.k + i
            if self.box(number).intersects(rect):
                out.append(number)
        return out


def tile_moments(points: DataFrame, spec: Points, grid: Grid) -> DataFrame:
    """One sweep: population and each measure's n, S and Q of every tile."""
    sums = [f for m in spec.measures for f in (F.count(m).alias(f"n_{m}"), F.coalesce(F.sum(m), F.lit(0.0)).alias(f"S_{m}"), F.coalesce(F.sum(F.col(m) * F.col(m)), F.lit(0.0)).alias(f"Q_{m}"))]
    return points.groupBy(grid.tile(spec.dims).alias("part_id")).agg(F.count("*").alias("population"), *sums)
