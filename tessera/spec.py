"""Rectangles over dimensions, accuracy targets, estimates and a point table's columns."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rect:
    """Half-open on every axis: lower <= value < upper."""

    lower: tuple[float, ...]
    upper: tuple[float, ...]

    def contains(self, other: Rect) -> bool:
        return all(a <= b for a, b in zip(self.lower, other.lower, strict=True)) and all(b <= a for a, b in zip(self.upper, other.upper, strict=True))

    def intersects(self, other: Rect) -> bool:
        """Strict overlap; boxes that only touch don't intersect."""
        return all(max(a, c) < min(b, d) for a, b, c, d in zip(self.lower, self.upper, other.lower, other.upper, strict=True))

    def predicate(self, dims: list[str]) -> Column:
        """Plain comparisons, which Parquet scans take as pushed filters."""
        return reduce(lambda a, b: a & b, [(F.col(d) >= lo) & (F.col(d) < hi) for d, lo, hi in zip(dims, self.lower, self.upper, strict=True)])

    def cut(self, axis: int, at: float) -> tuple[Rect, Rect]:
        put = lambda t, v: (*t[:axis], v, *t[axis + 1 :])
        return Rect(self.lower, put(self.upper, at)), Rect(put(self.lower, at), self.upper)


@dataclass(frozen=True)
class Points:
    """Names of a point table's columns: row_id, dimensions (not null) and measures (null: missing)."""

    dims: tuple[str, ...]
    measures: tuple[str, ...]
    row_id: str = "row_id"


@dataclass(frozen=True)
class Target:
    """relative_error <= 0 asks for the exact answer."""

    relative_error: float = 0.0
    confidence: float = 0.95


@dataclass(frozen=True)
class Estimate:
    aggregate: str
    measure: str
    estimate: float
    ci_low: float
    ci_high: float
    relative_half_width: float
    effective_df: float
    exact: bool


def lifted(high: float) -> float:
    """The root's upper bound: the largest value must lie inside a half-open box."""
    return math.nextafter(high, math.inf)
