"""Run methods over a workload; a row for each aggregate of each query."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..operators.grid import Grid
from ..operators.kd import Forest, root
from ..spec import Points, Rect, Target
from .engine import Engine

SCHEMA = (
    "method string, replicate int, query_ordinal long, lower array<double>, upper array<double>, error_bound double, confidence double, "
    "measure string, aggregate string, estimate double, ci_low double, ci_high double, relative_half_width double, effective_df double, exact boolean, "
    "status string, rounds int, rows_read long, measure_reads long, init_ms double, latency_ms double, "
    "sampled_rows long, exactified_rows long, outlier_rows long, frontier_partitions long, partitions_refined long, exact_contributors long, "
    "reusable_sampled_strata long, reusable_absent_strata long, query_local_strata long, exactify_cause string, pre_exactification_error_bound double"
)
COUNTERS = ("sampled_rows", "exactified_rows", "outlier_rows", "frontier_partitions", "partitions_refined", "exact_contributors", "reusable_sampled_strata", "reusable_absent_strata", "query_local_strata", "exactify_cause", "pre_exactification_error_bound")


@dataclass(frozen=True)
class Method:
    """index: scan (one stratum), grid, kd (median splits), akd (cut by the queries) or grid_akd (tiles cut by the queries inside)."""

    name: str
    index: str
    persist: bool
    approximate: bool


METHODS = [
    Method("scan", "scan", False, False),
    *[Method(f"{i}{'_agg' if keep else ''}{'_approx' if near else ''}", i, keep, near) for i in ("grid", "kd", "akd", "grid_akd") for keep in (False, True) for near in (False, True)],
]


def engine(points: DataFrame, spec: Points, domain: Rect, method: Method, k: int = 8, threshold: int = 1024, held_share: float = 0.0, run_id: int = 0, eager: bool = True) -> Engine:
    """eager: an index that is built and keeps summaries reads them all at once, where the method is exact."""
    if method.index in ("scan", "grid"):
        parts = Grid(domain, 1 if method.index == "scan" else k)
    elif method.index == "grid_akd":
        parts = Forest(points, list(spec.dims), threshold, Grid(domain, k))
    else:
        parts = root(points, list(spec.dims), threshold)
        if method.index == "kd":
            parts.build()
    built = method.index in ("grid", "kd")
    return Engine(points, spec, parts, method.persist, held_share, run_id=run_id, eager=eager and built and method.persist and not method.approximate)


def run(points: DataFrame, spec: Points, domain: Rect, rects: list[Rect], methods: list[Method], target: Target, replicates: int = 1, resident: bool = False, **options) -> DataFrame:
    """Only rows of results are held by the driver. Exact methods run once, sampling ones ``replicates`` times.

    resident: points are kept in the executors' memory and on their disks for all methods; results are the same.
    """
    rows = []
    if resident:
        points = points.persist(StorageLevel.MEMORY_AND_DISK)
    for method in methods:
        aim = target if method.approximate else Target(0.0, target.confidence)
        for rep in range(replicates if method.approximate else 1):
            began = time.perf_counter()
            e = engine(points, spec, domain, method, run_id=rep, **options)
            init = (time.perf_counter() - began) * 1e3
            for i, rect in enumerate(rects):
                began = time.perf_counter()
                got = e.execute(rect, aim)
                took = (time.perf_counter() - began) * 1e3
                head = (method.name, rep, i, list(map(float, rect.lower)), list(map(float, rect.upper)), aim.relative_error, aim.confidence)
                tail = (got.status, got.rounds, got.rows_read, got.measure_reads, init, took, *[getattr(got, c) for c in COUNTERS])
                rows += [(*head, x.measure, x.aggregate, float(x.estimate), float(x.ci_low), float(x.ci_high), float(x.relative_half_width), float(x.effective_df), x.exact, *tail) for x in got.estimates]
    if resident:
        points.unpersist()
    return points.sparkSession.createDataFrame(rows, SCHEMA)
