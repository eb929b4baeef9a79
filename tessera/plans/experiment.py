"""Plans of experiments: axes multiplied out to the runs that make sense."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .runner import METHODS

CELL = "workload string, method string, substrate string, measures int, threshold int, resident boolean, replicate int, error_bound double, outlier_budget double, tiles int, queries int"


@dataclass
class Plan:
    """workloads: name -> (measures of its data set, queries); replicates of sampling methods; budgets: outlier budgets of single workloads."""

    workloads: dict[str, tuple[int, int]]
    methods: list[str]
    measures: list[int] = field(default_factory=lambda: [4])
    error_bounds: list[float] = field(default_factory=lambda: [0.01])
    thresholds: list[int] = field(default_factory=lambda: [1024])
    resident: list[bool] = field(default_factory=lambda: [True])
    replicates: int = 11
    outlier_budgets: list[float] = field(default_factory=lambda: [0.0])
    budgets: dict[str, list[float]] = field(default_factory=dict)
    tiles: int = 200
    max_queries: int = 0


def cells(plan: Plan) -> list[tuple]:
    """The runs of a plan. ValueError if it names unknown methods or workloads.

    A data set with fewer measures has no run for more; only sampling methods
    take error bounds, outlier budgets and replicates; a scan has one threshold,
    and only grids have tiles.
    """
    known = {m.name: m for m in METHODS}
    if bad := [m for m in plan.methods if m not in known]:
        raise ValueError(f"no such methods: {bad}")
    if bad := [w for w in plan.budgets if w not in plan.workloads]:
        raise ValueError(f"budgets for unknown workloads: {bad}")
    out = []
    for (name, (there, queries)), method in itertools.product(plan.workloads.items(), map(known.get, plan.methods)):
        near = method.approximate
        axes = (
            [m for m in plan.measures if m <= there], plan.thresholds[:1] if method.index == "scan" else plan.thresholds, plan.resident, range(plan.replicates if near else 1),
            plan.error_bounds if near else [0.0], plan.budgets.get(name, plan.outlier_budgets) if near else [0.0],
        )
        tiles = plan.tiles if method.index.startswith("grid") else 1
        asked = min(plan.max_queries, queries) if plan.max_queries else queries
        out += [(name, method.name, method.index, *cell, tiles, asked) for cell in itertools.product(*axes)]
    return out


def as_table(spark: SparkSession, plan: Plan) -> DataFrame:
    return spark.createDataFrame(cells(plan), CELL)
