"""Rectangles to ask for: centres over the domain, the data or a focus, sides for a wanted selectivity."""

from __future__ import annotations

import json
import random
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sampling import rank_hash
from ..spec import Points, Rect

RESERVOIR, STEPS, TOLERANCE = 65536, 20, 0.2


@dataclass(frozen=True)
class Workload:
    """kind: random or clustered (about focus); calibrated ones follow a sample of the data."""

    queries: int
    selectivity: float
    kind: str = "random"
    focus: tuple[float, ...] = ()
    calibrated: bool = True
    seed: int = 0


def fingerprint(spec: Workload, domain: Rect) -> int:
    """64-bit FNV-1a of all that a workload depends on."""
    out = 0xCBF29CE484222325
    for b in json.dumps([asdict(spec), domain.lower, domain.upper], sort_keys=True).encode():
        out = (out ^ b) * 0x100000001B3 % (1 << 64)
    return out


def around(centre, sides, domain: Rect) -> Rect:
    """A rectangle of these sides, moved inward where it would leave the domain."""
    low = [min(max(c - s / 2, a), max(a, b - s)) for c, s, a, b in zip(centre, sides, domain.lower, domain.upper, strict=True)]
    return Rect(tuple(low), tuple(min(x + s, b) for x, s, b in zip(low, sides, domain.upper, strict=True)))


def fraction(sample: list[tuple[float, ...]], rect: Rect) -> float:
    return sum(all(a <= v < b for v, a, b in zip(row, rect.lower, rect.upper, strict=True)) for row in sample) / max(len(sample), 1)


def calibrated(centre, spec: Workload, domain: Rect, sample: list[tuple[float, ...]]) -> Rect:
    """The share of each axis is halved towards the wanted selectivity; the closest rectangle met is taken."""
    low, high, best, off = 0.0, 1.0, None, float("inf")
    for _ in range(STEPS):
        share = (low + high) / 2
        rect = around(centre, [(b - a) * share for a, b in zip(domain.lower, domain.upper, strict=True)], domain)
        got = fraction(sample, rect)
        if abs(got - spec.selectivity) < off:
            best, off = rect, abs(got - spec.selectivity)
        if off <= TOLERANCE * spec.selectivity / 10:
            break
        low, high = (share, high) if got < spec.selectivity else (low, share)
    return best


def generate(points: DataFrame, dims: Points, domain: Rect, spec: Workload, reservoir: int = RESERVOIR) -> list[Rect]:
    """The rectangles; a calibrated workload takes ``reservoir`` rows, the first by rank, to the driver."""
    rng, extent = random.Random(spec.seed), [b - a for a, b in zip(domain.lower, domain.upper, strict=True)]
    sample = []
    if spec.calibrated:
        sample = [tuple(r) for r in points.orderBy(rank_hash(F.col(dims.row_id)), dims.row_id).limit(reservoir).select(*dims.dims).collect()]
    order = rng.sample(sample, len(sample))
    side = spec.selectivity ** (1 / len(extent))
    out = []
    for i in range(spec.queries):
        if spec.kind == "clustered":
            centre = [min(max(rng.gauss(f, 0.05 * e), a), b) for f, e, a, b in zip(spec.focus, extent, domain.lower, domain.upper, strict=True)]
        elif order:
            centre = order[i % len(order)]
        else:
            centre = [rng.uniform(a, b) for a, b in zip(domain.lower, domain.upper, strict=True)]
        out.append(calibrated(centre, spec, domain, sample) if sample else around(centre, [e * side for e in extent], domain))
    return out


def as_table(spark: SparkSession, rects: list[Rect]) -> DataFrame:
    rows = [(i, [float(v) for v in r.lower], [float(v) for v in r.upper]) for i, r in enumerate(rects)]
    return spark.createDataFrame(rows, "query_ordinal long, lower array<double>, upper array<double>")


def save(spark: SparkSession, rects: list[Rect], stamp: int, path: str, overwrite: bool = False) -> None:
    """One text file under ``path``: the fingerprint, a header naming each bound, a row a rectangle."""
    n = len(rects[0].lower) if rects else 0
    head = ",".join([f"{end}_{i}" for end in ("lower", "upper") for i in range(n)])
    lines = [f"fingerprint={stamp}", head, *[",".join(f"{float(v)!r}" for v in (*r.lower, *r.upper)) for r in rects]]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite" if overwrite else "error").text(path)


def load(spark: SparkSession, path: str) -> tuple[int, list[Rect]]:
    """The fingerprint and the rectangles (as many as a workload has, so held by the driver)."""
    texts = spark.read.text(path, wholetext=True).collect()
    lines = "".join(r["value"] for r in texts).splitlines()
    n = sum(c.startswith("lower_") for c in lines[1].split(",")) if len(lines) > 1 else 0
    if not n or not lines[0].startswith("fingerprint="):
        raise ValueError(f"{path} needs a fingerprint and a header with lower_ columns")
    rows = [[float(v) for v in line.split(",")] for line in lines[2:] if line]
    if any(len(r) != 2 * n for r in rows):
        raise ValueError(f"{path}: each row needs {2 * n} values")
    return int(lines[0].removeprefix("fingerprint=")), [Rect(tuple(r[:n]), tuple(r[n:])) for r in rows]
