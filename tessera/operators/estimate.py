"""Stratified estimates with intervals, and how many rows to read next."""

from __future__ import annotations

import math
from dataclasses import dataclass

from ..functions.quantiles import chi_squared_quantile, normal_quantile, t_quantile
from ..spec import Estimate, Target

Z95 = 1.959963984540054
PILOT = 32


@dataclass
class Stratum:
    """Of one measure: N rows in all, m read, n of them present, their sum and sum of squares."""

    N: int
    m: int = 0
    n: int = 0
    S: float = 0.0
    Q: float = 0.0


def presence(n: int, m: int) -> float:
    """The share of present rows for variances; at 0 and 1 the Wilson centre."""
    p = n / m
    return p if 0 < p < 1 else (n + Z95**2 / 2) / (m + Z95**2)


def interval(aggregate: str, measure: str, value: float, parts: list[tuple[float, int]], floor: float, confidence: float, known: bool, exact: bool) -> Estimate:
    """parts: each stratum's variance and its rows read."""
    total = sum(v for v, _ in parts)
    if not known:
        return Estimate(aggregate, measure, value, -math.inf, math.inf, math.inf, 0.0, False)
    if total <= 0 or not math.isfinite(total):
        return Estimate(aggregate, measure, value, value, value, 0.0, 0.0, exact)
    df = total**2 / sum(v * v / max(m - 1, 1) for v, m in parts if v > 0)
    half = t_quantile(0.5 + confidence / 2, df) * math.sqrt(total)
    return Estimate(aggregate, measure, value, value - half, value + half, half / max(abs(value), floor), df, False)


def estimate(strata: dict[str, list[Stratum]], count: int, exact: dict[str, tuple[float, int]], scale: float, confidence: float) -> list[Estimate]:
    """For each measure SUM, COUNT and AVG, then COUNT(*). exact: what is known without sampling; scale: the largest absolute global mean."""
    out = []
    for name, rows in strata.items():
        sum_, n_ = exact.get(name, (0.0, 0))
        variances, known, whole, size = [], True, True, 0
        for h in rows:
            if h.N <= 0:
                continue
            size += h.N
            if h.m >= h.N:
                sum_, n_ = sum_ + h.S, n_ + h.n
                continue
            whole = False
            if h.m < 2:
                known = False
                if h.m:
                    sum_, n_ = sum_ + h.N * h.S, n_ + h.N * h.n
                continue
            left, p = 1 - h.m / h.N, presence(h.n, h.m)
            spread = max(0.0, (h.Q - h.S**2 / h.m) / (h.m - 1))
            sum_, n_ = sum_ + h.N * h.S / h.m, n_ + h.N * h.n / h.m
            variances.append((h.N**2 * spread / h.m * left, h.N**2 * p * (1 - p) / (h.m - 1) * left, h.N**2 * h.S * (h.m - h.n) / (h.m**2 * (h.m - 1)) * left, h.m))
        mean = sum_ / n_ if n_ > 0 else math.nan
        ratio = [(max(0.0, (vs - 2 * mean * cov + mean**2 * vc) / n_**2), m) for vs, vc, cov, m in variances] if n_ > 0 else []
        out.append(interval("SUM", name, sum_, [(v[0], v[3]) for v in variances], 1e-6 * scale * size, confidence, known, whole))
        out.append(interval("COUNT", name, n_, [(v[1], v[3]) for v in variances], max(1.0, 1e-6 * size), confidence, known, whole))
        out.append(interval("AVG", name, mean, ratio, 1e-6 * scale, confidence, known, whole))
    out.append(Estimate("COUNT_STAR", "*", count, count, count, 0.0, 0.0, True))
    return out


def satisfied(found: list[Estimate], target: Target) -> bool:
    return all(e.exact or e.relative_half_width <= target.relative_error for e in found)


def worst(found: list[Estimate]) -> float:
    """The largest relative half-width of what isn't exact."""
    return max((e.relative_half_width for e in found if not e.exact), default=0.0)


def pilot(N: int, read: int = 0) -> int:
    return max(N if N <= 2 * PILOT else PILOT, min(read, N))


def neyman(sizes: list[int], spreads: list[float], budget: float) -> list[int]:
    """Rows of each stratum so that the estimate's variance is within budget; full strata leave and the rest is solved again."""
    out, open_ = [0] * len(sizes), [i for i, s in enumerate(spreads) if s > 0]
    while open_:
        a, b = sum(sizes[i] * spreads[i] for i in open_), sum(sizes[i] * spreads[i] ** 2 for i in open_)
        total = a * a / (budget + b)
        for i in open_:
            out[i] = min(sizes[i], math.ceil(total * sizes[i] * spreads[i] / a))
        still = [i for i in open_ if out[i] < sizes[i]]
        if len(still) == len(open_):
            break
        open_ = still
    return out


def plan(strata: dict[str, list[Stratum]], found: list[Estimate], target: Target, scale: float) -> list[int]:
    """Rows that each stratum should have read, over all measures and aggregates; never fewer than before (equal to that everywhere: no increase is asked for)."""
    z, doubt = normal_quantile(0.5 + target.confidence / 2), (1 - target.confidence) / 3
    by = {(e.aggregate, e.measure): e.estimate for e in found}
    first = next(iter(strata.values()))
    want = [pilot(h.N) if h.m < 2 else h.m for h in first]
    for name, rows in strata.items():
        total, n, mean = by["SUM", name], by["COUNT", name], by["AVG", name]
        floors = {"SUM": 1e-6 * scale * sum(h.N for h in rows), "COUNT": max(1.0, 1e-6 * sum(h.N for h in rows)), "AVG": 1e-6 * scale}
        demands = [("SUM", total, 1.0), ("COUNT", n, 1.0)] + ([("AVG", mean, n)] if n > 0 and math.isfinite(mean) else [])
        for what, value, factor in demands:
            spreads = []
            for h in rows:
                if not 2 <= h.m < h.N:
                    spreads.append(0.0)
                    continue
                wider = min(max((h.m - 1) / chi_squared_quantile(doubt, h.m - 1), 1.0), 4.0)
                if what == "COUNT":
                    p = presence(h.n, h.m)
                    spreads.append(math.sqrt(p * (1 - p)))
                    continue
                s, q = (h.S, h.Q) if what == "SUM" else (h.S - mean * h.n, h.Q - 2 * mean * h.S + mean**2 * h.n)
                spreads.append(math.sqrt(max(0.0, (q - s * s / h.m) / (h.m - 1)) * wider))
            budget = (target.relative_error * max(abs(value), floors[what]) / z) ** 2 * factor**2
            want = [max(w, k) for w, k in zip(want, neyman([h.N for h in rows], spreads, budget), strict=True)]
    return [min(max(w, h.m), h.N) for w, h in zip(want, first, strict=True)]
