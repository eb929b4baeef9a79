"""Answer a rectangle exactly, or to a relative error by rounds of stratified samples.

Strata are grid tiles, the leaves of a KD tree, or of trees inside the tiles of
a grid; built at once or cut along the queries: an expression of the
dimensions. What is known of a stratum that lies inside the rectangle is kept
for later queries: its size, its outliers (added exactly, once), and the sums
over the rows read so far, whole or a sample that later rounds go on from. A
stratum that was read whole stays an answer for its box when it is cut; a
sample is dropped then.

A row's rank is a fixed hash of its id, and a stratum's sample is its rows
below a bound, so it grows without being drawn again and, given its size, is a
simple random sample. A round is one job that filters by rank and sums up
before anything is shuffled; a row a stratum comes to the driver. Strata that
the rectangle cuts, or whose outliers aren't known, are counted in the first
round's job. ``clustered`` writes points by tile and rank, so that a scan skips
what a round doesn't ask for.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sampling import STREAM, rank_hash
from ..operators.estimate import Stratum, estimate, pilot, plan, satisfied, worst
from ..operators.exact import exact_scan
from ..operators.grid import Grid
from ..operators.kd import Tree
from ..operators.outliers import held_out
from ..spec import Estimate, Points, Rect, Target

ROUNDS = 4
ALL = 1 << 32  # ranks are below it
LOOKED_UP = 50_000  # the largest stratum's number up to which bounds are constants of the job


@dataclass
class Known:
    """What is known of a stratum: of each measure a Stratum of the rows below the bound, and the outliers' sum and count."""

    N: int
    bound: int
    strata: dict[str, Stratum]
    outliers: int = 0
    held: dict[str, tuple[float, int]] = field(default_factory=dict)

    @property
    def whole(self) -> bool:
        return self.bound >= ALL


@dataclass
class Result:
    estimates: list[Estimate]
    status: str
    rounds: int
    rows_read: int
    sampled_rows: int = 0
    exactified_rows: int = 0
    outlier_rows: int = 0
    measure_reads: int = 0
    frontier_partitions: int = 0
    partitions_refined: int = 0
    exact_contributors: int = 0
    reusable_sampled_strata: int = 0
    reusable_absent_strata: int = 0
    query_local_strata: int = 0
    exactify_cause: str = "none"
    pre_exactification_error_bound: float | None = None


def bound_for(want: int, of: int) -> int:
    """A rank that about so many of a stratum's rows are below, and some more."""
    return ALL if want >= of else min(ALL, math.ceil((want + 2 * math.sqrt(want)) / of * ALL))


@dataclass
class Engine:
    points: DataFrame
    spec: Points
    grid: Grid | Tree
    persist: bool = True
    held_share: float = 0.0
    run_id: int = 0
    rounds: int = ROUNDS
    stored: tuple[str, str] | None = None  # columns that hold a row's tile of the grid and its rank, as clustered() writes them
    eager: bool = False  # read all strata at once, before the first query; with persist and an index that is built
    known: dict[int, Known] = field(default_factory=dict)

    def __post_init__(self):
        spec = self.spec
        if self.stored and (isinstance(self.grid, Tree) or self.run_id):
            raise ValueError("stored tiles and ranks are those of a grid and of run 0")
        self.held = held_out(self.points, list(spec.measures), self.held_share, spec.row_id) if self.held_share > 0 else F.lit(False)
        sums = [f for m in spec.measures for f in (F.sum(m), F.count(m))]
        if isinstance(self.grid, Tree):
            self.sizes = None
            rows = self.points.agg(*sums).collect()
        else:
            rows = self.points.groupBy(self._tile().alias("__tile")).agg(*sums, F.count("*").alias("__N")).collect()  # a row a tile
            self.sizes, rows = {r["__tile"]: r["__N"] for r in rows}, [r[1:] for r in rows]
        totals = [sum(r[i] or 0 for r in rows) for i in range(len(sums))]
        #: The largest absolute mean of a measure.
        self.scale = max([abs(s / n) for s, n in zip(totals[::2], totals[1::2], strict=True) if n], default=0.0)
        if self.eager and self.persist:
            self.materialise()

    @property
    def summaries(self) -> set[int]:
        return {t for t, k in self.known.items() if k.whole}

    def _tile(self, rect: Rect | None = None, done=()):
        return F.col(self.stored[0]) if self.stored else self.grid.tile(self.spec.dims, rect, done)

    def population(self, tile: int) -> int:
        return self.grid.nodes[tile].population if self.sizes is None else self.sizes.get(tile, 0)

    def materialise(self) -> None:
        """Read every stratum whole in one job, and add those of a tree up into their parents, which read nothing."""
        rows = self.points.withColumn("__tile", self._tile()).withColumn("__held", self.held)
        tiles = self.grid.leaves() if self.sizes is None else list(self.sizes)
        self.known = self._read(rows, {t: (0, ALL) for t in tiles}, set(tiles), {})
        self.read_values = 0  # counted for queries only
        if self.sizes is None:
            self.grid.roll_up(self.known, added)

    def execute(self, rect: Rect, target: Target = Target()) -> Result:
        spec, exact_only = self.spec, target.relative_error <= 0
        retired = self.grid.refine(rect)
        for t in retired:
            if t in self.known and not self.known[t].whole:
                del self.known[t]
        cover = [t for t in self.grid.covering(rect, self.summaries) if self.population(t)]
        inside = {t for t in cover if rect.contains(self.grid.box(t))}
        done = self.summaries
        state = {t: self.known[t] for t in inside if t in self.known}
        out = Result([], "", 0, 0, frontier_partitions=len(cover), partitions_refined=len(retired))
        out.exact_contributors = sum(k.whole for k in state.values())
        out.reusable_sampled_strata = len(state) - out.exact_contributors
        out.reusable_absent_strata, out.query_local_strata = len(inside) - len(state), len(cover) - len(inside)
        rows = self.points.where(rect.predicate(list(spec.dims))).withColumn("__tile", self._tile(rect, done)).withColumn("__held", self.held)
        if self.held_share <= 0:  # there is nothing to count in strata inside
            none = {m: (0.0, 0) for m in spec.measures}
            state = {t: state.get(t) or Known(n := self.population(t), 0, {m: Stratum(n) for m in spec.measures}, 0, none) for t in inside}

        def step(ask: dict[int, tuple[int, int]], fresh: set[int]) -> None:
            """Read so far as asked, and count what was read."""
            before = {t: next(iter(state[t].strata.values())).m if t in state else 0 for t in ask}
            state.update(self._read(rows, ask, fresh, state))
            out.rounds += 1
            for t in ask:
                if t in state:
                    n = next(iter(state[t].strata.values())).m - before[t]
                    out.sampled_rows, out.exactified_rows = (out.sampled_rows, out.exactified_rows + n) if state[t].whole else (out.sampled_rows + n, out.exactified_rows)
            out.outlier_rows += sum(state[t].outliers for t in fresh if t in state)

        def estimates() -> list[Estimate]:
            part = {m: [k.strata[m] for k in state.values() if not k.whole] for m in spec.measures}
            whole = [k for k in state.values() if k.whole]
            exact = {m: (sum(k.strata[m].S for k in whole) + sum(k.held[m][0] for k in state.values()), sum(k.strata[m].n for k in whole) + sum(k.held[m][1] for k in state.values())) for m in spec.measures}
            return estimate(part, sum(k.N + k.outliers for k in state.values()), exact, self.scale, target.confidence)

        fresh = {t for t in cover if t not in state}  # their outliers aren't counted yet, so they are read whatever is known
        if exact_only:
            ask = {t: (state[t].bound if t in state else 0, ALL) for t in cover if t not in state or not state[t].whole}
        else:
            start = lambda t: bound_for(pilot(n := self.population(t)), max(round(n * self._share(t, rect)), 1))
            ask = {t: (0, start(t)) for t in cover if t in fresh or not state[t].bound}
        if ask:
            step(ask, fresh)
        found = estimates()
        while not exact_only and not satisfied(found, target):
            left = {t: k for t, k in state.items() if not k.whole}
            if not left:
                break
            if out.rounds + 1 >= self.rounds:
                out.exactify_cause, out.pre_exactification_error_bound = "gave_up", worst(found)
                want = {t: k.N for t, k in left.items()}
            else:
                want = dict(zip(left, plan({m: [k.strata[m] for k in left.values()] for m in spec.measures}, found, target, self.scale), strict=True))
            ask = {t: (k.bound, max(k.bound, bound_for(want[t], k.N))) for t, k in left.items()}
            ask = {t: b for t, b in ask.items() if b[1] > b[0]}
            if not ask:  # nothing more is planned, so the rest has to be read
                ask = {t: (k.bound, ALL) for t, k in left.items()}
            step(ask, set())
            found = estimates()
        if self.persist:
            self.known |= {t: state[t] for t in inside if t in state}
        out.estimates = found
        whole = all(k.whole for k in state.values())
        out.status = "exact" if exact_only else "exactified" if whole and out.exactified_rows else "converged" if satisfied(found, target) else "exhausted_unconverged"
        out.rounds = 0 if exact_only else out.rounds
        out.rows_read = out.sampled_rows + out.exactified_rows + out.outlier_rows
        out.measure_reads = self.read_values
        self.read_values = 0
        return out

    read_values: int = 0

    def _share(self, tile: int, rect: Rect) -> float:
        """The share of a stratum's box that the rectangle takes."""
        box, share = self.grid.box(tile), 1.0
        for a, b, lo, hi in zip(box.lower, box.upper, rect.lower, rect.upper, strict=True):
            share *= (min(b, hi) - max(a, lo)) / (b - a) if 0 < b - a < math.inf else 1.0
        return max(share, 0.0)

    def _asked(self, rows: DataFrame, ask: dict[int, tuple[int, int]]) -> DataFrame:
        """The rows of the strata asked for, with the ranks __from and __to: looked up in arrays, which need no job, or joined if these would be long."""
        if max(ask) > LOOKED_UP:
            todo = [(t, a, b) for t, (a, b) in ask.items()]
            return rows.join(F.broadcast(self.points.sparkSession.createDataFrame(todo, "__tile long, __from long, __to long")), "__tile")  # a row a stratum
        array = lambda k: F.split(F.lit(",".join(str(ask[t][k]) if t in ask else "-1" for t in range(max(ask) + 1))), ",").cast("array<bigint>")
        at = F.col("__tile").cast("int")
        return rows.withColumn("__from", F.get(array(0), at)).where("__from >= 0").withColumn("__to", F.get(array(1), at))

    def _read(self, rows: DataFrame, ask: dict[int, tuple[int, int]], fresh: set[int], state: dict[int, Known]) -> dict[int, Known]:
        """Strata after reading the ranks from .. to of each one asked for; those that are fresh are counted as well."""
        if not ask:
            return {}
        spec = self.spec
        rank = F.col(self.stored[1]) if self.stored else rank_hash(F.col(spec.row_id), STREAM ^ self.run_id)
        if self.stored:  # plain comparisons, which the scan takes
            below = rank < max(b for _, b in ask.values())
            rows = rows.where(F.col(self.stored[0]).isin(list(ask)) & (F.col(self.stored[0]).isin(list(fresh)) | below if fresh else below))
        taken = ~F.col("__held") & (rank >= F.col("__from")) & (rank < F.col("__to"))
        whole = all(a == 0 and b == ALL for a, b in ask.values())
        marked = self._asked(rows, ask).withColumn("__taken", ~F.col("__held") if whole else taken)
        if not fresh:
            marked = marked.where("__taken")
        v = lambda m, flag: F.when(F.col(flag), F.col(m))
        sums = [f for m in spec.measures for f in (
            F.count(v(m, "__taken")).alias(f"n_{m}"), F.coalesce(F.sum(v(m, "__taken")), F.lit(0.0)).alias(f"S_{m}"), F.coalesce(F.sum(v(m, "__taken") * F.col(m)), F.lit(0.0)).alias(f"Q_{m}"),
            F.count(v(m, "__held")).alias(f"hn_{m}"), F.coalesce(F.sum(v(m, "__held")), F.lit(0.0)).alias(f"hS_{m}"), F.count_if(F.col("__taken") | F.col("__held")).alias(f"reads_{m}"),
        )]
        out = {}
        for r in marked.groupBy("__tile").agg(F.count_if(~F.col("__held")).alias("N"), F.count_if("__held").alias("held"), F.count_if("__taken").alias("m"), *sums).collect():
            t = r["__tile"]
            self.read_values += sum(r[f"reads_{m}"] for m in spec.measures)
            had = state.get(t)
            N = r["N"] if t in fresh else had.N
            strata = {}
            for m in spec.measures:
                h = had.strata[m] if had else Stratum(N)
                strata[m] = Stratum(N, h.m + r["m"], h.n + r[f"n_{m}"], h.S + r[f"S_{m}"], h.Q + r[f"Q_{m}"])
            held = {m: (r[f"hS_{m}"], r[f"hn_{m}"]) for m in spec.measures} if t in fresh else had.held
            bound = ALL if r["m"] + (next(iter(had.strata.values())).m if had else 0) >= N else ask[t][1]
            out[t] = Known(N, bound, strata, r["held"] if t in fresh else had.outliers, held)
        for t, (_, to) in ask.items():  # strata in which nothing was found
            if t not in out and t in state:
                k = state[t]
                out[t] = Known(k.N, to, k.strata, k.outliers, k.held)
        return out


def clustered(points: DataFrame, spec: Points, grid: Grid, path: str, stored: tuple[str, str] = ("tile", "rank"), **options) -> None:
    """points with each row's tile and rank, written in their order."""
    from ..sources.prepare import write

    rows = points.withColumn(stored[0], grid.tile(spec.dims)).withColumn(stored[1], rank_hash(F.col(spec.row_id), STREAM))
    write(rows, path, cluster=list(stored), **options)


def added(parts: list[Known]) -> Known:
    """What is known of disjoint strata together, all read whole."""
    names = parts[0].strata
    put = lambda m: Stratum(*(sum(getattr(k.strata[m], f) for k in parts) for f in ("N", "m", "n", "S", "Q")))
    held = {m: (sum(k.held[m][0] for k in parts), sum(k.held[m][1] for k in parts)) for m in names}
    return Known(sum(k.N for k in parts), ALL, {m: put(m) for m in names}, sum(k.outliers for k in parts), held)


def scan(points: DataFrame, spec: Points, rect: Rect) -> DataFrame:
    return exact_scan(points, spec, rect)
