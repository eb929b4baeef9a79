"""KD trees over metadata: median splits for all data, or cracks along queries; a grid's tiles may be their roots.

The tree holds boxes and counts only. Points are never moved; a node is its
box's predicate, and all counts that a step needs come from one job.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import Rect


@dataclass
class Node:
    box: Rect
    population: int
    parent: int | None = None
    children: tuple[int, ...] | None = None
    cut: tuple[int, float] | None = None  # axis and first value of the right child


@dataclass
class Tree:
    points: DataFrame
    dims: list[str]
    threshold: int
    nodes: list[Node] = field(default_factory=list)

    def leaves(self, rect: Rect | None = None) -> list[int]:
        return [i for i, n in enumerate(self.nodes) if n.children is None and n.population and (rect is None or n.box.intersects(rect))]

    def box(self, i: int) -> Rect:
        return self.nodes[i].box

    def covering(self, rect: Rect, done=(), at: int = 0) -> list[int]:
        """Leaves that meet the rectangle; a node inside it that is done stands for all below it."""
        n = self.nodes[at]
        if not n.population or not n.box.intersects(rect):
            return []
        if n.children is None or at in done and rect.contains(n.box):
            return [at]
        return [i for c in n.children for i in self.covering(rect, done, c)]

    def tile(self, dims, rect: Rect | None = None, done=(), at: int = 0) -> Column:
        """A point's node as covering() gives it, only where the rectangle is: comparisons along a small tree, steps through arrays along a large one."""
        steps = self.steps(rect, done, at)
        if len(steps) > COMPARED:
            return self.walked(dims, steps, at)

        def compared(i: int) -> Column:
            if i not in steps:
                return F.lit(i).cast("long")
            axis, value, left, right = steps[i]
            return F.when(F.col(dims[axis]) < value, compared(left)).otherwise(compared(right))

        return compared(at)

    def steps(self, rect: Rect | None, done, at: int) -> dict[int, tuple[int, float, int, int]]:
        """axis, cut and children of the nodes to go on from."""
        out, todo = {}, [at]
        while todo:
            i = todo.pop()
            n = self.nodes[i]
            if n.children is None or rect and (not n.box.intersects(rect) or i in done and rect.contains(n.box)):
                continue
            out[i] = (*n.cut, *n.children)
            todo += n.children
        return out

    def walked(self, dims, steps: dict, at: int) -> Column:
        """The same by steps: an expression that doesn't grow with the tree but by its arrays, which are constants."""
        place = {i: k for k, i in enumerate(steps)}  # the steps' nodes are numbered; others are -1 - node
        depth, level = 0, [at]
        while level := [c for i in level if i in steps for c in steps[i][2:]]:
            depth += 1
        constant = lambda values, kind: F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")
        axis, cut = constant([s[0] for s in steps.values()], "int"), constant([float(s[1]) for s in steps.values()], "double")
        left, right = (constant([place.get(s[k], -1 - s[k]) for s in steps.values()], "long") for k in (2, 3))
        where = F.array(*[F.col(d).cast("double") for d in dims])
        go = lambda i: F.when(i < 0, i).when(F.get(where, F.get(axis, i.cast("int"))) < F.get(cut, i.cast("int")), F.get(left, i.cast("int"))).otherwise(F.get(right, i.cast("int")))
        return -1 - F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0).cast("long"), lambda i, _: go(i))

    def roll_up(self, known: dict, add) -> None:
        """known of every node whose children are all known: their sum, from the leaves up."""
        for i in reversed(range(len(self.nodes))):
            full = [c for c in self.nodes[i].children or () if self.nodes[c].population]
            if full and all(c in known for c in full):
                known[i] = add([known[c] for c in full])

    def refine(self, rect: Rect) -> list[int]:
        return self.crack(rect)

    def build(self, most: int = 64) -> Tree:
        """Median splits, axis by axis, of all leaves over the threshold; a row a node comes to the driver."""
        idle = 0
        for level in range(most):
            axis = level % len(self.dims)
            big = [i for i in self.leaves() if self.nodes[i].population > self.threshold]
            if not big or idle == len(self.dims):
                break
            placed = self.points.withColumn("part_id", self.tile(self.dims)).where(F.col("part_id").isin(big))
            pivots = medians(placed, self.dims[axis])
            left = placed.join(pivots, "part_id").where(F.col(self.dims[axis]) < F.col("pivot")).groupBy("part_id", "pivot").agg(F.count("*").alias("left"))
            made = [self.split(r["part_id"], axis, r["pivot"], r["left"]) for r in left.collect()]
            idle = 0 if any(made) else idle + 1
        return self

    def split(self, i: int, axis: int, at: float, left: int) -> tuple[int, int] | None:
        """Children below and from ``at`` on; nothing if one of them would be empty."""
        n = self.nodes[i]
        if not 0 < left < n.population or not n.box.lower[axis] < at < n.box.upper[axis]:
            return None
        for box, size in zip(n.box.cut(axis, at), (left, n.population - left), strict=True):
            self.nodes.append(Node(box, size, i))
        n.children, n.cut = (len(self.nodes) - 2, len(self.nodes) - 1), (axis, at)
        return n.children

    def crack(self, rect: Rect) -> list[int]:
        """Cut leaves over the threshold that the rectangle crosses: lower bounds axis by axis, then upper ones. Gives the retired nodes.

        One job counts each such leaf's points below, within and from each
        axis's bounds on; the cuts' sizes are sums of these.
        """
        open_ = [i for i in self.leaves(rect) if self.nodes[i].population > self.threshold and not rect.contains(self.nodes[i].box)]
        if not open_:
            return []
        zone = lambda d, lo, hi: F.when(F.col(d) < lo, 0).when(F.col(d) < hi, 1).otherwise(2)
        zones = [zone(d, lo, hi).alias(f"__z{a}") for a, (d, lo, hi) in enumerate(zip(self.dims, rect.lower, rect.upper, strict=True))]
        inside = self.points.select(self.tile(self.dims).alias("__leaf"), *zones).where(F.col("__leaf").isin(open_)) if len(open_) <= COMPARED else self.points.select(self.tile(self.dims).alias("__leaf"), *zones)
        counts: dict[int, dict[tuple, int]] = {i: {} for i in open_}
        for r in inside.groupBy("__leaf", *[f"__z{a}" for a in range(len(zones))]).agg(F.count("*").alias("n")).collect():  # a row a leaf and zone
            if r["__leaf"] in counts:
                counts[r["__leaf"]][tuple(r[1:-1])] = r["n"]
        retired = []
        for i in open_:
            at, cells = i, counts[i]
            for upper, axis in itertools.product((0, 1), range(len(self.dims))):
                if self.nodes[at].population <= self.threshold:
                    break
                value = (rect.upper if upper else rect.lower)[axis]
                below = {z: n for z, n in cells.items() if z[axis] < 1 + upper}
                children = self.split(at, axis, value, sum(below.values()))
                if children:
                    retired.append(at)
                    at, cells = (children[0], below) if upper else (children[1], {z: n for z, n in cells.items() if z not in below})
        return retired


COMPARED = 64  # cuts up to which a node is told by comparisons


class Forest(Tree):
    """Equal-width tiles whose insides are cut along the queries; node 0 holds the tiles and is never read itself."""

    def __init__(self, points: DataFrame, dims: list[str], threshold: int, grid):
        sizes = {r["t"]: r["n"] for r in points.groupBy(grid.tile(dims).alias("t")).agg(F.count("*").alias("n")).collect()}  # a row a tile
        tiles = grid.k ** len(dims)
        nodes = [Node(grid.bounds, sum(sizes.values()), None, tuple(range(1, tiles + 1)))]
        nodes += [Node(grid.box(t), sizes.get(t, 0), 0) for t in range(tiles)]
        super().__init__(points, dims, threshold, nodes)
        self.grid = grid

    def tile(self, dims, rect: Rect | None = None, done=(), at: int = 0) -> Column:
        tile = self.grid.tile(dims) + 1
        cut = [i for i in self.nodes[0].children if self.nodes[i].children and (rect is None or self.nodes[i].box.intersects(rect))]
        if not cut:
            return tile
        out = F.when(tile == cut[0], super().tile(dims, rect, done, cut[0]))
        for i in cut[1:]:
            out = out.when(tile == i, super().tile(dims, rect, done, i))
        return out.otherwise(tile)


def root(points: DataFrame, dims: list[str], threshold: int) -> Tree:
    from ..spec import lifted

    r = points.agg(F.count("*"), *[f(d) for d in dims for f in (F.min, F.max)]).first()
    box = Rect(tuple(float(v) for v in r[1::2]), tuple(lifted(float(v)) for v in r[2::2])) if r[0] else Rect((0.0,) * len(dims), (0.0,) * len(dims))
    return Tree(points, dims, threshold, [Node(box, r[0])])


SORTED, BINS = 100_000, 512  # rows of a partition that one task may sort; bins a step


def medians(points: DataFrame, dim: str, part: str = "part_id", sorted_rows: int = SORTED) -> DataFrame:
    """part, pivot: of each partition the value at place n // 2 of its sorted coordinates."""
    return order_statistics(points, dim, part, [lambda n: F.floor(n / 2)], sorted_rows).select(part, F.col("value").alias("pivot"))


def order_statistics(points: DataFrame, dim: str, part: str, places: list, sorted_rows: int = SORTED) -> DataFrame:
    """part, which, n, value: of each partition the values at places[which](n) from 0 of its n sorted values; nulls don't count.

    The bracket that a value lies in is parted into bins, which are counted
    before anything is shuffled; the bin that holds the place is the next
    bracket, until few enough rows are left in it for one task to sort.
    """
    own = "__part"
    spark, rows = points.sparkSession, points.select(F.col(part).alias(own), F.col(dim).cast("double").alias("x")).where("x IS NOT NULL")
    schema = f"{own} {dict(points.dtypes)[part]}, which int, n long, lo double, hi double, inside long, k long"
    first = rows.groupBy(own).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    which = F.explode(F.array(*[F.struct(F.lit(i).alias("which"), f(F.col("n")).cast("long").alias("k")) for i, f in enumerate(places)])).alias("w")
    state = [tuple(r) for r in first.select(own, "n", "lo", "hi", which).select(own, "w.which", "n", "lo", "hi", F.col("n").alias("inside"), "w.k").collect()]  # a row a partition and place
    while any(r[5] > sorted_rows and r[3] < r[4] for r in state):
        within = rows.join(F.broadcast(spark.createDataFrame(state, schema)), own).where("x BETWEEN lo AND hi")  # a row a partition and place
        bin_ = F.least(F.floor((F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS), F.lit(BINS - 1))
        bins = within.withColumn("bin", F.when(F.col("lo") < F.col("hi"), bin_).otherwise(0)).groupBy(own, "which", "n", "k", "bin").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("inside"))
        before = F.sum("inside").over(Window.partitionBy(own, "which").orderBy("bin")) - F.col("inside")  # at most BINS rows a partition and place
        held = bins.withColumn("before", before).where("before <= k AND k < before + inside")
        state = [tuple(r) for r in held.select(own, "which", "n", "lo", "hi", "inside", (F.col("k") - F.col("before")).alias("k")).collect()]
    brackets = spark.createDataFrame(state, schema)
    left = rows.join(F.broadcast(brackets), own).where("x BETWEEN lo AND hi AND lo < hi")
    ranked = left.withColumn("at", F.row_number().over(Window.partitionBy(own, "which").orderBy("x")) - 1).where("at = k")  # at most sorted_rows rows each
    found = ranked.select(own, "which", "n", F.col("x").alias("value")).union(brackets.where("lo = hi").select(own, "which", "n", F.col("lo").alias("value")))
    return found.withColumnRenamed(own, part)


def static_split(points: DataFrame, dims: list[str], threshold: int, most: int = 32) -> DataFrame:
    """points with part_id of a whole median tree: node i's children are 2i (below the pivot) and 2i + 1."""
    out = points.withColumn("part_id", F.lit(1).cast("long"))
    for level in range(most):
        dim = dims[level % len(dims)]
        sizes = out.groupBy("part_id").agg(F.count("*").alias("__size"), F.min(dim).alias("__low"), F.max(dim).alias("__high")).where(F.col("__size") > threshold)
        if sizes.isEmpty():
            break
        pivots = medians(out.join(sizes.select("part_id"), "part_id", "left_semi"), dim).join(sizes, "part_id").where("pivot > __low")
        out = out.join(pivots.select("part_id", "pivot"), "part_id", "left").withColumn(
            "part_id", F.when(F.col("pivot").isNull(), F.col("part_id")).otherwise(F.col("part_id") * 2 + (F.col(dim) >= F.col("pivot")).cast("long"))
        ).select(*points.columns, "part_id")
        if pivots.isEmpty():
            break
    return out
