"""Connected components of a graph given by its links, in Spark alone."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, lean, release, staged

HELD = 1 << 20  # links that a task contracts at once


def locally(links: DataFrame) -> DataFrame:
    """Links (a, b) of whole numbers with the same components, as stars: each task's links, a bounded number at once, by union-find."""

    def stars(held):
        a, b = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("a", "b"))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = np.arange(len(ids))
        x, y = at[: len(a)], at[len(a) :]
        while True:  # hook roots to smaller ones, then halve all paths
            rx, ry = root[x], root[y]
            low, high = np.minimum(rx, ry), np.maximum(rx, ry)
            open_ = low < high
            if not open_.any():
                break
            np.minimum.at(root, high[open_], low[open_])
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
        own = np.flatnonzero(root != np.arange(len(ids)))
        return batch(a=ids[root[own]], b=ids[own])

    def run(batches):
        held, n = [], 0
        for x in batches:
            held.append(x)
            n += x.num_rows
            if n > HELD:
                yield stars(held)
                held, n = [], 0
        if n:
            yield stars(held)

    return links.mapInArrow(lean(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, component: for every node of links (a, b), the smallest node that it reaches.

    Contraction: each round every node goes to one member of its closed
    neighbourhood, by turns the smallest and the one with the smallest hash
    (another hash each round, so chains shrink by a constant factor whatever
    their ids), and links between what is left go on. Links of numbers are
    first contracted within tasks, and once at most HELD are left, all in one
    task, which ends the rounds: each is a dozen stages, whose tasks the driver
    keeps a record of. Only minima are grouped by node, and they
    are pre-aggregated; a hub's links meet in joins, whose partitions Spark
    splits. No side is broadcast: the driver holds none of it.
    """
    numbers = dict(links.dtypes)["a"] == "bigint"
    first = links = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first = links = staged((locally(links) if numbers else links).distinct(), "links")
    steps, turn = [], 0
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    while n := links.count():
        if numbers and n <= HELD:
            steps.append(staged(locally(links.coalesce(1)).select(F.col("b").alias("node"), F.col("a").alias("next")), "step"))
            break
        rank = lambda c, turn=turn: F.struct((F.xxhash64(F.lit(turn), F.col(c)) if turn % 2 else F.lit(0).cast("long")).alias("h"), F.col(c).alias("v"))
        ends = links.select("a", rank("b").alias("to")).union(links.select("b", rank("a")))
        to = ends.groupBy(F.col("a").alias("node")).agg(F.min("to").alias("to")).select("node", F.least("to", rank("node")).alias("to")).select("node", F.col("to.v").alias("next"))
        to = staged(to, "step")
        steps.append(to)
        left = links.join(to.toDF("a", "a2").hint("merge"), "a").join(to.toDF("b", "b2").hint("merge"), "b").where("a2 <> b2")
        left = staged(left.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "links")
        if links is not first:
            release(links)
        links, turn = left, turn + 1
    found = nodes.withColumn("root", F.col("node"))
    for to in steps:
        found = found.join(to.toDF("root", "__next").hint("merge"), "root", "left").select("node", F.coalesce("__next", "root").alias("root"))
    found = staged(found, "roots")
    release(first, links, *steps)
    least = found.groupBy("root").agg(F.min("node").alias("component"))
    return found.join(least.hint("merge"), "root").select("node", "component")


def join_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, component) after more links: only components that these join are worked on."""
    name = lambda end: labels.toDF(end, f"{end}_of").hint("merge")
    named = links.select("a", "b").join(name("a"), "a", "left").join(name("b"), "b", "left")
    named = named.select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b")).where("a <> b")
    more = staged(components(named), "joined")
    old = labels.join(more.toDF("component", "__to").hint("merge"), "component", "left").select("node", F.coalesce("__to", "component").alias("component"))
    return old.union(more.join(labels.select("node").hint("merge"), "node", "left_anti"))
