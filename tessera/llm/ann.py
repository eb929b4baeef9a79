"""Approximate nearest neighbours: inverted lists scanned dimension block by block.

Vectors are assigned to the nearest of k centres, fitted on a bounded sample.
A query probes the lists of its nearest centres, as many as hold a share of
``RECALL`` of the sample's own nearest neighbours and a margin: the share of
lists is measured on the data, at every size alike. With ``exact`` a list is
left out only if the triangle inequality says that none of its vectors can be
near enough, and no candidate is abandoned on a guess, so nothing is missed.

Within a list, vectors are rotated by a fixed random rotation and held in
column blocks; a partial distance over the first d of D rotated dimensions,
scaled by D / d, estimates the whole one, and a candidate is abandoned as soon
as a hypothesis test says that it is farther than the query's bound. The bound
starts from the k-th nearest of the sample's rows in the lists probed, and
tightens as a block's rows are scanned, a run at a time. Survivors are measured
exactly, in double precision, on the original vectors.

Every vector is indexed and every query searched. Long lists are parted into
blocks of about ``BLOCK`` rows by hash, and the queries of a list into blocks
of ``ASKED``, so a centre that draws a third of all rows or queries is many
tasks; a query's best of each block are merged.

Defined cases: vectors that are null, zero, or hold a null or a value that is
not finite take no part, nor do those of another length than most, for a
distance to them isn't defined; ties go to the smaller id; repeated rows with
one id count each as candidates, but never for their own query, for which one
of them (the least by bytes) asks. Fewer candidates than k give all of them. An empty table gives no rows; extra
columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, release, staged

FIT, BOUND = 16384, 2048  # rows that centres are fitted on, and that first bounds are taken from
ROWS_A_LIST, MOST_LISTS = 100, 4096
RECALL, MARGIN, ASK = 0.97, 1.05, 512  # of the sample's neighbours; lists beyond those; sample rows that ask
BLOCK, ASKED, RUN = 4096, 1024, 512
COLUMNS = 16
EPSILON = 2.1


def usable(x: pa.RecordBatch, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors (float64) of the rows that take part."""
    ids, rows = [], []
    for i, v in zip(x.column("vec_id").to_pylist(), x.column("embedding").to_pylist(), strict=True):
        if i is not None and v and (dim is None or len(v) == dim) and None not in v:
            ids.append(i)
            rows.append(v)
    width = dim or (len(rows[0]) if rows else 0)
    m = np.array([r for r in rows if len(r) == width], np.float64).reshape(-1, width) if rows else np.zeros((0, width))
    ids = np.array([i for i, r in zip(ids, rows, strict=True) if len(r) == width], np.int64)
    ok = np.isfinite(m).all(1) & (m != 0).any(1)
    return ids[ok], m[ok]


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def centres(sample: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Lloyd's k-means; an empty centre moves to a random row."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        near = nearest(sample, c, 1)[:, 0]
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], sample[rng.integers(len(sample), size=k)])
    return c


def nearest(v: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each row, nearest first."""
    out = []
    norm = (c * c).sum(1)
    for i in range(0, len(v), 2048):
        d = norm - 2 * v[i : i + 2048] @ c.T
        if n == 1:
            out.append(np.argmin(d, 1)[:, None])
        else:
            top = np.argpartition(d, min(n, d.shape[1]) - 1, 1)[:, :n]
            out.append(np.take_along_axis(top, np.argsort(np.take_along_axis(d, top, 1), 1), 1))
    return np.concatenate(out) if out else np.zeros((0, n), np.int64)


def share_probed(sample: np.ndarray, c: np.ndarray, k: int, recall: float, margin: float = MARGIN) -> int:
    """How many lists hold so many of the k nearest neighbours, by rows of the sample that ask for theirs within it."""
    ask = np.random.default_rng(17).permutation(len(sample))[:ASK]
    lists = nearest(sample, c, 1)[:, 0]
    norm, ranks = (sample * sample).sum(1), []
    for i in range(0, len(ask), 64):
        some = ask[i : i + 64]
        d = norm - 2 * sample[some] @ sample.T
        d[np.arange(len(some)), some] = np.inf
        near = np.argpartition(d, min(k, len(sample) - 1) - 1, 1)[:, : min(k, len(sample) - 1)]
        order = np.argsort(np.argsort((c * c).sum(1) - 2 * sample[some] @ c.T, 1), 1)  # the rank of each list for each row
        ranks.append(np.take_along_axis(order, lists[near], 1).ravel())
    ranks = np.sort(np.concatenate(ranks))
    return min(len(c), int(np.ceil((ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))] + 1) * margin))) if len(ranks) else len(c)


def scan(query: np.ndarray, blocks: list[np.ndarray], tau: float, guess: bool = True) -> np.ndarray:
    """Places in the blocks of rotated columns that may be nearer than the root of tau: partial distances, then abandonment."""
    dim, n = sum(b.shape[1] for b in blocks), blocks[0].shape[0]
    alive, part, seen = np.arange(n), np.zeros(n), 0
    for b in blocks:
        own = b if len(alive) == n else b[alive]
        diff = own - query[seen : seen + b.shape[1]]
        part = part + np.einsum("ij,ij->i", diff, diff)
        seen += b.shape[1]
        if guess and seen < dim:
            stays = part * (dim / seen) <= tau * (1 + EPSILON / np.sqrt(seen)) ** 2
        else:
            stays = part <= tau
        alive, part = alive[stays], part[stays]
        if not len(alive):
            break
    return alive


def search(vectors: DataFrame, k: int = 10, every: int = 100, exact: bool = False, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each row whose id is divisible by ``every``."""
    spark, vectors = vectors.sparkSession, vectors.select("vec_id", "embedding")
    sample = pa.Table.from_pandas(vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT).toPandas())  # at most FIT rows
    out_schema = "query_id long, rank int, vec_id long, score double"
    batches = sample.combine_chunks().to_batches()
    sizes = [len(v) for x in batches for v in x.column("embedding").to_pylist() if v]
    if not sizes:
        return spark.createDataFrame([], out_schema)
    dim = int(np.bincount(sizes).argmax())
    ids, rows = (np.concatenate(c) for c in zip(*(usable(x, dim) for x in batches), strict=True))
    if not len(rows):
        return spark.createDataFrame([], out_schema)
    lists = int(np.clip(vectors.count() // ROWS_A_LIST, 1, min(MOST_LISTS, len(rows))))
    c = centres(rows, lists)
    probed = lists if exact else share_probed(rows, c, k, recall)
    bound, turn = rows[:BOUND], rotation(dim)
    held, bound_ids = nearest(bound, c, 1)[:, 0], ids[:BOUND]
    sent = spark.sparkContext.broadcast((c, bound, held, bound_ids, turn))  # at most FIT, BOUND and dim rows

    def values(m: np.ndarray) -> pa.Array:
        raw, step = m.astype(np.float64).tobytes(), 8 * dim
        return pa.array([raw[i : i + step] for i in range(0, len(raw), step)], pa.binary())

    def assign(batches):
        c = sent.value[0]
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                ids, m = usable(whole.slice(at, 4096), dim)
                list_ = nearest(m, c, 1)[:, 0]
                yield batch(list=list_.astype(np.int32), vec_id=ids, v=values(m), away=np.sqrt(((m - c[list_]) ** 2).sum(1)))

    indexed = staged(vectors.mapInArrow(assign, "list int, vec_id long, v binary, away double"), "lists")
    sizes = {r["list"]: (r["n"], r["away"]) for r in indexed.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect()}  # a row a list
    radius = spark.sparkContext.broadcast(np.array([sizes.get(i, (0, -np.inf))[1] for i in range(lists)]))

    def probe(batches):
        c, bound, held, bound_ids, _ = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                x = whole.slice(at, 256)
                ids, m = x.column("vec_id").to_numpy(), np.frombuffer(b"".join(x.column("v").to_pylist()), np.float64).reshape(-1, dim)
                near = nearest(m, c, probed)
                there = np.zeros((len(m), len(c)), bool)
                np.put_along_axis(there, near, True, 1)
                d = np.maximum(((bound * bound).sum(1) - 2 * m @ bound.T) + (m * m).sum(1)[:, None], 0)
                d[~there[:, held] | (bound_ids == ids[:, None])] = np.inf  # only rows that the query will meet bound it
                tau = np.partition(d, k - 1, 1)[:, k - 1] * (1 + 1e-9) + 1e-9 if len(bound) >= k else np.full(len(m), np.inf)
                if exact:
                    far = np.sqrt(np.maximum(((c * c).sum(1) - 2 * m @ c.T) + (m * m).sum(1)[:, None], 0))
                    meets = there & (far - radius.value <= np.sqrt(tau)[:, None] * (1 + 1e-6) + 1e-6)
                else:
                    meets = there
                q, list_ = np.nonzero(meets)
                raw = np.empty(len(m), object)
                raw[:] = values(m).to_pylist()
                yield batch(list=list_.astype(np.int32), query_id=ids[q], q=pa.array(raw[q].tolist(), pa.binary()), tau=tau[q])

    queries = indexed.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = staged(queries.mapInArrow(probe, "list int, query_id long, q binary, tau double"), "asked")
    wanted = {r["list"]: r["n"] for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row a list
    parts = [(i, -(-n // BLOCK), -(-wanted.get(i, 0) // ASKED)) for i, (n, _) in sizes.items() if wanted.get(i)]
    if not parts:
        return spark.createDataFrame([], out_schema)
    blocks = F.broadcast(spark.createDataFrame(parts, "list int, blocks int, asks int"))  # a row a list
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    one = lambda key, n, name: F.pmod(F.xxhash64(key), F.col(n)).cast("int").alias(name)
    left = indexed.join(blocks, "list").select("list", one("vec_id", "blocks", "block"), each("asks", "ask"), "vec_id", "v")
    right = asked.join(blocks, "list").select("list", each("blocks", "block"), one("query_id", "asks", "ask"), "query_id", "q", "tau")

    def within(own: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if own.num_rows and asked.num_rows:
            r = sent.value[4]
            m = np.frombuffer(b"".join(own.column("v").to_pylist()), np.float64).reshape(-1, dim)
            turned = m @ r
            cols = [np.ascontiguousarray(turned[:, i : i + COLUMNS]) for i in range(0, dim, COLUMNS)]
            ids = own.column("vec_id").to_numpy()
            q = np.frombuffer(b"".join(asked.column("q").to_pylist()), np.float64).reshape(-1, dim)
            q_turned = q @ r
            for i, (query, tau) in enumerate(zip(asked.column("query_id").to_pylist(), asked.column("tau").to_pylist(), strict=True)):
                best_id, best = np.zeros(0, np.int64), np.zeros(0)
                for a in range(0, len(m), RUN):
                    near = a + scan(q_turned[i], [x[a : a + RUN] for x in cols], tau * (1 + 1e-9) + 1e-9, not exact)
                    near = near[ids[near] != query]
                    if not len(near):
                        continue
                    best_id, best = np.concatenate([best_id, ids[near]]), np.concatenate([best, np.sqrt(((m[near] - q[i]) ** 2).sum(1))])
                    if len(best) >= k:
                        top = np.lexsort((best_id, best))[:k]
                        best_id, best = best_id[top], best[top]
                        tau = min(tau, best[-1] ** 2)  # nothing farther than the k-th so far
                top = np.lexsort((best_id, best))[:k]
                found.append((np.full(len(top), query), best_id[top], best[top]))
        query, ids, score = (np.concatenate(f) for f in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.float64())})

    key = ("list", "block", "ask")
    best = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(within, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    out = staged(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")
    release(indexed, asked)
    sent.destroy()
    radius.destroy()
    return out
