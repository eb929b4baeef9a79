"""N-gram Jaccard join: which documents' shingle sets are alike, exactly.

1. Tokens (shingle hashes) get one order for all documents: rare first, by a
   table of counts of fixed size over all shingles, then by hash.
2. Two sets with 100 * |x & y| >= t * |x | y| share a token among the first
   n - ceil(t * n / 100) + 1 of each (prefix filter). These go out by token.
   Sets that are equal within a run of a task's input go out once.
3. The documents of a token make a tile. Tiles of up to ``SMALL`` sets give
   their pairs of like size, so at most a constant number a row; a pair goes on
   if it shares enough of its prefixes for the overlap it needs. Larger tiles
   are named by their first document (a group of near copies shares most of
   its tiles) and parted into bands of sizes, a band into blocks of bounded
   rows and bytes; blocks of one band and of neighbouring ones are held against
   each other: first each by itself and against the first block of its own and
   the next band, which joins most of a group of copies, then those pairs of
   blocks whose documents aren't all of one component yet.
4. Sets are compared by bitmaps of at least twice as many bits as the set has
   elements (a bit is the parity of the elements hashed to it): the bits
   that differ bound the overlap from above.
5. What passes is intersected exactly, as sorted arrays, from the whole texts.
   Within a pair of blocks only documents that aren't joined yet are tried, so
   its links are a spanning forest: copies cost a row each, not a row a pair.

Tokens are 64-bit hashes. Defined cases: a null or empty text has an empty set
and no links, an empty table gives no rows; a row without an id has no
component; rows with equal ids are one node (a link of one is a link of it),
each with its own set's size. Very long texts count whole, their bitmaps have
at most ``MOST_BITS`` bits. Extra columns aren't read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, chunks, lean, marked, marks, partitions, release, small_batches, staged
from .components import components, join_components
from .textvec import each, mix

WORDS, PERCENT = 4, 85
CELLS = 1 << 20
SMALL, MOST_BITS = 16, 1 << 18
BLOCK_ROWS, BLOCK_BYTES = 512, 8 << 20  # a block's sets, and what their elements take
CHUNK = 1 << 13  # rows of a tile that a task holds at once
RUN_BYTES = 32 << 20  # texts between which a task looks for equal sets
_OTHER = np.uint64(0x9FB21C651E98DF25)


def shingle_sets(texts: pa.Array, w: int):
    """For each text, the sorted array of its distinct shingles' hashes."""
    for _, _, words in each(texts, lower=True):
        sh, soffs = words.shingles(w)
        for d, n in enumerate(words.counts()):
            if n >= w:
                yield np.unique(sh[soffs[d] : soffs[d + 1]])
            else:
                yield np.array([words.whole(d)] if n else [], np.uint64)


def shingle_counts(docs: DataFrame, w: int, cells: int = CELLS) -> np.ndarray:
    """How many shingles of all documents fall to each of a fixed number of cells."""
    shift, block = np.uint64(64 - (cells.bit_length() - 1)), cells // 16

    def count(batches):
        total = np.zeros(cells, np.int64)
        for x in batches:
            for _, _, words in each(x.column("text"), lower=True):
                total += np.bincount((words.shingles(w)[0] >> shift).astype(np.int64), minlength=cells)
        yield batch(cell=np.arange(cells // block, dtype=np.int32), counts=[zlib.compress(total[i : i + block].astype("<i8").tobytes(), 1) for i in range(0, cells, block)])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for x in batches:
            for cell, counts in zip(x.column("cell").to_pylist(), x.column("counts"), strict=True):
                total[cell] = total.get(cell, 0) + np.frombuffer(zlib.decompress(counts.as_py()), "<i8")
        yield batch(cell=pa.array(list(total), pa.int32()), counts=pa.array([t.tobytes() for t in total.values()], pa.binary()))

    parts = docs.mapInArrow(lean(count), "cell int, counts binary").repartition(16, "cell").mapInArrow(lean(add), "cell int, counts binary")
    out = np.zeros(cells, np.int64)
    for r in parts.collect():  # cells * 8 bytes, whatever the input
        out[r["cell"] * block : (r["cell"] + 1) * block] = np.frombuffer(r["counts"], "<i8")
    return out


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts on a scale of 256 steps, six for each doubling."""
    return np.minimum(6 * np.log2(counts + 1), 255).astype(np.uint8)


def prefixes(docs: DataFrame, sent, w: int, percent: int) -> DataFrame:
    """kind 0: token, doc, n, print of the prefix tokens; 1: doc and an equal set's doc (in print); 2: doc and n."""
    shift = np.uint64(64 - (len(sent.value).bit_length() - 1))

    def run(batches):
        level, seen, size = sent.value, {}, 0
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                x = whole.slice(at, 512)
                out = []
                for doc, s in zip(x.column("doc_id").to_pylist(), shingle_sets(x.column("text"), w), strict=True):
                    n = len(s)
                    out.append((np.full(1, 2, np.int8), [doc], [n], [0], mix(np.array([hash(doc) & (1 << 62) - 1], np.uint64))))
                    if not n or doc is None:
                        continue
                    size += 8 * n
                    print1 = mix(s).sum(dtype=np.uint64)
                    key = (int(print1), int(mix(s ^ _OTHER).sum(dtype=np.uint64)), n)
                    if (first := seen.setdefault(key, doc)) != doc:
                        out.append((np.ones(1, np.int8), [doc], [n], [first], mix(np.array([doc & (1 << 62) - 1], np.uint64))))
                        continue
                    k = n - -(-percent * n // 100) + 1
                    order = np.sort(level[(s >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(56) | s >> np.uint64(8))[:k]
                    out.append((np.zeros(k, np.int8), np.full(k, doc), np.full(k, n), np.full(k, print1.astype(np.int64)), order))
                    if size > RUN_BYTES:
                        seen, size = {}, 0
                if out:
                    kind, doc, n, prt, token = zip(*out, strict=True)
                    ids = pa.concat_arrays([pa.array(d, pa.int64()) for d in doc])
                    yield batch(kind=np.concatenate(kind), doc=ids, n=np.concatenate(n).astype(np.int32), print=np.concatenate(prt).astype(np.int64), token=np.concatenate(token).astype(np.uint64).view(np.int64))

    return docs.select("doc_id", "text").mapInArrow(lean(run), "kind byte, doc long, n int, print long, token long")


def runs(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last places of runs of at least two equal values."""
    edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
    many = np.diff(edge) > 1
    return edge[:-1][many], edge[1:][many]


def tiles(rows: DataFrame, percent: int, chunk: int = CHUNK) -> DataFrame:
    """kind 1: doc and the doc (other) of an equal set; 2: doc, n; 3: a pair, its sizes (n, token) and how many tokens it shared here; 4: doc, n and the first doc (other) of a large tile."""

    def run(batches):
        tiled = []

        def split():
            for x in batches:
                kind = x.column("kind").to_numpy()
                own = np.flatnonzero(kind == 0)
                if len(own) < x.num_rows:
                    other = x.take(pa.array(np.flatnonzero(kind != 0)))
                    tiled.append(batch(kind=other.column("kind"), doc=other.column("doc"), other=other.column("print"), n=other.column("n"), token=other.column("token"), shared=np.zeros(other.num_rows, np.int32)))
                if len(own):
                    yield x.take(pa.array(own))

        name = 0
        for cols, before, after in chunks(split(), "token", chunk):
            yield from tiled
            tiled.clear()
            first, last = runs(cols["token"])
            pairs, large, end = [], [], len(cols["token"])
            if before and (not len(first) or first[0]):  # one row of a tile that is cut
                first, last = np.append(0, first), np.append(1, last)
            if after and (not len(last) or last[-1] < end):
                first, last = np.append(first, end - 1), np.append(last, end)
            for i, j in zip(first.tolist(), last.tolist(), strict=True):
                by = np.lexsort((cols["doc"][i:j], cols["print"][i:j], cols["n"][i:j])) + i
                doc, n, prt = cols["doc"][by], cols["n"][by], cols["print"][by]
                new = np.concatenate([[True], (prt[1:] != prt[:-1]) | (n[1:] != n[:-1])])
                lead = doc[new][np.cumsum(new) - 1]
                pairs += [(min(a, b), max(a, b), k, k) for a, b, k in zip(lead[~new].tolist(), doc[~new].tolist(), n[~new].tolist(), strict=True) if a != b]
                doc, n = doc[new], n[new]
                m = len(doc)
                cut = before and i == 0, after and j == end
                if m > SMALL or any(cut):
                    name = name if cut[0] else int(doc.min())  # a tile that is cut keeps its name
                    large.append((np.full(m, name), doc, n))
                    continue
                doc, n = doc.tolist(), n.tolist()
                for a in range(m - 1):
                    for b in range(a + 1, m):
                        if 100 * n[a] < percent * n[b]:
                            break
                        pairs.append((doc[a], doc[b], n[a], n[b]) if doc[a] < doc[b] else (doc[b], doc[a], n[b], n[a]))
            if pairs:
                pairs, shared = np.unique(np.array(pairs, np.int64), axis=0, return_counts=True)
                yield batch(kind=np.full(len(pairs), 3, np.int8), doc=pairs[:, 0], other=pairs[:, 1], n=pairs[:, 2].astype(np.int32), token=pairs[:, 3], shared=shared.astype(np.int32))
            if large:
                first, doc, n = (np.concatenate(c) for c in zip(*large, strict=True))
                _, once = np.unique(np.stack([first, doc]), axis=1, return_index=True)
                yield batch(kind=np.full(len(once), 4, np.int8), doc=doc[once], other=first[once], n=n[once], token=first[once], shared=np.zeros(len(once), np.int32))
        yield from tiled

    dealt = rows.repartition(partitions(rows), "token").sortWithinPartitions("token")
    return dealt.mapInArrow(lean(run), "kind byte, doc long, other long, n int, token long, shared int")


def bitmap(s: np.ndarray) -> bytes:
    """Parities of the set's elements over a power of two of bits, by the set's size."""
    bits = min(max(64, 2 << (len(s) - 1).bit_length()), MOST_BITS) if len(s) else 64
    at = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(at.astype(bool), bitorder="little").tobytes()


def overlap_bound(a: bytes, na: int, b: bytes, nb: int) -> int:
    """At least the overlap of two sets, from their bitmaps: bits that differ come from elements of one set only."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    short = min(len(x), len(y))  # a wider bitmap folds to a narrower one by parity
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, short), axis=0) for v in (x, y))
    return (na + nb - int(np.bitwise_count(x ^ y).sum())) // 2


def alike(overlap: int, na: int, nb: int, percent: int) -> bool:
    return 100 * overlap >= percent * (na + nb - overlap)


def signatures(docs: DataFrame, ids: DataFrame, w: int) -> DataFrame:
    """doc, n, bits and text of the documents in ids (column doc)."""
    sent = docs.sparkSession.sparkContext.broadcast(marks(ids.select(F.col("doc").alias("id"))))

    def run(batches):
        for whole in batches:
            some = marked(whole, sent.value)
            for i in range(0, some.num_rows, 256):
                x = some.slice(i, 256)
                sets = [(len(s), bitmap(s)) for s in shingle_sets(x.column("text"), w)]
                yield batch(doc=x.column("doc_id"), n=pa.array([n for n, _ in sets], pa.int32()), bits=pa.array([b for _, b in sets], pa.binary()), text=x.column("text"))

    some = docs.where(F.col("doc_id").isNotNull()).mapInArrow(lean(run), "doc long, n int, bits binary, text string")
    out = staged(some.join(ids, "doc", "left_semi"), "signatures")
    sent.destroy()
    return out


def side(sigs: DataFrame, name: str, *cols: str) -> DataFrame:
    return sigs.select(F.col("doc").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in cols])


def bounded(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps allow that they are alike."""

    def run(batches):
        for x in batches:
            rows = zip(*(x.column(c).to_pylist() for c in ("bits_a", "n_a", "bits_b", "n_b")), strict=True)
            keep = [alike(overlap_bound(a, na, b, nb), na, nb, percent) for a, na, b, nb in rows]
            yield x.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    both = pairs.join(side(sigs, "a", "n", "bits"), "a").join(side(sigs, "b", "n", "bits"), "b")
    return staged(both.mapInArrow(lean(run), "a long, b long").distinct(), "near")


def verified(pairs: DataFrame, sigs: DataFrame, w: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are alike, by exact intersection."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                x = whole.slice(at, 256)
                keep = []
                for a, b in zip(shingle_sets(x.column("text_a"), w), shingle_sets(x.column("text_b"), w), strict=True):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(bool(both) and alike(both, len(a), len(b), percent))
                yield x.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    both = pairs.join(side(sigs, "a", "text"), "a").join(side(sigs, "b", "text"), "b")
    return both.mapInArrow(lean(run), "a long, b long").distinct()


def folded(bits: list[bytes], words: int) -> np.ndarray:
    """Bitmaps as rows of so many 64-bit words; wider ones fold by parity."""
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, words), axis=0) for b in bits])


class Block:
    """Sets of one tile's block: documents, sizes, components so far, bitmaps and texts."""

    def __init__(self, cols: dict, at: np.ndarray, w: int):
        self.doc, self.n, self.label = (cols[c][at] for c in ("doc", "n", "label"))
        self.bits, self.texts = cols["bits"][at].tolist(), cols["text"][at].tolist()
        self.w, self.known = w, {}

    def elements(self, i: int) -> np.ndarray:
        if i not in self.known:
            (self.known[i],) = shingle_sets(pa.array([self.texts[i]], pa.string()), self.w)
        return self.known[i]


def forest(a: Block, b: Block, percent: int) -> list[tuple[int, int]]:
    """Links between two blocks, or within one, that join documents of different components, until no link does."""
    words = min(min(map(len, a.bits)), min(map(len, b.bits))) // 8
    x, y, out = folded(a.bits, words), folded(b.bits, words), []
    for i in range(len(a.doc)):
        js = np.arange(i + 1 if a is b else 0, len(b.doc))
        js = js[(b.label[js] != a.label[i]) & (b.doc[js] != a.doc[i]) & (100 * np.minimum(b.n[js], a.n[i]) >= percent * np.maximum(b.n[js], a.n[i]))]
        if not len(js):
            continue
        both = (a.n[i] + b.n[js] - np.bitwise_count(y[js] ^ x[i]).sum(1, dtype=np.int64)) // 2
        for j in js[100 * both >= percent * (a.n[i] + b.n[js] - both)].tolist():
            if b.label[j] == a.label[i]:
                continue
            shared = len(np.intersect1d(a.elements(i), b.elements(j), assume_unique=True))
            if shared and alike(shared, int(a.n[i]), int(b.n[j]), percent):
                out.append((a.doc[i], b.doc[j]))
                gone, to = b.label[j], a.label[i]
                for block in (a, b):
                    block.label[block.label == gone] = to
    return out


def merged(large: DataFrame) -> DataFrame:
    """Large tiles, those of like size whose first document is in another one under that one's name.

    A group of near copies has a tile for most of its tokens, each lacking some
    copies, so their first documents differ; under one name they are compared once.
    """
    sizes = large.groupBy("tile").agg(F.count("*").alias("size"))
    first = large.join(sizes.select(F.col("tile").alias("doc"), F.col("size").alias("own")), "doc").join(sizes, "tile")
    to = first.where("own <= 2 * size and size <= 2 * own").groupBy(F.col("doc").alias("tile")).agg(F.min("tile").alias("to"))
    for _ in range(2):
        to = to.join(to.toDF("to", "on"), "to", "left").select("tile", F.coalesce("on", "to").alias("to"))
    return large.join(to, "tile").select(F.col("to").alias("tile"), "doc", "n").distinct()


def blocks_of(large: DataFrame, percent: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """tile, band, block, doc, n: the large tiles' rows by sizes and blocks."""
    width = -math.log(percent / 100)
    banded = large.withColumn("band", F.floor(F.log("n") / width + 1e-9).cast("int"))
    sizes = banded.groupBy("tile", "band").agg(F.ceil(F.greatest(F.count("*") / block_rows, 8 * F.sum("n") / BLOCK_BYTES)).cast("int").alias("blocks"))
    return banded.join(sizes, ["tile", "band"]).select("tile", "band", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int").alias("block"), "doc", "n")


def first_tasks(blocks: DataFrame) -> DataFrame:
    """tile, band, block, side and task: each block by itself, and with the first block of its band and of the next one."""
    own = F.struct(F.col("band").alias("band2"), F.col("block").alias("block2"))
    lead = blocks.groupBy("tile", "band").agg(F.min("block").alias("block2")).select("tile", F.col("band").alias("band2"), "block2")
    alone = blocks.select("tile", "band", "block", own.alias("other")).select("tile", "band", "block", "other.*")
    near = blocks.join(lead, "tile").where("(band2 = band AND block2 < block) OR band2 = band + 1").select("tile", "band", "block", "band2", "block2")
    return tasks_of(alone.union(near))


def later_tasks(rows: DataFrame) -> DataFrame:
    """The same for all other pairs of blocks of one band and neighbouring ones, but those whose rows (with label) are of one component."""
    blocks = rows.groupBy("tile", "band", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    blocks = staged(blocks, "blocks")
    main = blocks.where("lo = hi").groupBy("tile", "lo").agg(F.count("*").alias("n")).groupBy("tile").agg(F.max_by("lo", F.struct("n", "lo")).alias("main"))
    odd = blocks.join(main, "tile", "left").where("main IS NULL OR lo <> hi OR lo <> main").drop("main")  # the others are all of one component
    name = lambda df, k: df.select("tile", *[F.col(c).alias(f"{c}{k}") for c in ("band", "block", "lo", "hi")])
    lead = blocks.groupBy("tile", "band").agg(F.min("block").alias("first"))
    pairs = name(odd, "").join(name(blocks, "2"), "tile").where("abs(band - band2) <= 1 AND (band <> band2 OR block <> block2) AND NOT (lo = hi AND lo2 = hi2 AND lo = lo2)")
    swap = F.expr("band > band2 OR (band = band2 AND block > block2)")
    pairs = pairs.select("tile", *[F.when(swap, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("band2", "band", "band"), ("block2", "block", "block"), ("band", "band2", "band2"), ("block", "block2", "block2"))]).distinct()
    first = lead.select("tile", F.col("band").alias("band2"), F.col("first").alias("first2"))
    done = "(band2 = band AND least(block, block2) = first2) OR (band2 = band + 1 AND block2 = first2)"
    return tasks_of(pairs.join(first, ["tile", "band2"]).where(f"NOT ({done})").select("tile", "band", "block", "band2", "block2"))


def tasks_of(pairs: DataFrame) -> DataFrame:
    """tile, band, block, task, side (0: alone) from pairs of blocks (tile, band, block, band2, block2)."""
    one = (F.col("band") == F.col("band2")) & (F.col("block") == F.col("block2"))
    named = pairs.withColumn("task", F.xxhash64("tile", "band", "block", "band2", "block2")).withColumn("one", one)
    here = named.select("tile", "band", "block", "task", F.when(F.col("one"), 0).otherwise(1).alias("side"))
    return here.union(named.where("NOT one").select("tile", F.col("band2").alias("band"), F.col("block2").alias("block"), "task", F.lit(2).alias("side")))


def block_links(rows: DataFrame, tasks: DataFrame, sigs: DataFrame, w: int, percent: int) -> DataFrame:
    """Links (a, b) that tasks find between rows (tile, band, block, doc, n, label)."""
    dealt = rows.join(tasks, ["tile", "band", "block"]).select("task", "side", "doc", "n", "label").join(sigs, ["doc", "n"])

    def run(batches):
        for cols, _, _ in chunks(batches, "task"):
            edge = np.flatnonzero(np.concatenate([[True], cols["task"][1:] != cols["task"][:-1], [True]]))
            found = []
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                block = lambda k, i=i, j=j: Block(cols, i + np.flatnonzero(cols["side"][i:j] == k), w)
                own, a, b = map(block, range(3))
                if len(own.doc):
                    found += forest(own, own, percent)
                if len(a.doc) and len(b.doc):
                    found += forest(a, b, percent)
            if found:
                both = np.unique(np.sort(np.array(found, np.int64), axis=1), axis=0)
                yield batch(a=both[:, 0], b=both[:, 1])

    return dealt.repartition(partitions(rows), "task").sortWithinPartitions("task").mapInArrow(lean(run), "a long, b long").distinct()


def jaccard_join(docs: DataFrame, w: int = WORDS, percent: int = PERCENT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    level = docs.sparkSession.sparkContext.broadcast(levels(shingle_counts(docs, w)))
    found = staged(tiles(prefixes(docs, level, w, percent), percent), "tiles")
    level.destroy()
    equal = found.where("kind = 1").select(F.col("doc").alias("a"), F.col("other").alias("b"))
    # tokens shared beyond the prefixes are at most what lies behind one of them; pairs that share a large tile's token are tried there
    size = lambda c: F.col(c) - (F.col(c) - F.ceil(F.lit(percent) * F.col(c) / 100) + 1)
    enough = F.col("shared") + F.greatest(size("n"), size("token")) >= F.ceil(F.lit(percent) * (F.col("n") + F.col("token")) / (100 + percent))
    counted = found.where("kind = 3").groupBy(F.col("doc").alias("a"), F.col("other").alias("b"), "n", "token").agg(F.sum("shared").alias("shared"))
    pairs = staged(counted.where(enough).select("a", "b").distinct(), "pairs")
    large = staged(found.where("kind = 4").select(F.col("other").alias("tile"), "doc", "n").distinct(), "large")
    large = staged(merged(large), "merged")
    ids = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).union(large.select("doc")).distinct()
    sigs = signatures(docs, ids, w)
    links = staged(equal.union(verified(bounded(pairs, sigs, percent), sigs, w, percent)), "verified")
    rows = staged(blocks_of(large, percent, block_rows), "blocks")
    labelled = lambda labels: rows.join(labels.toDF("doc", "label"), "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    labels = staged(components(links), "labels")
    if not rows.isEmpty():
        blocks = rows.select("tile", "band", "block").distinct()
        labels = staged(join_components(labels, staged(block_links(labelled(labels), first_tasks(blocks), sigs, w, percent), "links")), "labels")
        named = staged(labelled(labels), "labelled")
        more = staged(block_links(named, later_tasks(named), sigs, w, percent), "links")
        if not more.isEmpty():
            labels = staged(join_components(labels, more), "labels")
    release(pairs, large, sigs, links, rows)
    rows = found.where("kind = 2").select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"))
    return rows.join(labels.toDF("doc_id", "__c"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("__c", "doc_id").alias("component_id"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words
), tokens AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), least AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN least ON least.a = sets.doc_id
"""
