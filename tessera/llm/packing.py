"""Best-fit packing of token pieces into sequences of a fixed capacity, in bulk-synchronous steps.

Documents are tokenised and cut only where longer than the capacity. Pieces are
taken in bands of lengths, the longest first. A step range-sorts a band's
pieces and the open gaps that could hold one of them by size, from large to
small, over the tasks. Each task sweeps its range: a piece goes to its
successor, the smallest gap at hand that it fits in; of pieces that want one
gap the one of lower rank (longer, then by row) gets it, and the gap goes on
with what is left of it. Pieces that found no gap in their own range are
matched with gaps left in the ranges above by counts alone: a row a task goes
to the driver, which gives the nearest larger range's gaps to the ranks that
come first, and a join of (range, rank) carries it out. Gaps are updated, and
the step is repeated until no piece of the band fits any gap; what is left
opens sequences, again by best fit within each task's range.

Defined cases: a null text is empty, and one piece (the end id). Rows with
equal ids are packed each; of equal lengths any may come first, by row. Very
long texts are cut into pieces and tokenised as a whole. An empty table gives
no rows. Columns of any name pass through ``best_fit``.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, Memo, batch, free, lean, partitions, release, schema_of, small, small_batches, staged
from .textvec import slices, text_buffers

VOCABULARY = "word_bpe_49k.json"
END = np.array([1], np.uint32).tobytes()
CAPACITY = 4096
KEEP = 250_000  # chunks that a worker remembers, at most twice as many
SWEPT, MOST_TASKS = 20_000, 10_000  # rows that a task of a sweep gets, about, up to so many tasks
#: How word_bpe_49k cuts lower-case text (its published pre-tokenizer).
CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: A chunk that is one run of ASCII letters and at most one run of marks after it.
PLAIN = re.compile(rb"([A-Za-z]+)([!-&(-/:-@\[-`{-~]*)")


class ChunkTokenizer:
    """Ids by chunks between ASCII white space, which this vocabulary drops and never merges across.

    A chunk without letters beyond Latin is cut as the tokenizer itself cuts it
    once in lower case; the pieces repeat more often than the chunks do. Pieces
    of ASCII, and of the Latin letters up to U+012F, are merged by tiktoken,
    which is several times faster on single pieces: ids are in merge order, and
    a piece's last byte, which carries the word's end, gets a byte of its own.
    """

    def __init__(self, path: str, keep: int = KEEP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.chunks, self.pieces = Memo(self._chunk, keep), Memo(self._piece, keep // 2)
        raw = {}
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            body, end = (token[:-4], True) if len(token) > 4 and token.endswith("</w>") else (token, False)
            raw[i] = bytes(BYTES[c] for c in body), end
        marks = range(33, 127)
        self.ascii, self.ascii_end = merges(raw, {b: b for b in marks}, {b: b | 128 for b in marks})
        letters, rest = range(97, 123), range(0x80, 0xC0)
        # the last bytes of letters beyond ASCII are 0x80 to 0xBF; as ends they take 0 to 63, letters the capitals
        self.latin, self.latin_end = merges(raw, {b: b for b in (*letters, *rest, 0xC3, 0xC4)}, {**{b: b - 32 for b in letters}, **{b: b - 0x80 for b in rest}})

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        if piece.isascii() and piece.isprintable():
            return array("I", self.ascii(raw[:-1] + self.ascii_end[raw[-1]])).tobytes()
        if piece.isalpha() and min(piece) >= "a" and max(piece) < "İ" and not any(c in piece for c in "ªµº"):
            return array("I", self.latin(raw[:-1] + self.latin_end[raw[-1]])).tobytes()
        return self._by_library(piece)

    def _chunk(self, chunk: bytes) -> bytes:
        plain = PLAIN.fullmatch(chunk)
        if plain:
            word, tail = plain.groups()
            word = word.lower()
            ids = array("I", self.ascii(word[:-1] + self.ascii_end[word[-1]])).tobytes()
            return ids + self.pieces[tail.decode()] if tail else ids
        text = chunk.decode()
        if not text.isascii() and max(text) >= "İ":
            return self._by_library(text)
        return b"".join(map(self.pieces.__getitem__, CUT.findall(text.lower())))

    def _by_library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: bytes) -> bytes:
        """The text's ids as little-endian 32-bit numbers."""
        return b"".join(map(self.chunks.__getitem__, text.split()))


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of byte-level vocabularies stands for: itself if it prints in Latin-1, else the next one past 255."""
    shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b != 173]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


BYTES = byte_alphabet()


def merges(tokens: dict[int, tuple[bytes, bool]], inner: dict[int, int], last: dict[int, int]):
    """tiktoken's merges over the tokens of bytes in inner (written as it says), and what a word's last byte is written as."""
    import tiktoken

    ranks = {}
    for i, (raw, end) in tokens.items():
        ends = last if end else inner
        if all(b in inner for b in raw[:-1]) and raw[-1] in ends:
            ranks[bytes(inner[b] for b in raw[:-1]) + bytes([ends[raw[-1]]])] = i
    for i in range(256):  # tiktoken wants all bytes; those left over are never met
        ranks.setdefault(bytes([i]), (1 << 30) + i)
    coder = tiktoken.Encoding("own", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe
    return coder.encode_single_piece, {b: bytes([v]) for b, v in last.items()}


@lru_cache(maxsize=2)
def chunk_tokenizer(path: str, keep: int = KEEP) -> ChunkTokenizer:
    return ChunkTokenizer(path, keep)


CACHES.append(chunk_tokenizer)


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = True, number: str = "", keep: int = KEEP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every document; number: a column with another number for each row; keep: chunks that a worker remembers."""
    small_batches(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        tokens, first = chunk_tokenizer(path, keep), TaskContext.get().partitionId() << 40
        for x in batches:
            data, offs = text_buffers(x.column("text"))
            ids = x.column("doc_id").to_pylist()
            for i, j in slices(offs):
                rows = []
                for d in range(i, j):
                    raw = tokens.encode(data[offs[d] : offs[d + 1]].tobytes())
                    raw += END
                    for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        row = (ids[d], piece, at // 4, len(part) // 4, zlib.crc32(part))
                        rows.append((*row, np.frombuffer(part, np.int32)) if with_ids else row)
                names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
                kinds = ("long", "int", "long", "long", "long", "list")
                types = {"long": pa.int64(), "int": pa.int32(), "list": pa.list_(pa.int32())}
                own = {number: np.arange(first, first + len(rows))} if number else {}
                first += len(rows)
                yield batch(**{n: pa.array(c, types[k]) for n, k, c in zip(names, kinds, zip(*rows, strict=True), strict=False)}, **own)

    more = (", ids array<int>" if with_ids else "") + (f", {number} long" if number else "")
    return docs.select("doc_id", "text").mapInArrow(lean(run, chunk_tokenizer), "doc_id long, piece int, start long, length long, ids_crc32 long" + more)


SWEEP = "kind byte, part int, rank long, n long, id long, size long, seq long, at long"
PLACED, LEFT, AT_HAND, WITHOUT = range(4)


def swept(rows: DataFrame, capacity: int, high: int, tasks: int, step: int, opening: int) -> DataFrame:
    """One sweep over rows (is_piece, id, size) in ranges of sizes.

    kind PLACED: piece id in seq at an offset; LEFT: gap id was cut to a size
    below the range's later pieces; AT_HAND: gap id is as large as all pieces
    after this range, and holds n pieces of the band for sure, in the places
    from rank on; WITHOUT: piece id found no gap here. opening 1: such pieces
    open sequences instead, but what lies in sequences that could hold another
    piece of the range at its end is given back; opening 2: it stays.
    """

    def run(batches):
        part, opened = TaskContext.get().partitionId(), 0
        at_hand, waiting, without, inside, size = [], [], 0, {}, 0
        for x in batches:
            out = []
            for piece, i, size in zip(*(x.column(c).to_pylist() for c in ("is_piece", "id", "size")), strict=True):
                if not piece:
                    heapq.heappush(at_hand, (size, i))
                    continue
                while waiting and -waiting[0][0] >= size:
                    gap, seq = heapq.heappop(waiting)
                    heapq.heappush(at_hand, (-gap, seq))
                if at_hand:
                    gap, seq = heapq.heappop(at_hand)
                elif opening:
                    gap, seq, opened = capacity, step << 50 | part << 30 | opened, opened + 1
                else:
                    out.append((WITHOUT, part, without, 1, i, size, 0, 0))
                    without += 1
                    continue
                placed = (PLACED, part, 0, 0, i, size, seq, capacity - gap)
                if opening != 1:
                    out.append(placed)
                elif gap - size >= size:  # not full: smaller pieces of the range may come
                    inside.setdefault(seq, []).append(placed)
                else:
                    out += [*inside.pop(seq, ()), placed]
                if gap > size:
                    heapq.heappush(waiting, (size - gap, seq))
            yield sweep_rows(out)
        if opening == 1:
            out = [(WITHOUT, part, 0, 1, p[4], p[5], 0, 0) for own in inside.values() for p in own]
            waiting, at_hand = ([x for x in own if x[1] not in inside] for own in (waiting, at_hand))
            yield sweep_rows(out)
        out, rank = [(LEFT, part, 0, 0, seq, -gap, 0, 0) for gap, seq in waiting], 0
        for gap, seq in sorted(at_hand):
            n = max(1, gap // high)
            out.append((AT_HAND, part, rank, n, seq, gap, 0, 0))
            rank += n
        yield sweep_rows(out)

    order = [F.desc("size"), F.col("is_piece"), F.col("id")]  # at one size gaps come first
    dealt = rows.coalesce(1) if tasks == 1 else rows.repartitionByRange(tasks, *order)
    return dealt.sortWithinPartitions(*order).mapInArrow(lean(run), SWEEP)


def sweep_rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ("kind", "part", "rank", "n", "id", "size", "seq", "at")
    types = (pa.int8(), pa.int32(), *[pa.int64()] * 6)
    cols = zip(*rows, strict=True) if rows else [()] * len(names)
    return batch(**{c: pa.array(v, t) for c, v, t in zip(names, cols, types, strict=True)})


def matching(places: dict[int, int], wanting: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """(part, first rank, last rank, gaps' part, first place) that give each part's pieces the nearest places of the parts before it."""
    stack, out = [], []
    for part in sorted(places.keys() | wanting.keys()):
        rank, left = 0, wanting.get(part, 0)
        while left and stack:
            source, place, until = stack.pop()
            took = min(left, until - place)
            out.append((part, rank, rank + took - 1, source, place))
            rank, left = rank + took, left - took
            if place + took < until:
                stack.append((source, place + took, until))
        if places.get(part):
            stack.append((part, 0, places[part]))
    return out


def matched(sweep: DataFrame, plan: list, capacity: int) -> DataFrame:
    """kind PLACED: the pieces that plan gives to gaps of other ranges; LEFT: those gaps after it."""
    spark = sweep.sparkSession
    runs = F.broadcast(small(spark, plan, "part int, first long, last long, source int, place long"))  # at most two rows a task
    used = {}
    for _, first, last, source, place in plan:
        used[source] = max(used.get(source, 0), place + last - first + 1)
    uses = F.broadcast(small(spark, list(used.items()), "source int, used long"))  # a row a task
    pieces = sweep.where(F.col("kind") == WITHOUT).join(runs, "part").where("rank BETWEEN first AND last")
    pieces = pieces.select("source", (F.col("place") + F.col("rank") - F.col("first")).alias("place"), F.col("id").alias("piece"), F.col("size").alias("length"))
    gaps = sweep.where(F.col("kind") == AT_HAND).select(F.col("part").alias("source"), "rank", "n", "id", "size").join(uses, "source").where("rank < used")
    gaps = gaps.select("source", F.explode(F.sequence("rank", F.least(F.col("rank") + F.col("n"), F.col("used")) - 1)).alias("place"), "id", "size")
    both = pieces.join(gaps, ["source", "place"])
    by_gap = both.groupBy("id", "size").agg(F.sort_array(F.collect_list(F.struct("place", "piece", "length"))).alias("own"))  # at most capacity pieces
    total = F.aggregate("own", F.lit(0).cast("long"), lambda s, x: s + x["length"])
    left = by_gap.select(F.lit(LEFT).cast("byte").alias("kind"), "id", (F.col("size") - total).alias("size"), F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("at"))
    before = lambda x, i: F.aggregate(F.slice("own", F.lit(1), i), F.lit(0).cast("long"), lambda s, y: s + y["length"])
    each = by_gap.select("id", "size", F.explode(F.transform("own", lambda x, i: F.struct(x["piece"].alias("piece"), x["length"].alias("length"), before(x, i).alias("before")))).alias("x"))
    placed = each.select(F.lit(PLACED).cast("byte").alias("kind"), F.col("x.piece").alias("id"), F.col("x.length").alias("size"), F.col("id").alias("seq"), (F.lit(capacity) - F.col("size") + F.col("x.before")).alias("at"))
    return placed.union(left)


def bands(capacity: int) -> list[tuple[int, int]]:
    """(longest, past the shortest) length of each band: halves, from a sixteenth on quarters."""
    ends = [capacity]
    while ends[-1]:
        ends.append(ends[-1] // (2 if ends[-1] * 16 > capacity else 4))
        if ends[-1] < 16:
            ends[-1] = 0
    return list(zip(ends, ends[1:], strict=False))


def best_fit(pieces: DataFrame, capacity: int = CAPACITY, rows_a_task: int = SWEPT, number: str = "") -> DataFrame:
    """pieces with sequence_id and offset; a column ``length`` from 1 to capacity is needed, others pass through.

    number: a column that tells rows apart and is left out; without one rows are numbered.
    """
    columns = [c for c in pieces.columns if c != number]
    row, seq, at = free(columns, number or "row", "seq", "at")

    def count(batches):
        first = TaskContext.get().partitionId() << 40
        for x in batches:
            yield batch(**dict(zip(x.schema.names, x.columns, strict=True)), **{row: np.arange(first, first + x.num_rows)})
            first += x.num_rows

    numbered = staged(pieces if number else pieces.mapInArrow(lean(count), schema_of(pieces, f"`{row}` long")), "pieces")
    limits = bands(capacity)
    band = F.lit(len(limits) - 1)
    for k, (_, low) in reversed(list(enumerate(limits[:-1]))):
        band = F.when(F.col("length") > low, k).otherwise(band)
    counts = {r["band"]: (r["n"], r["least"]) for r in numbered.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.min("length").alias("least")).collect()}
    spark, step, placed, tables = pieces.sparkSession, 0, [], []
    gaps, n_gaps, most = None, 0, 0  # open sequences (id, size), how many, and the largest gap

    def keep(rows: DataFrame, name: str) -> DataFrame:
        tables.append(staged(rows, name))
        return tables[-1]

    for k, (high, low) in enumerate(limits):
        if k not in counts:
            continue
        (n, least), todo = counts[k], numbered.where((F.col("length") > low) & (F.col("length") <= high)).select(F.lit(True).alias("is_piece"), F.col(row).alias("id"), F.col("length").cast("long").alias("size"))
        given_back = False
        while n:
            n_gaps, most = gaps.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(0))).first() if gaps is not None else (0, 0)
            fits, rest, rows = most >= least, gaps, todo
            tasks = max(1, min(-(-(n + n_gaps * fits) // rows_a_task), MOST_TASKS))
            if fits:
                usable = F.col("size") >= least
                rest, rows = gaps.where(~usable), todo.union(gaps.where(usable).select(F.lit(False), "id", "size"))
            # one task sees all gaps, so a piece without one may open a sequence at once
            opening = 2 if tasks == 1 else 0 if fits else 2 if given_back else 1
            step, given_back = step + 1, opening == 1
            sweep = keep(swept(rows, capacity, high, tasks, step, opening), "sweep")
            placed.append(sweep)
            left = sweep.where(F.col("kind").isin(LEFT, AT_HAND)).select("id", "size")
            if opening < 2:
                per_task = sweep.where(F.col("kind").isin(AT_HAND, WITHOUT)).groupBy("kind", "part").agg(F.sum("n").alias("n")).collect()  # two rows a task
                places, wanting = ({r["part"]: r["n"] for r in per_task if r["kind"] == kind} for kind in (AT_HAND, WITHOUT))
                n, plan = sum(wanting.values()), [] if opening else matching(places, wanting)
                todo = sweep.where(F.col("kind") == WITHOUT).select(F.lit(True).alias("is_piece"), "id", "size")
                if plan:
                    found = keep(matched(sweep, plan, capacity), "matched")
                    placed.append(found)
                    cut, got = (found.where(F.col("kind") == kind).select("id", "size") for kind in (LEFT, PLACED))
                    left = left.join(cut.select("id"), "id", "left_anti").union(cut.where("size > 0"))
                    todo = todo.join(got.select("id"), "id", "left_anti").select("is_piece", "id", "size")
                    n -= sum(last - first + 1 for _, first, last, _, _ in plan)
                if n:
                    todo = keep(todo, "without")
                    least = todo.agg(F.min("size")).first()[0]
            else:
                n = 0
            gaps = left if rest is None else left.union(rest)
            if tasks > 1:
                gaps = keep(gaps, "gaps")
    if not placed:
        return numbered.limit(0).select(*[F.col(f"`{c}`") for c in columns], F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    where = placed[0].select("kind", "id", "seq", "at")
    for more in placed[1:]:
        where = where.union(more.select("kind", "id", "seq", "at"))
    where = keep(where.where(F.col("kind") == PLACED).select(F.col("id").alias(row), F.col("seq").alias(seq), F.col("at").alias(at)), "placed")
    release(*tables[:-1])
    return numbered.join(where, row).select(*[F.col(f"`{c}`") for c in columns], F.col(seq).alias("sequence_id"), F.col(at).alias("offset"))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = True, keep: int = KEEP) -> DataFrame:
    # numbered by the worker that makes them: a second one a task would hold another tokenizer's memory
    return best_fit(token_pieces(docs, path, capacity, with_ids, "row", keep), capacity, number="row")
