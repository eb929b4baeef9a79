"""Chat formatting as a prefix tree, laid out depth-first.

Conversations that begin with the same turns share those turns' nodes. A
node's key is the digest of all turns up to its own, so nodes are made by a
pre-aggregated group of the (key, turn) rows. Nodes are sorted by their path
(the keys from the root on), which is depth-first order, over range
partitions; a short summary of each partition (its tokens and its last path)
is enough to give every node its place in the whole stream. Each node has its
tokens once, the position of its first one, and the intervals of the stream
that its ancestors hold, which are what it may attend to besides itself.

The template marks turns with control strings. In texts and roles a backslash
goes into every control string and before every backslash, so marks can't be
forged and texts come back unchanged.

Defined cases: null text and role are empty; rows of a conversation go by
turn, ties by role and text, null turns first; repeated rows are turns of
their own; a null conv_id is a conversation. One conversation is worked on as
a whole, and its paths take 8 bytes for each pair of its turns. An empty table
gives no rows; very long texts are whole nodes; extra columns aren't read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import VOCABULARY, encoder
from .common import Memo, batch, partitions, release, small_batches, staged

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE:", "[/ROLE]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_TURN = re.compile(r"(?s)<s>\[INST\] (?P<user>.*?) \[/INST\]| (?P<assistant>.*?) </s>|<s>\[ROLE:(?P<role>(?:\\.|[^\\\]])*)\] (?P<text>.*?) \[/ROLE\]")


KEEP = 20_000  # chunks that a worker remembers
STEP = 8  # bytes of a key that a path has for each turn; they only order and tell apart children of one node


def escape(text: str, more: str = "") -> str:
    text = _CONTROL.sub(lambda m: m[0][0] + "\0\\" + m[0][1:], text.replace("\\", "\\\\").replace("\0", "\\0"))
    for c in more:
        text = text.replace(c, "\0\\" + c)
    return text.replace("\0", "")


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", lambda m: "\0" if m[1] == "0" else m[1], text)


def turn_parts(role: str, text: str) -> tuple[str, str, str]:
    """Before the text, the text, after it, as they are written."""
    if role == "user":
        return "<s>[INST] ", escape(text), " [/INST]"
    if role == "assistant":
        return " ", escape(text), " </s>"
    return f"<s>[ROLE:{escape(role, ']')}] ", escape(text), " [/ROLE]"


def read_turns(formatted: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        kind = m.lastgroup
        out.append((unescape(m["role"]), unescape(m["text"])) if kind == "text" else (kind, unescape(m[kind])))
        at = m.end()
    return out


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, key, path, role, text of every turn."""
    small_batches(conversations.sparkSession)
    whole = conversations.groupBy("conv_id").agg(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("turns"))

    def rows_of(out: list) -> pa.RecordBatch:
        conv, depth, key, path, role, text = map(list, zip(*out, strict=True))
        return batch(conv_id=pa.array(conv, pa.int64()), depth=pa.array(depth, pa.int32()), key=key, path=path, role=role, text=text)

    def run(batches):
        for big in batches:
            for at in range(0, big.num_rows, 256):
                x = big.slice(at, 256)
                out, held = [], 0
                for conv, turns in zip(x.column("conv_id").to_pylist(), x.column("turns").to_pylist(), strict=True):
                    turns.sort(key=lambda t: (t["turn"] is not None, t["turn"] or 0, t["role"], t["text"]))
                    key, path = b"", b""
                    for depth, t in enumerate(turns):
                        role, text = t["role"].encode(), t["text"].encode()
                        key = hashlib.sha256(key + len(role).to_bytes(8, "little") + role + text).digest()[:16]
                        path += key[:STEP]
                        out.append((conv, depth, key, path, t["role"], t["text"]))
                        held += len(path) + len(text)
                        if held > 4 << 20:  # long conversations have long paths
                            yield rows_of(out)
                            out, held = [], 0
                if out:
                    yield rows_of(out)

    return whole.mapInArrow(run, "conv_id long, depth int, key binary, path binary, role string, text string")


def prefix_tree(turns: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The nodes: key, path, depth, n_convs, tokens, loss_start and loss_end (places in tokens), start (in the stream), position (of the first token), ancestors."""
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    nodes = turns.groupBy("key", "path", "depth", "role", "text").agg(F.count("*").alias("n_convs"))  # a key has one path, depth, role and text

    def encode(batches):
        coder = encoder(vocabulary, KEEP)
        marks = Memo(lambda p: coder.encode(p)[1], 1000)  # what the template writes around texts
        for x in batches:
            rows = []
            for role, text in zip(x.column("role").to_pylist(), x.column("text").to_pylist(), strict=True):
                before, own, after = turn_parts(role, text)
                parts = marks[before], coder.encode(own)[1], marks[after]
                first = len(parts[0])
                rows.append((np.concatenate(parts).astype(np.int32), first, first + len(parts[1]) if role == "assistant" else first))
            tokens, lo, hi = zip(*rows, strict=True) if rows else ((), (), ())
            yield batch(key=x.column("key"), path=x.column("path"), depth=x.column("depth"), n_convs=x.column("n_convs"), tokens=pa.array(tokens, pa.list_(pa.int32())), loss_start=pa.array(lo, pa.int32()), loss_end=pa.array(hi, pa.int32()))

    schema = "key binary, path binary, depth int, n_convs long, tokens array<int>, loss_start int, loss_end int"
    encoded = staged(nodes.mapInArrow(encode, schema), "nodes")
    ordered = encoded.repartitionByRange(partitions(turns), "path").sortWithinPartitions("path")

    def number(batches):
        part, n = TaskContext.get().partitionId(), 0
        for x in batches:
            names = dict(zip(x.schema.names, x.columns, strict=True))
            yield batch(**names, part=np.full(x.num_rows, part, np.int32), row=np.arange(n, n + x.num_rows))
            n += x.num_rows

    # written in this order; a part is read again as sorted runs by (part, row)
    placed = staged(ordered.mapInArrow(number, schema + ", part int, row long"), "ordered")
    sizes = placed.select("part", "row", "depth", "path", F.size("tokens").cast("long").alias("n"))
    total = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    first = sizes.groupBy("part").agg(F.min_by("path", "row").alias("path"))
    before, at = {}, 0  # a row a partition
    for r in sorted(total.collect(), key=lambda r: r["part"]):
        before[r["part"]], at = at, at + r["n"]
    # ancestors that lie in earlier partitions are ancestors of the partition's first node
    heads = {r["part"]: [bytes(r["path"])[i : i + STEP] for i in range(0, len(r["path"]) - STEP, STEP)] for r in first.collect()}
    spark = turns.sparkSession
    sent = spark.sparkContext.broadcast(before)

    def stacked(batches):
        """Starts; how many ancestors are in earlier partitions; the intervals of the others, joined where they touch."""
        part = None
        for x in batches:
            start, missing, spans, positions = [], [], [], []
            for p, path, n in zip(x.column("part").to_pylist(), x.column("path").to_pylist(), x.column("n").to_pylist(), strict=True):
                if p != part:
                    part, at, stack = p, sent.value[p], []
                while stack and not path.startswith(stack[-1][0]):
                    stack.pop()
                if stack:
                    _, s, m, own, lost, seen = stack[-1]
                    own = [*own[:-1], (own[-1][0], s + m)] if own and own[-1][1] == s else [*own, (s, s + m)]
                    seen += m
                else:
                    own, lost, seen = [], len(path) // STEP - 1, 0
                start.append(at)
                missing.append(lost)
                spans.append([{"start": a, "end": b} for a, b in own])
                positions.append(seen)
                stack.append((path, at, n, own, lost, seen))
                at += n
            yield batch(key=x.column("key"), n=x.column("n"), part=x.column("part"), start=pa.array(start, pa.int64()), missing=pa.array(missing, pa.int32()), seen=pa.array(positions, pa.int64()), spans=pa.array(spans, interval))

    interval = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    one = placed.select("part", "row", "key", "path", F.size("tokens").cast("long").alias("n")).repartition(partitions(turns), "part").sortWithinPartitions("part", "row")
    layout = staged(one.mapInArrow(stacked, "key binary, n long, part int, start long, missing int, seen long, spans array<struct<start:long,end:long>>"), "layout")
    asked = sorted({k for h in heads.values() for k in h})
    found = {}
    if asked:
        wanted = F.broadcast(spark.createDataFrame([(bytearray(k),) for k in asked], "k binary"))  # a path a partition
        found = {bytes(r["k"]): (r["start"], r["start"] + r["n"]) for r in layout.withColumn("k", F.substring("key", 1, STEP)).join(wanted, "k").select("k", "start", "n").collect()}
    known = spark.sparkContext.broadcast({p: [found[k] for k in h] for p, h in heads.items()})

    def complete(batches):
        for x in batches:
            position, whole = [], []
            for part, missing, seen, spans in zip(*(x.column(c).to_pylist() for c in ("part", "missing", "seen", "spans")), strict=True):
                far = known.value[part][:missing]
                joined: list = []
                for a, b in [*far, *((s["start"], s["end"]) for s in spans)]:
                    if joined and joined[-1]["end"] == a:
                        joined[-1]["end"] = b
                    else:
                        joined.append({"start": a, "end": b})
                position.append(seen + sum(b - a for a, b in far))
                whole.append(joined)
            yield batch(key=x.column("key"), start=x.column("start"), position=pa.array(position, pa.int64()), ancestors=pa.array(whole, interval))

    where = layout.mapInArrow(complete, "key binary, start long, position long, ancestors array<struct<start:long,end:long>>")
    out = staged(placed.drop("part", "row").join(where, "key"), "tree")
    release(encoded, placed, layout)
    sent.destroy()
    known.destroy()
    return out


def read_back(turns: DataFrame, tree: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from the tree's tokens."""
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    own = turns.select("conv_id", "depth", "key").join(tree.select("key", "tokens", "loss_start", "loss_end"), "key")
    convs = own.groupBy("conv_id").agg(F.collect_list(F.struct("depth", "tokens", "loss_start", "loss_end")).alias("nodes"))

    def run(batches):
        coder = encoder(vocabulary, KEEP)
        for big in batches:
            for at in range(0, big.num_rows, 256):
                x = big.slice(at, 256)
                rows = []
                for nodes in x.column("nodes").to_pylist():
                    nodes.sort(key=lambda n: n["depth"])
                    decode = lambda ids: coder.decode(np.array(ids, np.int64))
                    whole = b"".join(decode(n["tokens"]) for n in nodes).decode()
                    loss = "".join(unescape(decode(n["tokens"][n["loss_start"] : n["loss_end"]]).decode()) for n in nodes)
                    turns = read_turns(whole)
                    sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                    rows.append((len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole)))
                names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
                yield batch(conv_id=x.column("conv_id"), **{n: list(c) for n, c in zip(names, zip(*rows, strict=True), strict=True)}) if rows else batch(conv_id=x.column("conv_id"), **{n: pa.array([], pa.string() if "sha" in n else pa.int64()) for n in names})

    return convs.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def probe(spark: SparkSession) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")


def format_chats(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (conv_id, depth, key) and the tree they are in."""
    turns = staged(turn_rows(conversations.select("conv_id", "turn", "role", "text")), "turns")
    return turns, prefix_tree(turns)
