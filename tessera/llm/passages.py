"""Substring dedup: near-duplicate passages across documents by compact windows.

A document is the sequence of its five-word shingles. For each of a few hash
functions, the Cartesian tree over the shingles' hashes (cut from the top: the
minimum of a segment parts it in two) gives compact windows [l, c, r]: every
passage inside that holds c has c's hash as its min-hash. Only windows of at
least the least passage's length are made, about 2n / that length a function.

Windows with one min-hash form a group, in the order of (id, place). A group
may be drawn together by fewer words than a passage has, so each window is
linked to the first of those that agree with it over nine shingles (45 words)
around the minimum, wherever the minimum lies in them. A window without such a
link is linked to the group's first and to the one before it, and to the first
that agrees with it there but for one changed word. Links depend on the keys
alone, never on tasks or batches. A min-hash that a sample by id shows to be
hot is split by the hash of the id, and in each part those that nothing before
them agrees with go on to a second round, grouped by what they agree over.

The windows that link two documents are joined as intervals across the hash
functions: a place goes on if the windows of at least ``enough`` functions
cover it. There both texts' shingles are compared, and passages of at least
``min_words`` words whose shingle sets have a Jaccard similarity of at least
``similarity`` are kept, with exact spans.

Defined cases: null, empty and short texts have no passages, an empty table
none; rows without an id take no part; of rows with equal ids all texts are
searched, but not against each other. Of equal hashes in a text the first by a
fixed order of places is the minimum. Very long texts are worked on whole. The
smaller (id, position) of two passages is the representative. Extra columns
are not read, and pass through ``drop_passages``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, chunks, free, lean, partitions, release, schema_of, small_batches, some_of, staged
from .components import components
from .textvec import Words, each, mix, stream, text_buffers

WORDS, MIN_WORDS, SIMILARITY, HASHES, ENOUGH = 5, 50, 0.8, 4, 2
HOT, SAMPLED = 1 << 16, 64  # windows of a min-hash from which on it is split, by one id in so many
PLACES = 16
BESIDE = 8  # fingerprints of shingles w apart on each side of a window's minimum, three bits each
#: Which of them agree if the texts do over BESIDE + 1 shingles around the minimum; and the same with one left out, for a changed word.
RUNS = np.array([sum(7 << 3 * (k + i) for i in range(BESIDE)) for k in range(BESIDE + 1)], np.uint64)
PARTS = np.array(sorted({r & ~(7 << 3 * i) for r in RUNS.tolist() for i in range(2 * BESIDE) if r >> 3 * i & 7}), np.uint64)


def compact_windows(v: np.ndarray, offs: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(text, l, c, r) of all windows of at least least values; r is inclusive, places count from 0 over all texts."""
    start, end = offs[:-1], offs[1:]
    text = np.arange(len(start))
    out = []
    while True:
        wide = end - start >= least
        start, end, text = start[wide], end[wide], text[wide]
        if not len(start):
            break
        size = end - start
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        at = np.arange(size.sum()) - np.repeat(first - start, size)
        own = v[at]
        low = np.minimum.reduceat(own, first)
        least_at = np.flatnonzero(own == np.repeat(low, size))
        # of equal values any may part a segment; the first of each is taken
        c = at[least_at[np.searchsorted(least_at, first)]]
        out.append((text, start, c, end - 1))
        start, end, text = np.concatenate([start, c + 1]), np.concatenate([c, end]), np.concatenate([text, text])
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def windows(docs: DataFrame, w: int, least: int, hashes: int) -> DataFrame:
    """token (the min-hash), doc, at (place of the minimum << 8 | function), span (places before << 32 | after it) and near (fingerprints around it)."""
    seeds = stream(hashes, 7)

    def run(batches):
        for x in batches:
            ids = np.array([-1 if d is None else d for d in x.column("doc_id").to_pylist()], np.int64)
            for i, _, words in each(x.column("text"), lower=True):
                sh, soffs = words.shingles(w)
                if not len(sh):
                    continue
                own = np.arange(len(sh)) - np.repeat(soffs[:-1], np.diff(soffs))
                place = mix(own.astype(np.uint64)) & np.uint64(0xFFFF)
                rows = []
                for f, seed in enumerate(seeds):
                    h = mix(sh + seed)
                    text, left, c, right = compact_windows(h & ~np.uint64(0xFFFF) | place, soffs, least)
                    doc, at = ids[i + text], (c - soffs[text]) << 8 | f
                    near = np.zeros(len(c), np.uint64)
                    for k, step in enumerate([*range(-BESIDE, 0), *range(1, BESIDE + 1)]):
                        there = c + step * w
                        inside = (there >= soffs[text]) & (there < soffs[text + 1])
                        # beyond an end of the text: a value of the window's own
                        bits = np.where(inside, sh[np.clip(there, 0, len(sh) - 1)], mix((at ^ doc * 31 + k).view(np.uint64))) >> np.uint64(61)
                        near |= bits << np.uint64(3 * k)
                    # 40 bits of a token do, as links are verified; they shuffle smaller
                    rows.append(((h[c] >> np.uint64(24)).view(np.int64), doc, at, c - left << 32 | right - c, near.view(np.int64)))
                token, doc, at, span, near = (np.concatenate(r) for r in zip(*rows, strict=True))
                yield batch(token=token, doc=doc, at=at, span=span, near=near)

    some = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    return some.mapInArrow(lean(run), "token long, doc long, at long, span long, near long")


def first_of(keys: np.ndarray) -> np.ndarray:
    """For each row the first row with its key."""
    _, first, back = np.unique(keys, return_index=True, return_inverse=True)
    return first[back]


def run_keys(token: np.ndarray, near: np.ndarray) -> np.ndarray:
    """A row a pattern: what windows share that agree there."""
    return np.stack([mix(mix(near & p) + mix(token + np.uint64(k))) for k, p in enumerate(RUNS)])


def group_links(token: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows to link (later, earlier) of groups in order, which rows lead (nothing before agrees with them in some pattern), and which agree with none."""
    n = len(token)
    here, keys = np.arange(n), run_keys(token, near)
    firsts = np.stack([first_of(k) for k in keys])
    lead, lone = (firsts == here).any(0), (firsts == here).all(0)
    pairs = [here * n + f for f in firsts]
    head = first_of(token)
    some = np.flatnonzero(lone & (head != here))
    pairs += [some * n + head[some], some * n + some - 1]
    lone_rows = np.flatnonzero(lone)
    large = lone_rows[np.bincount(head, minlength=n)[head[lone_rows]] > 3]  # in smaller groups these two links meet all
    if len(large):
        pairs += [large * n + large[first_of(k)] for k in part_keys(token[large], near[large])]
    code = np.unique(np.concatenate(pairs))
    later, earlier = code // n, code % n
    return later[later != earlier], earlier[later != earlier], lead, lone


def part_keys(token: np.ndarray, near: np.ndarray) -> np.ndarray:
    return np.stack([mix(mix(near & p) + mix(token + np.uint64(len(RUNS) + k))) for k, p in enumerate(PARTS)])


LINK = "doc long, at long, span long, rep long, rep_at long, rep_span long"


def linked(rows: DataFrame, hot: int = HOT, sampled: int = SAMPLED) -> DataFrame:
    """doc, at, span and the rep's of windows with one min-hash; the rep comes first by (id, place).

    hot: rows of a min-hash, as a sample of ids has it, from which on it is
    split; more where that would be very many min-hashes.
    """
    hot = max(hot, rows.count() // (16 * partitions(rows)))
    ids = rows.where(F.pmod(F.xxhash64(F.lit(3), "doc"), F.lit(sampled)) == 0)
    often = ids.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > hot / sampled)
    often = F.broadcast(often.select("token", F.ceil(F.col("n") * sampled / hot).cast("int").alias("salts")))  # at most 16 a partition
    salt = F.when(F.col("salts").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("doc"), F.col("salts")))
    dealt = rows.join(often, "token", "left").withColumn("salt", salt.cast("int")).drop("salts")
    order = ("token", "salt", "doc", "at", "span")

    def run(batches):
        for cols, _, _ in chunks(keyed(batches), "group"):
            token = cols["group"]
            edge = np.concatenate([[True], token[1:] != token[:-1], [True]])
            keep = np.flatnonzero(~(edge[:-1] & edge[1:]) | (cols["salt"] > 0))  # not alone
            if not len(keep):
                continue
            doc, at, span = (cols[c][keep] for c in ("doc", "at", "span"))
            token, near, salt = token[keep].view(np.uint64), cols["near"][keep].view(np.uint64), cols["salt"][keep]
            later, earlier, lead, lone = group_links(token, near)
            other = doc[later] != doc[earlier]
            a, b = later[other], earlier[other]
            yield out_batch(doc[a], at[a], span[a], doc[b], at[b], span[b], [None] * len(a), None)
            on = np.flatnonzero((salt > 0) & lead)
            for i in range(0, len(on), 1000):  # leaders of a split group: with the keys of all of it
                some = on[i : i + 1000]
                whole = cols["token"][keep][some].view(np.uint64)
                keys = np.concatenate([run_keys(whole, near[some]), mix(whole)[None], part_keys(whole, near[some])]).T
                yield out_batch(doc[some], at[some], span[some], doc[some], at[some], span[some], keys.view(np.int64).tolist(), lone[some])

    def keyed(batches):
        for x in batches:
            token, salt = x.column("token").to_numpy(), x.column("salt").to_numpy()
            # parts of a hot min-hash are groups of their own; they lie beside each other
            group = np.where(salt > 0, (mix(token.view(np.uint64) + mix(salt.astype(np.uint64))) >> np.uint64(1)).view(np.int64), token)
            yield batch(group=group, **{c: x.column(c) for c in x.schema.names})

    def out_batch(doc, at, span, rep, rep_at, rep_span, keys, lone):
        return batch(doc=doc, at=at, span=span, rep=rep, rep_at=rep_at, rep_span=rep_span, keys=pa.array(keys, pa.list_(pa.int64())), lone=np.zeros(len(doc), bool) if lone is None else lone)

    dealt = dealt.repartition(partitions(rows), "token", "salt").sortWithinPartitions(*order)
    found = staged(dealt.mapInArrow(lean(run), LINK + ", keys array<long>, lone boolean"), "linked")
    open_ = found.where(F.col("keys").isNotNull()).select("doc", "at", "span", "lone", F.posexplode("keys").alias("kind", "key"))
    heads = open_.groupBy("key").agg(F.min(F.struct("doc", "at", "span")).alias("h"), F.count("*").alias("n")).where("n > 1").select("key", F.col("h.doc").alias("rep"), F.col("h.at").alias("rep_at"), F.col("h.span").alias("rep_span"))
    seek = open_.where(F.col("lone") | (F.col("kind") < len(RUNS)))  # the others agree with one of their part
    late = seek.join(heads, "key").where("doc <> rep").select("doc", "at", "span", "rep", "rep_at", "rep_span").distinct()
    links = found.where(F.col("keys").isNull()).select("doc", "at", "span", "rep", "rep_at", "rep_span").union(late)
    links.tables = (found,)
    return links


def covered(spans: list[tuple[int, int, int]], enough: int) -> list[tuple[int, int]]:
    """Maximal intervals that spans (first, past the last, function) of at least enough functions cover."""
    steps = sorted([(lo, 1, f) for lo, _, f in spans] + [(hi, -1, f) for _, hi, f in spans])
    many: dict[int, int] = {}
    out, since, n, i = [], None, 0, 0
    while i < len(steps):
        at = steps[i][0]
        while i < len(steps) and steps[i][0] == at:
            _, step, f = steps[i]
            was = many.get(f, 0)
            many[f] = was + step
            n += (was + step > 0) - (was > 0)
            i += 1
        if n >= enough and since is None:
            since = at
        elif n < enough and since is not None:
            out.append((since, at))
            since = None
    return out


def regions(links: list[tuple[int, int, int, int, int]], w: int, enough: int = ENOUGH, min_words: int = MIN_WORDS) -> list[tuple[int, int, int, int, int]]:
    """(rep, first and past-the-last word here, and there) of where windows of enough functions meet those of a rep.

    links: (rep, at, span, rep_at, rep_span). Windows that overlap here and
    there are one bunch; what enough functions cover of it is a region.
    """
    low, spans = (1 << 32) - 1, []
    for rep, at, span, rep_at, rep_span in links:
        c, a, b = at >> 8, span >> 32, span & low
        c2, a2, b2 = rep_at >> 8, rep_span >> 32, rep_span & low
        a, a2 = min(a, a2 + a2 // 4 + w), min(a2, a + a // 4 + w)
        b, b2 = min(b, b2 + b2 // 4 + w), min(b2, b + b // 4 + w)
        spans.append((rep, c - a, c + b + w, c2 - a2, c2 + b2 + w, at & 255, c2 - c))
    spans.sort()
    bunches = []
    for s in spans:
        last = bunches[-1] if bunches else None
        if last and last[0] == s[0] and s[1] <= last[1] and s[3] <= last[3] and s[4] >= last[2]:
            last[1], last[2], last[3] = max(last[1], s[2]), min(last[2], s[3]), max(last[3], s[4])
            last[4].append(s)
        else:
            bunches.append([s[0], s[2], s[3], s[4], [s]])
    out = []
    for rep, _, _, _, own in bunches:
        if len({s[5] for s in own}) < enough:
            continue
        for lo, hi in covered([(s[1], s[2], s[5]) for s in own], enough):
            if hi - lo < min_words:
                continue
            over = [s for s in own if s[1] < hi and s[2] > lo]
            slack = (hi - lo) // 4 + w
            lo2 = max(min(s[3] for s in over), lo + min(s[6] for s in over) - slack)
            hi2 = min(max(s[4] for s in over), hi + max(s[6] for s in over) + slack)
            out.append((rep, lo, hi, lo2, hi2))
    return out


def passages(here: np.ndarray, there: np.ndarray, w: int, min_words: int, similarity: float) -> list[tuple[int, int, int, int, int, float]]:
    """Verified (start, end, start there, end there, shared shingles, Jaccard similarity), in words."""
    if len(here) + w - 1 < min_words or len(there) + w - 1 < min_words:
        return []
    order = np.argsort(there, kind="stable")
    ordered = there[order]
    at, past = np.searchsorted(ordered, here), np.searchsorted(ordered, here, "right")
    many = past - at
    # all places there, but of shingles with very many only the first: texts of one repeated phrase would give the square of their length
    many = np.where(many > PLACES, 1, many)
    place = np.repeat(np.arange(len(here)), many)
    away = order[np.repeat(at - np.cumsum(many) + many, many) + np.arange(len(place))]
    todo, out = [], []
    if len(place):
        cut = np.flatnonzero(np.diff(place) > 3 * w) + 1
        todo = [(p, q) for p, q in zip(np.split(place, cut), np.split(away, cut), strict=True)]
    while todo:
        p, q = todo.pop()
        if p[-1] - p[0] + w < min_words:
            continue
        shift = q - p
        near = np.abs(shift - np.sort(shift)[len(shift) // 2]) <= len(p) // 4 + w
        p2, q2 = p[near], q[near]
        lo, hi, lo2, hi2 = p2[0], p2[-1] + 1, q2.min(), q2.max() + 1
        a, b = np.unique(here[lo:hi]), np.unique(there[lo2:hi2])
        shared = len(np.intersect1d(a, b, assume_unique=True))
        alike = shared / (len(a) + len(b) - shared)
        if not near.all():  # other shifts may be passages too
            todo.append((p[~near], q[~near]))
        if alike >= similarity and hi - lo + w - 1 >= min_words:
            out.append((int(lo), int(hi + w - 1), int(lo2), int(hi2 + w - 1), shared, alike))
        elif len(p2) > 1:
            gap = np.diff(p2)
            k = int(np.argmax(gap)) + 1 if gap.max() > 1 else len(p2) // 2
            todo += [(p2[:k], q2[:k]), (p2[k:], q2[k:])]
    return out


def shared_passages(docs: DataFrame, w: int = WORDS, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, hashes: int = HASHES, enough: int = ENOUGH) -> DataFrame:
    """doc_id, start_word, end_word and the representative's rep_doc_id, rep_start_word, rep_end_word, n_shared, similarity."""
    small_batches(docs.sparkSession)
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    made = staged(windows(texts, w, min_words - w + 1, hashes), "windows")
    links = linked(made)
    per_doc = links.groupBy("doc").agg(F.collect_set(F.struct("rep", "at", "span", "rep_at", "rep_span")).alias("links"))

    def join(batches):
        for x in batches:
            out = []
            for doc, found in zip(x.column("doc").to_pylist(), x.column("links").to_pylist(), strict=True):
                out += [(doc, *r) for r in regions([tuple(r[c] for c in ("rep", "at", "span", "rep_at", "rep_span")) for r in found], w, enough, min_words)]
            if out:
                yield batch(**dict(zip(("doc", "lo", "hi", "rep", "rep_lo", "rep_hi"), (list(c) for c in zip(*((d, lo, hi, r, lo2, hi2) for d, r, lo, hi, lo2, hi2 in out), strict=True)), strict=True)))

    found = staged(per_doc.mapInArrow(lean(join), "doc long, lo long, hi long, rep long, rep_lo long, rep_hi long"), "regions")
    release(made, *links.tables)
    both_ends = found.select(F.col("doc").alias("id")).union(found.select("rep"))
    texts = some_of(texts, both_ends.distinct())
    per_doc = found.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi", "rep", "rep_lo", "rep_hi")).alias("regions"))

    def cut(batches):
        zstd = pa.Codec("zstd")
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                x = whole.slice(at, 128)
                out = []
                data, offs = text_buffers(x.column("text"))
                for d, (doc, found) in enumerate(zip(x.column("doc").to_pylist(), x.column("regions").to_pylist(), strict=True)):
                    b = data[offs[d] : offs[d + 1]]
                    words = Words(b, np.array([0, len(b)]), lower=True)
                    for r in found:
                        lo, hi = max(r["lo"], 0), min(r["hi"], len(words.start))
                        if lo < hi:
                            part = b[words.start[lo] : words.end[hi - 1]].tobytes()
                            out.append((doc, lo, zstd.compress(part, asbytes=True), len(part), r["rep"], r["rep_lo"], r["rep_hi"]))
                if out:
                    yield batch(**dict(zip(("doc", "start", "part", "size", "rep", "rep_lo", "rep_hi"), map(list, zip(*out, strict=True)), strict=True)))

    parts = texts.join(per_doc, F.col("doc_id") == F.col("doc")).select("doc", "text", "regions").mapInArrow(lean(cut), "doc long, start long, part binary, size long, rep long, rep_lo long, rep_hi long")

    def verify(batches):
        last, theirs, zstd = None, None, pa.Codec("zstd")
        for x in batches:
            out = []
            data, offs = text_buffers(x.column("text"))
            rows = zip(*(x.column(c).to_pylist() for c in ("doc", "start", "part", "size", "rep", "rep_lo", "rep_hi")), strict=True)
            for d, (doc, start, part, size, rep, lo, hi) in enumerate(rows):
                raw = data[offs[d] : offs[d + 1]]
                if last is None or last[0] != rep or not np.array_equal(last[1], raw):
                    last, theirs = (rep, raw), Words(raw, np.array([0, len(raw)]), lower=True).shingles(w)[0]
                own = np.frombuffer(zstd.decompress(part, size, asbytes=True), np.uint8)
                here = Words(own, np.array([0, len(own)]), lower=True).shingles(w)[0]
                lo = max(lo, 0)
                for a, b, a2, b2, shared, alike in passages(here, theirs[lo : max(hi - w + 1, lo)], w, min_words, similarity):
                    out.append((doc, start + a, start + b, rep, lo + a2, lo + b2, shared, alike))
            if out:
                names = ("doc_id", "start_word", "end_word", "rep_doc_id", "rep_start_word", "rep_end_word", "n_shared", "similarity")
                yield batch(**dict(zip(names, map(list, zip(*out, strict=True)), strict=True)))

    both = parts.join(texts, F.col("rep") == F.col("doc_id")).select("doc", "start", "part", "size", "rep", "rep_lo", "rep_hi", "text")
    found = both.mapInArrow(lean(verify), "doc_id long, start_word long, end_word long, rep_doc_id long, rep_start_word long, rep_end_word long, n_shared long, similarity double")
    return found.groupBy("doc_id", "start_word", "end_word", "rep_doc_id", "rep_start_word", "rep_end_word").agg(F.max("n_shared").alias("n_shared"), F.max("similarity").alias("similarity"))


def classes(found: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc, start, end and first of every end of found's passages: first is the smallest document of its class.

    Passages of one document are one if they overlap by similarity of what they
    cover together; passages linked directly or by others are a class.
    """
    ends = found.select(F.col("doc_id").alias("doc"), F.col("start_word").alias("start"), F.col("end_word").alias("end"))
    ends = ends.union(found.select("rep_doc_id", "rep_start_word", "rep_end_word"))
    spans = ends.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))

    def join(batches):
        for x in batches:
            out = []
            for doc, own in zip(x.column("doc").to_pylist(), x.column("spans").to_pylist(), strict=True):
                own = [(r["start"], r["end"]) for r in own]
                lead = own[:1]
                for s, e in own:  # by start; a name is one of the spans itself, so they don't drift
                    alike = [n for n in lead if min(e, n[1]) - max(s, n[0]) >= similarity * (max(e, n[1]) - min(s, n[0]))]
                    name = alike[0] if alike else (s, e)
                    if not alike:
                        lead.append(name)
                    lead = [n for n in lead if n[1] > s]
                    out.append((doc, s, e, *name))
            if out:
                yield batch(**dict(zip(("doc", "start", "end", "lead", "lead_end"), map(list, zip(*out, strict=True)), strict=True)))

    named = staged(spans.mapInArrow(lean(join), "doc long, start long, end long, lead long, lead_end long"), "spans")
    node = F.struct("doc", "lead", "lead_end")
    ours = named.select(F.col("doc").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), node.alias("a"))
    theirs = named.select(F.col("doc").alias("rep_doc_id"), F.col("start").alias("rep_start_word"), F.col("end").alias("rep_end_word"), node.alias("b"))
    links = found.join(ours, ours.columns[:3]).join(theirs, theirs.columns[:3]).select("a", "b")
    least = components(links).select(F.col("node.doc").alias("doc"), F.col("node.lead").alias("lead"), F.col("node.lead_end").alias("lead_end"), F.col("component.doc").alias("first"))
    return named.join(least, ["doc", "lead", "lead_end"]).select("doc", "start", "end", "first")


def drop_passages(docs: DataFrame, **options) -> DataFrame:
    """docs without the passages whose class has a smaller document; other bytes of the texts stay as they are."""
    found = staged(shared_passages(docs, **options), "passages")
    gone = classes(found, options.get("similarity", SIMILARITY)).where("first < doc")
    key, cuts = free(docs.columns, "doc", "cuts")
    spans = gone.groupBy(F.col("doc").alias(key)).agg(F.collect_set(F.struct(F.col("start").alias("start_word"), F.col("end").alias("end_word"))).alias(cuts))
    joined = docs.join(spans, F.col("doc_id") == F.col(key), "left").drop(key)

    def cut(batches):
        for x in batches:
            hit = [i for i, s in enumerate(x.column(cuts)) if s.is_valid]
            col = x.column("text")
            if hit:
                data, offs = text_buffers(col)
                texts = col.to_pylist()
                for i in hit:
                    if texts[i] is None:
                        continue
                    b = data[offs[i] : offs[i + 1]]
                    words, keep = Words(b, np.array([0, len(b)]), lower=True), np.ones(len(b), bool)
                    for s in x.column(cuts)[i].as_py():
                        lo, hi = s["start_word"], min(s["end_word"], len(words.start))
                        if lo < hi:
                            keep[words.start[lo] : words.start[hi] if hi < len(words.start) else words.end[hi - 1]] = False
                    texts[i] = b[keep].tobytes().decode("utf-8", "replace")
                col = pa.array(texts, pa.string())
            yield batch(**{n: col if n == "text" else x.column(n) for n in x.schema.names if n != cuts})

    return joined.mapInArrow(lean(cut), schema_of(docs))
