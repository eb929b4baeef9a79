"""Quality rules: word counts, and how much of a text repeats by its suffix array.

A text's suffix array is built over its UTF-8 bytes by prefix doubling, from
8-byte keys up; only suffixes that still share their prefix are sorted again.
The longest common prefix (LCP) of a suffix and the one sorted before it is at
least that of the suffix one place earlier less one, and exactly that where the
bytes before both agree; only the others are compared, which makes n log n
bytes at most, and memory is a fixed number of arrays. The deepest LCP interval of at least ``min_repeat`` bytes
around a suffix is a repeated substring that can't be extended; the union of
their spans is the covered part (spans that can be extended to the left lie
inside those that can't). A text fails if the covered share or the longest
repeat's share of the text is over its limit.

Each text is judged by itself, so nothing is shuffled, and repeated rows and
ids are judged each. Defined cases: null and empty texts have no words and fail
the base rule; an empty table gives no rows; all of a text counts, however
long, in about 100 bytes of memory a byte of the text; limits are met if equal
(covered or longest just at its limit is kept). Extra columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch, small_batches
from .textvec import SPACE, each, mix

MIN_REPEAT = 50
MAX_COVERED = 0.5
MAX_LONGEST = 0.3
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
BLANK = b" \t\n\x0b\x0c\r"


def neighbour_lcp(b: np.ndarray, key: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place of the suffix array, the LCP with the suffix before it; below 8 it may be too small. key: the 8 bytes from each place on."""
    n = len(b)
    before = np.empty(n, np.int64)
    before[order[0]], before[order[1:]] = -1, order[:-1]
    own = before > 0
    own[1:] &= b[:-1] == b[before[1:] - 1]  # the bytes before both agree: one less than at the place before
    own[0] = False
    i = np.flatnonzero(~own & (before >= 0))
    i = i[key[i] == key[before[i]]]
    j, size = before[i], np.full(len(i), 8)
    here = np.arange(len(i))
    while len(here) > 64:  # many at once, 8 bytes a step
        a, c = i[here] + size[here], j[here] + size[here]
        ok = np.maximum(a, c) < n
        here, a, c = here[ok], a[ok], c[ok]
        here = here[key[a] == key[c]]
        size[here] += 8
    for k in here.tolist():
        a, c, m = i[k] + size[k], j[k] + size[k], 1024
        while max(a, c) < n:
            m = min(m, n - max(a, c))
            differ = b[a : a + m] != b[c : c + m]
            if differ.any():
                m = int(np.argmax(differ))
                a += m
                break
            a, c, m = a + m, c + m, 4 * m
        size[k] = a - i[k]
    rest = np.setdiff1d(np.arange(len(i)), here, assume_unique=True)
    a, c = i[rest] + size[rest], j[rest] + size[rest]
    differ = key[np.minimum(a, n - 1)] ^ key[np.minimum(c, n - 1)]
    for byte in range(1, 8):
        size[rest] += (differ >> np.uint64(64 - 8 * byte)) == 0
    reach = np.zeros(n, np.int64)
    reach[i] = i + np.minimum(size, n - np.maximum(i, j))
    reach = np.maximum(np.maximum.accumulate(reach) - np.arange(n), 0)
    return reach[order]


def suffix_repeats(b: np.ndarray, least: int = MIN_REPEAT) -> tuple[int, int]:
    """Bytes covered by repeated substrings of at least ``least`` (8 or more) bytes, and the longest one's length."""
    n = len(b)
    if n <= least:
        return 0, 0
    key = np.zeros(n + 8, np.uint64)
    key[:n] = b
    for step in (1, 2, 4):
        key[: n + 8 - step] = (key[: n + 8 - step] << np.uint64(8 * step)) | key[step:]
    key = key[:n]
    order = np.argsort(key)
    ordered = key[order]
    new = np.ones(n, bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]  # a group's rank is its first place
    h = 8
    while h < n:
        shared = ~new
        shared[:-1] |= ~new[1:]
        at = np.flatnonzero(shared)
        if not len(at):
            break
        pos = order[at]
        then = np.where(pos + h < n, rank[np.minimum(pos + h, n - 1)], -1) + 1
        pair = (rank[pos] << 32) | then
        by = np.argsort(pair)
        pos, pair = pos[by], pair[by]
        order[at] = pos
        new[at[1:]] = pair[1:] != pair[:-1]
        new[at[0]] = True
        rank[pos] = at[np.flatnonzero(new[at])[np.cumsum(new[at]) - 1]]
        h *= 2
    full = np.zeros(n + 1, np.int64)  # full[p]: LCP of the suffixes at places p - 1 and p
    full[:n] = neighbour_lcp(b, key, order)
    deepest = np.maximum(full[:-1], full[1:])
    far = np.flatnonzero(deepest >= least)
    if not len(far):
        return 0, 0
    edge = np.bincount(order[far], minlength=n + 1).astype(np.int64) - np.bincount(order[far] + deepest[far], minlength=n + 1)
    return int(np.count_nonzero(np.cumsum(edge[:n]) > 0)), int(full.max())


def repeated_words(hashes: np.ndarray, woffs: np.ndarray, shingles: np.ndarray, soffs: np.ndarray, w: int = 3) -> np.ndarray:
    """For each text, its words in w-word windows that it has twice or more."""
    docs, n = len(woffs) - 1, len(hashes)
    if not len(shingles):
        return np.zeros(docs, np.int64)
    doc = np.repeat(np.arange(docs), np.diff(soffs))
    own = mix(shingles ^ mix(doc.astype(np.uint64)))
    by = np.argsort(own)
    same = own[by][1:] == own[by][:-1]
    twice = np.zeros(len(own), bool)
    twice[by[1:][same]] = twice[by[:-1][same]] = True
    first = (woffs[doc] + np.arange(len(own)) - soffs[doc])[twice]
    edge = np.bincount(first, minlength=n + 1) - np.bincount(first + w, minlength=n + 1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(edge[:n]) > 0)])
    return inside[woffs[1:]] - inside[woffs[:-1]]


def judge_texts(texts: pa.Array, min_repeat: int, max_covered: float, max_longest: float) -> dict[str, np.ndarray]:
    parts = []
    for _, _, words in each(texts, lower=False):
        b, offs = words.b, words.offs
        per = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offs])
        n_words = words.counts()
        n_repeat = repeated_words(words.hash, words.woffs, *words.shingles(3))
        failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
        n_dup, covered, longest = (np.zeros(len(n_words), np.int64) for _ in range(3))
        for d in range(len(n_words)):
            own = b[offs[d] : offs[d + 1]]
            lines = [x for x in own.tobytes().split(b"\n") if x.strip(BLANK)]
            n_dup[d] = len(lines) - len(set(lines))
            covered[d], longest[d] = suffix_repeats(own, min_repeat)
        size = np.maximum(np.diff(offs), 1)
        kept = ~failed & (covered <= max_covered * size) & (longest <= max_longest * size)
        parts.append((n_words, per(~SPACE[b] & ((b & 0xC0) != 0x80)), per(SYMBOL[b]), n_dup, n_repeat, failed, kept, covered, longest))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_bytes", "longest_repeat")
    kinds = (np.int64,) * 5 + (bool,) * 2 + (np.int64,) * 2
    return {k: np.concatenate([p[i] for p in parts]).astype(t) if parts else np.zeros(0, t) for i, (k, t) in enumerate(zip(names, kinds, strict=True))}


def quality_rules(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and what the suffix array found (in bytes)."""

    small_batches(docs.sparkSession)
    def run(batches):
        for x in batches:
            yield batch(doc_id=x.column("doc_id"), **judge_texts(x.column("text"), min_repeat, max_covered, max_longest))

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_bytes long, longest_repeat long"
    )
