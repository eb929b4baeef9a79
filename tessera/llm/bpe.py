"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string exactly one token can be the last one of its
encoding: the token ``t`` over its end such that the encoding of what comes
before ends in a token that ``t`` may follow. Two tokens may follow each other
if merging their joined bytes gives back those two. ``Prefixes`` keeps these
last tokens, so bytes can be appended exactly, and after an edit only prefixes
near it are computed again. Reading the last tokens backwards gives the ids.

Texts are cut as the tokenizer's pattern cuts them. A single space between two
characters that aren't white space always starts a match, so text is split
there first and each distinct chunk encoded once a worker, up to a bound.

Defined cases: a null text is an empty one, with no tokens; each row is
encoded by itself, so repeated rows and ties don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from .common import CACHES, Memo, batch, small_batches

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
KEEP = 500_000  # chunks and pieces that a worker remembers, each at most twice as many
STEMS = (8, 6, 4)  # bytes at the beginning of a piece whose prefixes are remembered apart
#: A space beside other white space; there the pattern may match across it.
RUN = re.compile(r"\s | \s")


class Vocabulary:
    """Ranks, the merge rule on byte strings, and which token may follow which."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = [b""] * (max(self.ids.values()) + 1)
        for token, i in self.ids.items():
            self.bytes[i] = token
        self.decimal = [b"%d" % i for i in range(len(self.bytes))]
        self.longest = max(map(len, self.ids))
        #: Of each token that merging its bytes gives, the two parts of the last merge; none for single bytes.
        self.halves: list[tuple[int, int] | None] = [None] * len(self.bytes)
        #: Every end of a token: the token that it is, if merging its bytes gives that token, else -1.
        self.ends = {t[i:]: -1 for t in self.ids for i in range(len(t))}
        for token, i in self.ids.items():
            parts = self.merge(token, 2)
            if len(parts) <= 2:
                self.ends[token] = i
                self.halves[i] = tuple(parts) if len(parts) == 2 else None
        #: Whether every merge ranks after those that made its parts, so that merges happen in order of rank.
        self.ordered = all(h is None or max(h) < i for i, h in enumerate(self.halves))
        self.known: dict[int, bool] = {}

    def merge(self, data: bytes, until: int = 1) -> list[int]:
        """Merges of lowest rank first, until so many parts are left: the definition, for short strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            ranks = [self.ids.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == 1 << 60:
                break
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ids[p] for p in parts]

    def follows(self, a: int, b: int) -> bool:
        key = a << 32 | b
        if (found := self.known.get(key)) is None:
            if len(self.known) > 500_000:
                self.known.clear()
            found = self.known[key] = self.apart(a, b) if self.ordered else self.merge(self.bytes[a] + self.bytes[b]) == [a, b]
        return found

    def apart(self, a: int, b: int) -> bool:
        """Whether no merge goes across the border of two tokens, by undoing their own merges, the latest first.

        The parts at the border stay until the merge undone last takes one of
        them; a merge across ranks before that one if it happens. Of equal
        ranks the left one merges first.
        """
        joined, halves, until = self.bytes, self.halves, 1 << 60
        while True:
            if self.ids.get(joined[a] + joined[b], 1 << 60) < until:
                return False
            x, y = halves[a], halves[b]
            if x and (a > b or not y):
                until, a = a, x[1]
            elif y:
                until, b = b + 1, y[0]
            else:
                return True


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Prefixes:
    """One byte string and the last token of each of its prefixes (last[i]: of the first i + 1 bytes)."""

    def __init__(self, vocab: Vocabulary, data: bytes = b"", last: tuple[int, ...] = ()):
        """last: what is known already of the first prefixes."""
        self.vocab, self.data, self.last = vocab, data, list(last)
        self._extend(len(data))

    def _extend(self, upto: int) -> None:
        """The last tokens of the prefixes up to so many bytes."""
        vocab, data, last = self.vocab, self.data, self.last
        ends, known = vocab.ends, vocab.known
        for end in range(len(last) + 1, upto + 1):
            start = end
            while True:
                start -= 1
                token = ends[data[start:end]]
                if token >= 0:
                    if start == 0:
                        break
                    fits = known.get(last[start - 1] << 32 | token)
                    if vocab.follows(last[start - 1], token) if fits is None else fits:
                        break
            last.append(token)

    def append(self, more: bytes) -> None:
        self.data += more
        self._extend(len(self.data))

    def edit(self, at: int, removed: int, inserted: bytes) -> int:
        """Replace bytes; gives how many prefixes were computed again.

        Past the edit the old tokens hold again as soon as as many in a row
        agree as the longest token has bytes, for a last token depends on no
        earlier ones.
        """
        old, shift = self.last, len(inserted) - removed
        self.data = self.data[:at] + inserted + self.data[at + removed :]
        self.last = old[:at]
        longest, agreed, end = self.vocab.longest, 0, at
        while end < len(self.data):
            end += 1
            self._extend(end)
            inside = end > at + len(inserted)
            agreed = agreed + 1 if inside and self.last[-1] == old[end - 1 - shift] else 0
            if agreed >= longest:
                break
        self.last += old[end - shift :] if end < len(self.data) else []
        return end - at

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocab.bytes[out[-1]])
        return out[::-1]


class Encoder:
    def __init__(self, path: str, keep: int = KEEP, pattern: str = public_tokenizers.PATTERN):
        self.vocab, self.pattern = vocabulary(path), regex.compile(pattern)
        self.pieces, self.stems = Memo(self._ids, keep), Memo(self._stem, keep // 4)
        self.first, self.spaced = Memo(self._chunk, 1000), Memo(lambda c: self._chunk(" " + c), keep)

    def _ids(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        whole = self.vocab.ids.get(data)
        return (whole,) if whole is not None else tuple(Prefixes(self.vocab, data, self.stems[data[: STEMS[0]]]).ids())

    def _stem(self, data: bytes) -> tuple[int, ...]:
        """The last tokens of a piece's beginning, which many pieces share."""
        shorter = next((n for n in STEMS if n < len(data)), 0)
        return tuple(Prefixes(self.vocab, data, self.stems[data[:shorter]] if shorter else ()).last)

    def plain(self, text: str) -> list[int] | tuple[int, ...]:
        found = self.pattern.findall(text)
        # A chunk that is one piece is remembered itself.
        return self._ids(text) if len(found) == 1 else [i for p in found for i in self.pieces[p]]

    def _chunk(self, chunk: str) -> tuple[bytes, bytes]:
        ids = self.plain(chunk)
        return b",".join(map(self.vocab.decimal.__getitem__, ids)), array("I", ids).tobytes()

    def encode(self, text: str) -> tuple[bytes, np.ndarray]:
        """The ids in decimal, joined by commas, and as an array."""
        if RUN.search(text):
            decimal, packed = self._chunk(text)
            return decimal, np.frombuffer(packed, np.uint32)
        first, *rest = text.split(" ")
        parts = [self.first[first], *map(self.spaced.__getitem__, rest)]
        return b",".join([p[0] for p in parts if p[0]]), np.frombuffer(b"".join([p[1] for p in parts]), np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocab.bytes.__getitem__, ids.tolist()))


@lru_cache(maxsize=4)
def encoder(path: str, keep: int = KEEP) -> Encoder:
    return Encoder(path, keep)


CACHES += [vocabulary, encoder]


def encode_decode(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, the digests of ids and decoded bytes, and with_ids also ids and decoded."""
    small_batches(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        coder = encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                x = whole.slice(at, 256)
                rows = []
                for text in x.column("text"):
                    decimal, ids = coder.encode(text.as_py() or "")
                    back = coder.decode(ids)
                    row = (len(ids), hashlib.sha256(decimal).hexdigest(), hashlib.sha256(back).hexdigest())
                    rows.append(row + (ids.astype(np.int32), back) if with_ids else row)
                names = ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")
                yield batch(doc_id=x.column("doc_id"), **{n: list(c) for n, c in zip(names, zip(*rows, strict=True), strict=False)})

    more = ", ids array<int>, decoded binary" if with_ids else ""
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + more)
