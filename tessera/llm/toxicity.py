"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word (letters, digits and non-ASCII bytes, A-Z in lower case) is hashed to a
row of the embedding table; filters of several widths run over each text, the
largest response of each filter is kept, and a linear layer gives the score,
scaled on rows kept from training. Scores see the text alone. Thresholds for
dropping documents are set for each language on the same kept rows. The word
vectors start from how much likelier a toxic text is to have the word; from
random vectors training gets there less far on so few rows (README).

The fit reads at most ``SAMPLE`` labelled rows (those with the smallest hashes
of their ids, of rows with equal ids one text, and no more of them than have
``SAMPLE_WORDS`` words); scoring reads all of every text and shuffles nothing.

Defined cases: null and empty texts get the score of no words; labels that are
null or lack a document are left out; of an id's labels the largest counts; with labels of one kind only, all texts
score that kind's smoothed share; a language too rare among the labels kept
uses the common threshold. Repeated rows are scored each, an empty table gives
no rows, very long texts are scored whole; of equal scores none is broken, as
all at or over a threshold go. Extra columns pass through, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, free, lean, release, schema_of, small, small_batches, staged
from .textvec import PUNCT, each

SAMPLE, SAMPLE_WORDS = 6000, 8_000_000  # rows that are learnt from, and their words in all
BITS, DIM, WIDTHS, FILTERS = 18, 8, (1, 2, 3), (12, 6, 6)
EPOCHS, ROWS = 6, 64
THRESHOLD = 0.7
LANG_ROWS = 30


def word_rows(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass
class Model:
    table: np.ndarray
    filters: list[np.ndarray]  # width * DIM x number
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict = field(default_factory=dict)

    def pooled(self, rows: np.ndarray, woffs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each text's largest response of each filter (at least 0), and where it is (-1: nowhere)."""
        docs = len(woffs) - 1
        best, where = np.zeros((docs, len(self.bias)), np.float32), np.full((docs, len(self.bias)), -1, np.int64)
        x, col = self.table[rows], 0
        for f in self.filters:
            width, n = len(f) // DIM, f.shape[1]
            places = len(rows) - width + 1
            if places > 0:
                r = x[:places] @ f[:DIM]
                for k in range(1, width):
                    r += x[k : places + k] @ f[k * DIM : (k + 1) * DIM]
                fits = np.flatnonzero(np.diff(woffs) >= width)
                last = woffs[1:][fits] - width + 1
                for k in range(1, width):  # windows that cross into the next text
                    cross = woffs[1:] - k
                    r[cross[(cross >= 0) & (cross < places)]] = -np.inf
                if len(fits):
                    start = woffs[:-1][fits]
                    top = np.maximum.reduceat(r, start, axis=0)  # what lies between one text's windows and the next one's is -inf or empty
                    top = top + self.bias[col : col + n]
                    if self._train:
                        for i, (d, a, b) in enumerate(zip(fits, start, last, strict=True)):
                            where[d, col : col + n] = np.where(top[i] > 0, a + np.argmax(r[a:b], axis=0), -1)
                    best[fits, col : col + n] = np.maximum(top, 0)
            col += n
        return best, where

    _train = False

    def score(self, rows: np.ndarray, woffs: np.ndarray) -> np.ndarray:
        z = self.pooled(rows, woffs)[0] @ self.out + self.out_bias
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * z + self.scale[1], -30, 30).astype(float)))


def train(texts: list[np.ndarray], labels: np.ndarray, langs: list, seed: int = 0, epochs: int = EPOCHS, prior: bool = True) -> Model:
    """Fit on texts given as arrays of table rows; every fifth is kept to scale scores and to set thresholds.

    prior: the table starts from word counts, else from small random vectors.
    """
    rng = np.random.default_rng(seed)
    size = 1 << BITS
    total = sum(FILTERS)
    m = Model(
        rng.normal(0, 0.05, (size, DIM)).astype(np.float32),
        [rng.normal(0, 0.3, (w * DIM, n)).astype(np.float32) for w, n in zip(WIDTHS, FILTERS, strict=True)],
        np.zeros(total, np.float32), rng.normal(0, 0.1, total).astype(np.float32), 0.0,
    )
    share = (labels.sum() + 1) / (len(labels) + 2) if len(labels) else 0.5
    if len(labels) < 10 or labels.min() == labels.max():
        m.out[:], m.out_bias = 0, float(np.log(share / (1 - share)))
        return m
    # the table's first column starts from how much likelier a toxic text is to have the word
    fit, held = np.flatnonzero(np.arange(len(texts)) % 5 != 4), np.flatnonzero(np.arange(len(texts)) % 5 == 4)
    seen = np.zeros((2, size))
    for i in fit:
        seen[labels[i]][np.unique(texts[i])] += 1
    n0, n1 = max((labels[fit] == 0).sum(), 1), max((labels[fit] == 1).sum(), 1)
    p0, p1 = (seen[0] + 0.5 * n0 / (n0 + n1)) / (n0 + 1), (seen[1] + 0.5 * n1 / (n0 + n1)) / (n1 + 1)
    sure = 1 - np.exp(-seen.sum(0) / 4)
    if prior:
        m.table[:, 0] = np.clip(np.log(p1 / p0), -1, 4) * sure
        for f in m.filters:
            f[:, :2] = 0
            f[::DIM, :2] = [[1, 0.5]] + [[0, 0.5]] * (len(f) // DIM - 1)
        col = 0
        for n in FILTERS:
            m.out[col : col + 2] = 1.0
            m.bias[col : col + 2] = -0.5
            col += n
        m.out_bias = -2.0
    else:
        m.table, m.out_bias = m.table * np.float32(0.2), -1.0
    m._train = True
    weight = np.where(labels == 1, min(n0 / n1, 5.0), 1.0)
    slow = {"t": np.full(size, 1e-2, np.float32), "f": [np.full_like(f, 1e-2) for f in m.filters], "b": np.full_like(m.bias, 1e-2), "o": np.full_like(m.out, 1e-2), "c": 1e-2}
    rate = 0.05
    for _ in range(epochs):
        order = rng.permutation(fit)
        for at in range(0, len(order), ROWS):
            some = order[at : at + ROWS]
            rows = np.concatenate([texts[i] for i in some]).astype(np.int64)
            woffs = np.concatenate([[0], np.cumsum([len(texts[i]) for i in some])])
            best, where = m.pooled(rows, woffs)
            z = best @ m.out + m.out_bias
            err = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]) * weight[some] / len(some)).astype(np.float32)
            g_out, g_best = best.T @ err + 1e-4 * m.out, np.outer(err, m.out)
            g_best[where < 0] = 0
            g_bias, col = g_best.sum(0), 0
            for f, s in zip(m.filters, slow["f"], strict=True):
                n, g = f.shape[1], np.zeros_like(f)
                d, k = np.nonzero(where[:, col : col + n] >= 0)
                p, e = where[d, col + k], g_best[d, col + k]
                for j in range(len(f) // DIM):
                    r = rows[p + j]
                    np.add.at(g[j * DIM : (j + 1) * DIM].T, k, m.table[r] * e[:, None])
                    step = e[:, None] * f[j * DIM : (j + 1) * DIM, k].T
                    np.add.at(slow["t"], r, (step**2).mean(1))
                    np.add.at(m.table, r, -rate * step / np.sqrt(slow["t"][r])[:, None])
                s += g**2
                f -= rate * g / np.sqrt(s)
                col += n
            for key, g, p in (("b", g_bias, m.bias), ("o", g_out, m.out)):
                slow[key] += g**2
                p -= rate * g / np.sqrt(slow[key])
            slow["c"] += err.sum() ** 2
            m.out_bias -= rate * err.sum() / np.sqrt(slow["c"])
    m._train = False
    pack = lambda ids: (np.concatenate([texts[i] for i in ids]), np.concatenate([[0], np.cumsum([len(texts[i]) for i in ids])]))
    some = lambda ids: [ids[i : i + ROWS] for i in range(0, len(ids), ROWS)]
    z = np.concatenate([m.pooled(*pack(ids))[0] @ m.out + m.out_bias for ids in some(held)])
    a, b, y = 1.0, 0.0, labels[held]
    for _ in range(100):  # Newton steps for the two scale parameters, with a weak pull to (1, 0)
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((p - y) * z).sum() + 0.1 * (a - 1), (p - y).sum() + 0.1 * b])
        v = p * (1 - p)
        h = np.array([[(v * z * z).sum() + 0.1, (v * z).sum()], [(v * z).sum(), v.sum() + 0.1]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(h, g), -1, 1)
    m.scale = (max(float(a), 0.05), float(b))
    score = np.concatenate([m.score(*pack(ids)) for ids in some(held)])
    spoken = np.array([langs[i] for i in held], object)
    for lang in sorted({x for x in spoken if x is not None}):
        own = spoken == lang
        if own.sum() >= LANG_ROWS and 0 < y[own].sum() < own.sum():
            tries = np.arange(0.3, 0.96, 0.05)
            hit = [(y[own & (score >= t)].sum(), (own & (score >= t)).sum()) for t in tries]
            # the F measure of rows that weren't trained on; a threshold away from the common one must be worth it
            quality = [2 * tp / (n + y[own].sum()) - 0.1 * abs(t - THRESHOLD) for (tp, n), t in zip(hit, tries, strict=True)]
            m.thresholds[lang] = round(float(tries[int(np.argmax(quality))]), 2)
    return m


def learnable(doc_id: Column) -> Column:
    """Rows that may be learnt from; the others are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_words: int = SAMPLE_WORDS) -> Model:
    """Learn from at most ``sample`` labelled rows, those with the smallest hashes of their ids, of ``sample_words`` words in all."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & learnable(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    some = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # at most ``sample`` rows of two numbers

    def run(batches):
        for x in batches:
            rows = [word_rows(words.hash[words.woffs[d] : words.woffs[d + 1]]).tobytes() for i, j, words in each(x.column("text"), lower=True, apart=PUNCT) for d in range(j - i)]
            yield batch(doc_id=x.column("doc_id"), toxic=x.column("toxic"), lang=x.column("lang"), rows=rows)

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    own = docs.select("doc_id", "text", lang.alias("lang")).join(some, "doc_id")
    # of rows with one id a single text, so that what reaches the driver has at most ``sample`` rows
    one = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min(F.struct(F.xxhash64("text"), "text", "lang")).alias("__x"))
    got = staged(one.select("doc_id", "toxic", "__x.lang", "__x.text").mapInArrow(lean(run), "doc_id long, toxic int, lang string, rows binary"), "labelled")
    sizes = got.select(F.xxhash64("doc_id").alias("h"), "doc_id", (F.octet_length("rows") / 4).cast("long").alias("n")).collect()  # at most ``sample`` rows of three numbers
    kept, words = [], 0
    for r in sorted(sizes):
        words += r["n"]
        if words <= sample_words or not kept:
            kept.append((r["doc_id"],))
    chosen = F.broadcast(small(docs.sparkSession, kept, "doc_id long"))
    table = sorted(got.join(chosen, "doc_id").collect(), key=lambda r: (r["doc_id"], bytes(r["rows"])))  # at most 4 bytes a word of ``sample_words``
    release(got)
    return train([np.frombuffer(bytes(r["rows"]), np.int32) for r in table], np.array([r["toxic"] for r in table], int), [r["lang"] for r in table])


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """docs with __score, __limit (the threshold of the row's language) and __rejected; with more underscores after, where docs has such columns."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    spoken, own_score, own_limit, rejected = free(names, "spoken", "__score", "__limit", "__rejected")

    def run(batches):
        m = sent.value
        for x in batches:
            scores = [np.zeros(0)]
            for _, _, words in each(x.column("text"), lower=True, apart=PUNCT):
                scores.append(m.score(word_rows(words.hash), words.woffs))
            score = np.concatenate(scores)
            limit = np.array([m.thresholds.get(v, THRESHOLD) for v in x.column(spoken).to_pylist()], float)
            yield batch(**{n: x.column(n) for n in names}, **{own_score: score, own_limit: limit, rejected: score >= limit})

    lang = F.col("lang").cast("string") if "lang" in names else F.lit(None).cast("string")
    return docs.withColumn(spoken, lang).mapInArrow(lean(run), schema_of(docs, f"`{own_score}` double", f"`{own_limit}` double", f"`{rejected}` boolean"))


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that aren't rejected."""
    rejected = free(docs.columns, "__rejected")[0]
    return toxicity(docs, model).where(~F.col(rejected)).select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    return toxicity(docs.select("doc_id", "text", "lang"), model).select(
        "doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"), F.col("__limit").alias("lang_threshold"), F.col("__rejected").alias("rejected")
    )
