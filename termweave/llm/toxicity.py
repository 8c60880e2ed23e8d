"""Toxicity scores from subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams (with word ends, hashed into buckets) and of the
whole word; a window of WINDOW words has the mean of its words', and a text the score of its highest window, so that a few
toxic words in a long text are not averaged away. Embeddings and softmax are fitted together by AdaGrad on a bounded sample of labelled rows,
so a misspelling that was never seen has most of its n-grams from words that were. As the last layer is linear, a
fitted model is one number for each bucket and one bias, which are broadcast; their size is fixed.

With ``window=None`` the average is that of the whole text; the README has held-out figures of both.

Cases: null and empty texts, and texts without words, get the score of the bias alone; words of any length count; equal
texts get equal scores; null ids are scored and never learned from; labels that are null are not learned from, and an id
labelled twice counts once, as toxic if either label says so; with labels of one kind only or none every score is that of the share
of toxic labels (one half of a row added); of rows that repeat an id the smallest text is learned from; an empty table gives no rows; other
columns play no part, whatever they are called, but one of the name of the score is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.plans.shared import Cut, ship

BUCKETS, DIMENSIONS, SHORTEST, LONGEST = 1 << 17, 8, 3, 5
#: Labelled rows that are learned from at most, toxic and others; and bytes of their texts at most, together, before any reach the driver.
SAMPLE, SAMPLE_BYTES = (2500, 5000), 32 << 20
#: Words in fewer texts are not learned from. CALM is what AdaGrad's sums start at: the larger, the less rare n-grams move.
EPOCHS, ROUNDS, BATCH, RATE, LEAST_TEXTS, CALM = 4, 3, 64, 2.0, 2, 1e-4
#: Words in a row that a text's score comes from.
WINDOW = 64
#: Words in one generation of those that a worker remembers the scores of; when it is full it becomes the old one, from which words
#: that come up again move on.
REMEMBERED = 150_000
_ENDS = b".,;:!?\"'()[]{}|*%&$#@-_"


def unrepeated(text: bytes) -> list[bytes]:
    """Words of a text, where a word that stands several times in a row counts once."""
    words = text.lower().split()
    return [w for w, before in zip(words, [b"", *words]) if w != before]


def words_of(text: bytes) -> list[bytes]:
    return [w for w in (x.strip(_ENDS) for x in unrepeated(text)) if w]


def grams(word: bytes) -> list[int]:
    """Buckets of a word's n-grams and of the whole word."""
    s = f"<{word.decode('utf-8', 'replace').lower()}>"
    n = len(s)
    out = [zlib.crc32(s[i : i + k].encode()) % BUCKETS for k in range(SHORTEST, LONGEST + 1) for i in range(n - k + 1)]
    return [*out, zlib.crc32(b"=" + s.encode()) % BUCKETS]


@dataclass
class Model:
    weights: np.ndarray  # by bucket: what one n-gram adds to the log odds
    bias: float
    window: int | None = WINDOW

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        own = [grams(w) for w in words]
        if not own:
            return np.empty(0)
        starts = np.cumsum([0, *map(len, own[:-1])])
        flat = np.fromiter((g for x in own for g in x), np.int64)
        return np.add.reduceat(self.weights[flat], starts) / np.array([*map(len, own)])


def best_window(scores: np.ndarray, window: int | None = WINDOW) -> tuple[float, int]:
    """Largest mean of so many words in a row (of all, if there are fewer or there is no window), and where it starts."""
    n = len(scores)
    if window is None or n <= window:
        return (float(scores.mean()) if n else 0.0), 0
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    means = (sums[window:] - sums[:-window]) / window
    at = int(means.argmax())
    return float(means[at]), at


class _Fitter:
    """Embeddings and softmax with AdaGrad's sums, over word ids whose n-grams are listed flat."""

    def __init__(self, own: list[np.ndarray], seed: int):
        self.sizes = np.array([len(x) for x in own])
        self.starts, self.flat = np.concatenate(([0], np.cumsum(self.sizes))), np.concatenate(own)
        self.rng = np.random.default_rng(seed)
        self.emb = self.rng.uniform(-1e-3, 1e-3, (BUCKETS, DIMENSIONS)).astype(np.float32)
        self.head = self.rng.uniform(-1, 1, (DIMENSIONS, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.sums = [np.full(BUCKETS, CALM, np.float32), np.full((DIMENSIONS, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)]

    def word_scores(self) -> np.ndarray:
        weights = self.emb @ (self.head[:, 1] - self.head[:, 0])
        sums = np.concatenate(([0.0], np.cumsum(weights[self.flat], dtype=np.float64)))
        return (sums[self.starts[1:]] - sums[self.starts[:-1]]) / np.maximum(self.sizes, 1)

    def run(self, examples: list[np.ndarray], y: np.ndarray, epochs: int) -> None:
        for epoch in range(epochs):
            order = self.rng.permutation(len(examples))
            for at in range(0, len(order), BATCH):
                self._step([examples[d] for d in order[at : at + BATCH]], y[order[at : at + BATCH]], RATE * (1 - epoch / epochs))

    def _step(self, batch: list[np.ndarray], y: np.ndarray, rate: float) -> None:
        lengths = np.array([len(x) for x in batch])
        w, row = np.concatenate(batch), np.repeat(np.arange(len(batch)), lengths)
        keep = self.sizes[w] > 0
        w, row = w[keep], row[keep]
        if not len(w):
            return
        f = 1 / lengths[row]
        seen, inside = np.unique(w, return_inverse=True)
        n = self.sizes[seen]
        ends = np.cumsum(n)
        g = self.flat[np.repeat(self.starts[seen] - (ends - n), n) + np.arange(ends[-1])]
        vec = np.add.reduceat(self.emb[g], ends - n, axis=0) / n[:, None]
        hidden = np.stack([np.bincount(row, f * vec[inside, j], len(batch)) for j in range(DIMENSIONS)], 1)
        logit = hidden @ self.head + self.bias
        p = np.exp(logit - logit.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(batch)), y] -= 1
        d_hidden = p @ self.head.T
        d_word = np.stack([np.bincount(inside, f * d_hidden[row, j], len(seen)) for j in range(DIMENSIONS)], 1) / n[:, None]
        touched, place = np.unique(g, return_inverse=True)
        owner = np.repeat(np.arange(len(seen)), n)
        d_emb = np.stack([np.bincount(place, d_word[owner, j], len(touched)) for j in range(DIMENSIONS)], 1).astype(np.float32)
        self.sums[0][touched] += (d_emb**2).mean(1)
        self.emb[touched] -= rate * d_emb / np.sqrt(self.sums[0][touched])[:, None]
        for k, (what, d) in enumerate(((self.head, hidden.T @ p / len(batch)), (self.bias, p.mean(0))), 1):
            self.sums[k] += d**2
            what -= (0.1 * rate * d / np.sqrt(self.sums[k])).astype(np.float32)


def fit(texts: list[bytes], toxic: np.ndarray, seed: int = 7, window: int | None = WINDOW) -> Model:
    """Fit on whole texts. Without a window every text is represented by all its words. With one, first toxic texts stand against windows of the others, any of which is clean; then, in ROUNDS,
    every text is represented by the window that scores highest so far, the one that its own score comes from."""
    share = (toxic.sum() + 0.5) / (len(toxic) + 1) if len(toxic) else 0.5
    ids: dict[bytes, int] = {}
    docs = [np.array([ids.setdefault(w, len(ids)) for w in words_of(t)], np.int32) for t in texts]
    has = [k for k, d in enumerate(docs) if len(d)]
    docs, y = [docs[k] for k in has], toxic[has]
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))), window)
    often = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=len(ids)) >= LEAST_TEXTS
    fitter = _Fitter([np.array(grams(w) if o else (), np.int32) for w, o in zip(ids, often.tolist())], seed)
    model = lambda: Model((fitter.emb @ (fitter.head[:, 1] - fitter.head[:, 0])).astype(np.float64), float(fitter.bias[1] - fitter.bias[0]), window)
    if window is None:
        fitter.run(docs, y, EPOCHS * (1 + ROUNDS))
        return model()
    cut = lambda d, n: d[(a := int(fitter.rng.integers(max(1, len(d) - n + 1)))) : a + n]
    first = [d if t else cut(d, window) for d, t in zip(docs, y)]
    short = [cut(d, n) for d, t in zip(docs, y) if not t for n in (1, 1, 8)]
    fitter.run(first + short, np.concatenate((y, np.zeros(len(short), np.int64))), EPOCHS)
    for _ in range(ROUNDS):
        scores = fitter.word_scores()
        picked = [d[(a := best_window(scores[d], window)[1]) : a + window] for d in docs]
        fitter.run(picked + short, np.concatenate((y, np.zeros(len(short), np.int64))), EPOCHS)
    return model()


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Rows that are never learned from; a null id is one of them."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", sample: tuple[int, int] = SAMPLE, window: int | None = WINDOW) -> Model:
    """Fit on labelled rows that are not held out: of each kind those of the smallest hashes of their ids, to the bounds.

    The sample is written first, one row an id; its ids and lengths decide which texts are fetched, so that SAMPLE_BYTES of texts
    come to the driver at most.
    """
    marked = labels.where(F.col(toxic_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("k")).agg(F.max(F.col(toxic_col).cast("int")).alias("y"))
    part = lambda y, n: marked.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(n)
    chosen = part(1, sample[0]).unionByName(part(0, sample[1]))
    text = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("t"))
    found = text.join(F.broadcast(chosen), F.col("i") == F.col("k"))  # the sample's size is bounded
    taken = Cut(found.groupBy("i", "y").agg(F.min("t").alias("t")), "sample").df
    kept, total = [], 0
    for r in taken.select("i", F.length("t").alias("n")).orderBy(F.xxhash64("i"), "i").collect():  # one row an id of the sample
        if total + r.n <= SAMPLE_BYTES:
            kept.append(r.i)
            total += r.n
    rows = sorted(((r.i, r.y, bytes(r.t)) for r in taken.where(F.col("i").isin(kept)).toLocalIterator()), key=lambda r: r[0])
    return fit([r[2] for r in rows], np.array([r[1] for r in rows], np.int64), window=window)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with one more column, the probability of toxicity."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m, known, old = sent.value, {}, {}
        for texts in batches:
            out = []
            for at in range(0, len(texts), 256):
                docs = [unrepeated(x) for x in texts.iloc[at : at + 256]]
                new = set().union(*docs).difference(known)
                if len(known) + len(new) > REMEMBERED:
                    known, old = {}, known
                    new = set().union(*docs)
                again = [w for w in new if w in old]
                known.update((w, old[w]) for w in again)
                new = list(new.difference(again))
                bare = [w.strip(_ENDS) for w in new]
                real = [w for w in set(bare) if w]
                scores = dict(zip(real, m.word_scores(real).tolist()))
                known.update((w, scores.get(b)) for w, b in zip(new, bare))
                for d in docs:
                    got = [s for s in map(known.__getitem__, d) if s is not None]
                    out.append(m.bias + best_window(np.array(got), m.window)[0])
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(out), -500, 500))))

    return docs.withColumn(out_col, run(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = score(docs.select("doc_id", "text"), train(docs, labels))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
