"""Toxicity from bags of subwords.

A word is the bag of its character n-grams (3 to 6 characters of
``<word>``, hashed into ``CELLS`` cells), each with an embedding; a window
of ``WINDOW`` neighbouring words is the average of all its n-grams'
embeddings, and a linear softmax on it gives the probability of the toxic
class. A text scores as its most toxic window does, so a few words are not
lost in a long text. As n-grams are shared, a misspelt or newly formed word
that was never seen still meets the vectors of what it resembles.

Embeddings and softmax are trained together in numpy, by full-batch Adam. A
label is known for the text only, so the windows of a toxic text share one
unit of weight by their present probability (at first evenly), while all
windows of a clean text count as clean, the most toxic one by itself as
much as all others together. A part of the n-grams is left out anew in each step, so no
single n-gram carries a word alone.

Learning uses a bounded sample of the labelled rows: at most ``n_toxic`` and
``n_clean`` texts of the classes, those of least id hash among the texts of
at most ``max_chars`` characters, so at most ``(n_toxic + n_clean) *
max_chars`` characters reach the driver. Scoring covers all rows and whole texts; the
model handed to the tasks is one number a cell (the softmax is linear, so an
n-gram's embedding enters by its product with the weights only).

Defined cases: null, empty and blank texts score as an empty bag does (the
bias alone); without a learnable row of either class every score is 0;
repeated rows and ids are scored row by row; a document with several labels
is toxic if any of them says so; null ids and null labels are never learnt
from; other columns are not read, clashing names are resolved as in ``pick``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linguaspark.llm.common import cut_lineage, pick, returning

GRAMS = (3, 4, 5, 6)
CELL_BITS = 17
CELLS = 1 << CELL_BITS
WINDOW = 5
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»„“”‘’…–—"
CACHED = 1 << 18   # words whose sums a worker keeps; then it starts anew
LONGEST = 64       # longer words are not kept


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(cells of all n-grams, number of n-grams of each word); signs at a word's edges do not belong to it."""
    full = [f"<{w.strip(EDGES) or w}>" for w in words]
    if not full:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = np.frombuffer("".join(full).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(w) for w in full], np.int64)
    end = np.repeat(np.cumsum(size), size)  # of each character's word
    word = np.repeat(np.arange(len(full)), size)
    h = np.zeros(len(c), np.uint32)
    cells, owner = [], []
    for n in range(1, GRAMS[-1] + 1):
        if len(c) < n:
            break
        h = h[:len(c) - n + 1] * np.uint32(0x01000193) ^ c[n - 1:] * np.uint32(0x9E3779B1)
        if n in GRAMS:
            inside = np.flatnonzero(np.arange(len(h)) + n <= end[:len(h)])
            g = h[inside]
            g = (g ^ (g >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n * 0x27D4EB2F)
            cells.append(((g ^ (g >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - CELL_BITS)).astype(np.int64))
            owner.append(word[inside])
    cells, owner = np.concatenate(cells) if cells else np.empty(0, np.int64), np.concatenate(owner) if owner else np.empty(0, np.int64)
    turn = np.argsort(owner, kind="stable")
    return cells[turn], np.bincount(owner, minlength=len(full)).astype(np.int64)


def _window_ends(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, end) of every window of the texts that begin at ``starts`` (of ``n`` words in all); short texts are one window."""
    stop = np.append(starts[1:], n)
    first = np.arange(n)
    text = np.repeat(np.arange(len(starts)), stop - starts)
    ok = (first + WINDOW <= stop[text]) | (first == starts[text])
    first = first[ok]
    return first, np.minimum(first + WINDOW, stop[text[ok]])


@dataclass
class Model:
    """``weight``: the product of each cell's embedding with the difference of the class weights; and the bias' difference."""

    weight: np.ndarray
    bias: float
    number: dict[str, int] = field(default_factory=dict)
    sums: np.ndarray = field(default_factory=lambda: np.empty((0, 2)))

    def word_sums(self, words: list[str]) -> np.ndarray:
        """Summed weights and number of n-grams of words (two columns)."""
        cells, size = grams_of(words)
        total = np.concatenate(([0.0], np.cumsum(self.weight[cells], dtype=np.float64)))
        end = np.cumsum(size)
        return np.stack((total[end] - total[end - size], size), 1)

    def word_numbers(self, words: list[str]) -> np.ndarray:
        """Rows of ``sums`` for words; those seen before are not summed again."""
        if len(self.number) > CACHED:
            self.number, self.sums = {}, np.empty((0, 2))
        number, base = self.number, len(self.sums)
        out, fresh = np.empty(len(words), np.int64), []
        for i, w in enumerate(words):
            k = number.get(w)
            if k is None:
                k = base + len(fresh)
                fresh.append(w)
                if len(w) <= LONGEST:
                    number[w] = k
            out[i] = k
        if fresh:
            self.sums = np.concatenate((self.sums, self.word_sums(fresh)))
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of the most toxic window of each text."""
        words = [tokens(t) for t in texts]
        size = np.array([len(w) for w in words], np.int64)
        best = np.full(len(texts), self.bias)
        some = np.flatnonzero(size)
        if len(some):
            k = self.word_numbers([w for ws in words for w in ws])
            total = np.concatenate((np.zeros((1, 2)), np.cumsum(self.sums[k], 0)))
            starts = (np.cumsum(size) - size)[some]
            first, end = _window_ends(starts, len(k))
            s = total[end] - total[first]
            z = s[:, 0] / np.maximum(s[:, 1], 1) + self.bias
            best[some] = np.maximum.reduceat(z, np.searchsorted(first, starts))
        return 1 / (1 + np.exp(-np.clip(best, -50, 50)))


def fit(texts: list[str], toxic: np.ndarray, dim: int = 16, steps: int = 60, rate: float = 0.03, left_out: float = 0.3,
        decay: float = 1e-5, seed: int = 12) -> Model:
    """Embeddings (cells x dim) and softmax (dim x 2) trained together on whole texts with labels 0 and 1."""
    rng = np.random.default_rng(seed)
    words = [tokens(t) for t in texts]
    some = [i for i, w in enumerate(words) if w]
    number: dict[str, int] = {}
    size = np.array([len(words[i]) for i in some], np.int64)
    seq = np.fromiter((number.setdefault(w, len(number)) for i in some for w in words[i]), np.int32, int(size.sum()))
    del words, texts
    y = np.asarray(toxic, np.float64)[some]
    starts = np.cumsum(size) - size
    first, end = _window_ends(starts, len(seq))
    at = np.searchsorted(first, starts)  # first window of each text
    count = np.diff(np.append(at, len(first)))
    text = np.repeat(np.arange(len(some)), count)
    cells, grams = grams_of(list(number))
    cells = cells.astype(np.int32)
    owner = np.repeat(np.arange(len(number), dtype=np.int32), grams)
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))[text]  # both classes weigh alike
    even, wanted = 1 / count[text], y[text]

    table = rng.uniform(-0.05, 0.05, (CELLS, dim)).astype(np.float32)
    head = rng.uniform(-0.5, 0.5, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    params = [table, head, bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]

    for step in range(1, steps + 1):
        kept = rng.random(len(cells), np.float32) >= left_out
        c, o = cells[kept], owner[kept]
        apart = head[:, 1] - head[:, 0]
        # averaging and the head are linear: n-grams may meet the head first, and of two classes the difference is enough
        word = np.bincount(o, (table @ apart)[c], len(number))
        n_word = np.bincount(o, minlength=len(number))
        total = np.concatenate(([0.0], np.cumsum(word[seq])))
        n_total = np.concatenate(([0], np.cumsum(n_word[seq])))
        n_window = np.maximum(n_total[end] - n_total[first], 1)
        z = (total[end] - total[first]) / n_window + (bias[1] - bias[0])
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        # windows of a toxic text: evenly at first, then by their odds; of a clean one: the most toxic and the mean of all
        sharp = np.exp(np.clip(min(1.0, step / (0.3 * steps)) * 4 * (z - np.maximum.reduceat(z, at)[text]), -50, 0))
        sharp /= np.add.reduceat(sharp, at)[text]
        g = (p - wanted) * share * np.where(wanted == 1, sharp, 0.5 * even + 0.5 * sharp)
        d_bias = g.sum() + 0.1 / (1 + np.exp(float(bias[0] - bias[1])))  # a bag without words is clean
        g /= n_window
        edge = np.bincount(first, g, len(seq) + 1) - np.bincount(end, g, len(seq) + 1)  # each window's gradient goes to all its words
        d_word = np.bincount(seq, np.cumsum(edge[:-1]), len(number))
        d_cell = np.bincount(c, d_word[o], CELLS).astype(np.float32)
        d_head = table.T @ d_cell
        grads = [d_cell[:, None] * apart + decay * table, np.stack((-d_head, d_head), 1) + decay * head,
                 np.array([-d_bias, d_bias], np.float32)]
        for q, d, (m, v) in zip(params, grads, moments, strict=True):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            q -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return Model(table @ (head[:, 1] - head[:, 0]), float(bias[1] - bias[0]))


def learning_rows(docs: DataFrame, labels: DataFrame, learn: Column, n_toxic: int, n_clean: int, max_chars: int) -> DataFrame:
    """The bounded sample: (toxic, h, text), h the hash it was chosen by. ``docs`` has id, text; ``labels`` has id, toxic."""
    marked = labels.where(learn & F.col("toxic").isin(0, 1)).groupBy("id").agg(F.max("toxic").alias("toxic"))
    h = F.xxhash64(F.lit(12), "id", "text")
    short = docs.where(learn & F.col("text").isNotNull() & (F.length("text") <= max_chars)).select("id", h.alias("h"))
    found = short.join(marked, "id")
    chosen = functools.reduce(DataFrame.unionByName, [  # each task hands on its least rows only
        found.where(F.col("toxic") == c).orderBy("h", "id").limit(n) for c, n in ((1, n_toxic), (0, n_clean))])
    chosen = cut_lineage(chosen.select("id", F.col("h").alias("hh"), "toxic"), "toxicity-sample")  # bounded rows of numbers
    return (docs.withColumn("h", h).join(F.broadcast(chosen), ["id"]).where("h = hh")
            .dropDuplicates(["id", "h"]).select("toxic", "h", "text"))


def train(docs: DataFrame, labels: DataFrame, learn: Column, n_toxic: int = 1000, n_clean: int = 2000, max_chars: int = 8000,
          **options) -> Model | None:
    """Fit on the sample of labelled rows where ``learn`` (over id) holds; None unless both classes occur."""
    got = learning_rows(docs, labels, learn, n_toxic, n_clean, max_chars).toPandas().sort_values(["toxic", "h"])
    got = got[got["text"].str.strip() != ""]
    if set(got["toxic"]) != {0, 1}:
        return None
    return fit(got["text"].tolist(), got["toxic"].to_numpy(), **options)


def score(df: DataFrame, model: Model | None, text: str = "text", keep: dict[str, str] | None = None) -> DataFrame:
    """The ``keep`` columns (default doc_id) and ``score``, 0 to 1, of every whole text."""
    keep = keep if keep is not None else {"doc_id": "doc_id"}
    shared = df.sparkSession.sparkContext.broadcast(model and (model.weight, model.bias))  # one float a cell: 0.5 MB

    @F.pandas_udf("double")
    @returning
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value and Model(*shared.value)
        for texts in batches:
            yield pd.Series(m.scores(texts.tolist()) if m else np.zeros(len(texts)))

    d = pick(df, **{f"k_{c}": src for c, src in keep.items()}, text=text).withColumn("score", scored("text"))
    return d.select(*[F.col(f"k_{c}").alias(c) for c in keep], "score")


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """Learn from the rows that are not held out, score every row: doc_id, held_out, score, predicted.

    A null id is never learnt from (its remainder is null) and is reported as not held out.
    """
    d = pick(docs, id="doc_id", text="text")
    model = train(d, pick(labels, id="doc_id", toxic="toxic"), ~held_out(F.col("id")), **options)
    out = score(d, model, keep={"doc_id": "id"})
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
