"""Language identification with string kernels.

The kernel of two texts is the blended-spectrum presence kernel: the number
of character n-grams (n = 1..4) that occur in both, divided by the root of
the product of their counts. A set of landmark texts gives each text a
Nystroem feature vector (its kernels with the landmarks, whitened by the
landmarks' own kernel matrix); one-versus-rest kernel ridge regression on
these features gives a score per language. n-grams are hashed into a fixed
number of cells, so a text is one 0/1 row, and kernels and scores of a batch
are matrix products.

Learning uses a bounded sample: of each language the ``per_lang`` texts of
least id hash (``max_rows`` in all, languages take turns), each reduced to
its 0/1 row where it lies, so at most ``max_rows * cells / 8`` bytes reach
the driver. Everything else covers all rows and whole texts.

Defined cases: null texts and texts without a letter are predicted ``und``
with score 0; so is everything if there is nothing to learn from; ties go to
the language name that sorts first; repeated rows and ids are predicted row
by row; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linguaspark.llm.common import cut_lineage, pick, returning

GRAMS = (1, 2, 3, 4)
CELLS = 1 << 13
CHUNK = 1 << 20  # characters handled at once


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> itself for letters and marks, 0x20 for all others."""
    t = np.full(0x110000, 0x20, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] in "LM":
            t[c] = c
    return t


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def presence(texts: list[str]) -> np.ndarray:
    """The 0/1 rows of texts: which cells their n-grams hit. Lower-cased; runs of non-letters count as one space."""
    out = np.zeros((len(texts), CELLS), np.uint8)
    table = _letters()
    for row, text in zip(out, texts, strict=True):
        for at in range(0, len(text), CHUNK):  # chunks overlap by the longest n-gram
            part = f" {text[max(0, at - 8):at + CHUNK].lower()} "
            c = table[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)]
            c = c[np.concatenate(([True], (c[1:] != 0x20) | (c[:-1] != 0x20)))]
            h = np.zeros(len(c), np.uint32)
            for n in GRAMS:
                if len(c) < n:
                    break
                h = h[:len(c) - n + 1] * np.uint32(0x01000193) ^ c[n - 1:] * np.uint32(0x9E3779B1)
                g = h ^ (h >> np.uint32(15))
                g *= np.uint32(0x85EBCA6B)
                row[g >> np.uint32(32 - 13)] = 1
    return out


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray  # cells x m, columns divided by the root of their counts
    weights: np.ndarray    # m x languages; landmark whitening included

    def scores(self, rows: np.ndarray) -> np.ndarray:
        x = rows.astype(np.float32)
        x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        return (x @ self.landmarks) @ self.weights


def fit_model(rows: np.ndarray, langs: list[str], n_landmarks: int = 128, ridge: float = 1e-2) -> Model:
    """Nystroem features over ``n_landmarks`` rows (languages take turns) and ridge regression to +1/-1 targets."""
    names = sorted(set(langs))
    x = rows.astype(np.float64)
    x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    turn: dict[str, int] = {}
    order = []
    for i, lang in enumerate(langs):
        turn[lang] = turn.get(lang, -1) + 1
        order.append((turn[lang], i))
    picked = [i for _, i in sorted(order)[:n_landmarks]]
    marks = x[picked].T
    w, v = np.linalg.eigh(marks.T @ marks)
    keep = w > 1e-8 * w.max()
    white = v[:, keep] / np.sqrt(w[keep])
    f = (x @ marks) @ white
    y = np.where(np.array(langs)[:, None] == np.array(names)[None], 1.0, -1.0)
    share = np.array([1.0 / langs.count(a) for a in langs])[:, None] * len(langs) / len(names)  # languages weigh alike
    beta = np.linalg.solve(f.T @ (f * share) + ridge * len(langs) / 100 * np.eye(f.shape[1]), f.T @ (y * share))
    return Model(names, marks.astype(np.float32), (white @ beta).astype(np.float32))


def learning_rows(df: DataFrame, learn: Column, per_lang: int, max_rows: int) -> DataFrame:
    """The bounded sample: columns id hash, lang, text. ``df`` has id, text, lang."""
    h = F.xxhash64(F.lit(11), "id", "text")
    w = Window.partitionBy("lang").orderBy("h")
    return (df.where(learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
            .select("lang", h.alias("h"), "id").withColumn("n", F.row_number().over(w))
            .where(F.col("n") <= per_lang).orderBy("n", "lang").limit(max_rows))


def train(df: DataFrame, learn: Column, per_lang: int = 300, max_rows: int = 2400, n_landmarks: int = 128) -> Model | None:
    """Fit on the sample of ``df`` (columns id, text, lang) where ``learn`` holds; None if there is no row."""
    chosen = cut_lineage(learning_rows(df, learn, per_lang, max_rows), "langid-sample")

    @F.pandas_udf("binary")
    @returning
    def row_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.packbits(presence([t])[0]).tobytes() for t in texts])

    # ids are few and bounded; the texts are fetched by them and reduced where they lie
    got = (df.where(learn & F.col("text").isNotNull())
           .withColumn("h", F.xxhash64(F.lit(11), "id", "text"))
           .join(F.broadcast(chosen.select("h", "n", F.col("lang").alias("l"))),
                 ["h"]).where(F.col("l") == F.col("lang"))
           .select("n", "lang", "h", row_of("text").alias("bits")).toPandas())
    got = got.drop_duplicates(["lang", "h"]).sort_values(["n", "lang"])
    if got.empty:
        return None
    rows = np.stack([np.unpackbits(np.frombuffer(b, np.uint8)) for b in got.bits])
    return fit_model(rows, got["lang"].tolist(), n_landmarks)


def predict(df: DataFrame, model: Model | None, text: str = "text", keep: dict[str, str] | None = None) -> DataFrame:
    """The ``keep`` columns, ``lang_pred`` and ``score`` (0 to 1: the half-scale of the best regression value)."""
    keep = keep if keep is not None else {"doc_id": "doc_id"}
    shared = df.sparkSession.sparkContext.broadcast(model)  # cells x landmarks floats: 4 MB

    @F.pandas_udf("lang_pred string, score double")
    @returning
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            lang = np.full(len(texts), "und", object)
            score = np.zeros(len(texts))
            ok = np.array([i for i, t in enumerate(texts) if m is not None and has_letter(t)], np.int64)
            for at in range(0, len(ok), 256):
                part = ok[at:at + 256]
                s = m.scores(presence([texts.iloc[i] for i in part]))
                best = s.argmax(1)
                lang[part] = np.array(m.langs, object)[best]
                score[part] = np.clip((s[np.arange(len(part)), best] + 1) / 2, 0, 1)
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    d = pick(df, **{f"k_{c}": src for c, src in keep.items()}, text=text).withColumn("r", predicted("text"))
    return d.select(*[F.col(f"k_{c}").alias(c) for c in keep], "r.*")


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0


def identify(docs: DataFrame, **options) -> DataFrame:
    """Learn from the rows that are not held out and predict every row: doc_id, held_out, lang_pred, score.

    A null id is never learnt from (its remainder is null) and is reported as not held out.
    """
    d = pick(docs, id="doc_id", text="text", lang="lang")
    model = train(d, ~held_out(F.col("id")), **options)
    out = predict(d, model, keep={"doc_id": "id"})
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
                      "lang_pred", "score")
