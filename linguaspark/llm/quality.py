"""Quality classifier from weak labels.

Several heuristic labellers vote on every document: good, bad or no
opinion. How often each is right is not known; expectation-maximisation
estimates it from the agreement of the votes, counted over all documents.
The posterior of a document's votes is its training label for a linear
scorer on hashed features, which then scores every document.

The vote patterns of all documents are counted by Spark (at most
2^labellers rows reach the driver, whatever the input). Features for
training come from a bounded sample: the ``sample`` documents of least
hash, ``CELLS`` bytes each.

Defined cases: null, empty and white-space texts have no votes and score 0
(rejected); a text of any length is read whole; repeated rows score alike;
equal votes and scores stay equal (the threshold itself is kept); an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linguaspark.llm.common import _LOWER, Spans, cut_lineage, pick, returning, text_bytes, word_bounds

CELLS = 1 << 12
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"%#&*$@^~{}[]<>\\|=_+")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True

STATS = ("symbols", "shouting", "separators", "echoes", "variety", "word_length", "letters", "exclaims", "short_words")


def stats(buf: np.ndarray) -> np.ndarray | None:
    """Shape values of a text: shares of symbols, capitals, separator words, repeated neighbours and so on."""
    s, e = word_bounds(buf)
    n = len(s)
    if n == 0:
        return None
    h = Spans(_LOWER[buf]).hash(s, e)
    solid = np.concatenate(([0], np.cumsum(_LETTER[buf] | _DIGIT[buf], dtype=np.int64)))
    in_word = solid[e] - solid[s]
    letters = int(_LETTER[buf].sum())
    total = max(1, letters)
    return np.array([
        _SYMBOL[buf].mean(),
        _UPPER[buf].sum() / total,
        (in_word == 0).mean(),
        (h[1:] == h[:-1]).mean() if n > 1 else 0.0,
        len(np.unique(h)) / n ** 0.75,
        (e - s).mean(),
        letters / (e - s).sum(),
        (buf == 33).sum() / n,
        (e - s <= 3).mean(),
    ])


@dataclass(frozen=True)
class Labeller:
    """A range of good values and a bound of bad ones for some shape values.

    It votes bad (2) if a value is beyond its bad bound, good (1) if it may
    (``praises``) and all values are in their good range, else nothing (0).
    """

    limits: tuple[tuple[str, float, float], ...]  # (stat, least good, most good)
    praises: bool = False

    def vote(self, x: np.ndarray) -> int:
        ok = all(lo <= x[STATS.index(s)] <= hi for s, lo, hi in self.limits)
        if self.praises:
            return int(ok)
        return 0 if ok else 2


ANY = float("inf")
LABELLERS = (
    Labeller((("symbols", 0, 0.05),)),
    Labeller((("shouting", 0, 0.5),)),
    Labeller((("separators", 0, 0.2),)),
    Labeller((("echoes", 0, 0.2),)),
    Labeller((("variety", 0.3, ANY), ("echoes", 0, 0.5))),
    Labeller((("exclaims", 0, 0.3),)),
    Labeller((("letters", 0.3, 1),)),
    Labeller((("letters", 0.5, 1), ("symbols", 0, 0.03), ("shouting", 0, 0.4), ("separators", 0, 0.15),
              ("echoes", 0, 0.12), ("exclaims", 0, 0.15)), praises=True),
    Labeller((("variety", 0.4, ANY), ("short_words", 0.1, 0.75), ("word_length", 2, 8.5), ("separators", 0, 0.15)),
             praises=True),
)


def votes(x: np.ndarray | None) -> str:
    """One digit per labeller: 0 no opinion, 1 good, 2 bad."""
    return "0" * len(LABELLERS) if x is None else "".join(str(f.vote(x)) for f in LABELLERS)


def estimate(patterns: dict[str, int], rounds: int = 100, trust: float = 0.9, prior_votes: float = 10.0) -> np.ndarray:
    """Expectation-maximisation: the accuracy of each labeller, given that it votes.

    Votes are taken as independent given the class, the classes as equally
    likely before any vote. The prior opinion is that of ``prior_votes`` votes
    of which a labeller was right in ``trust``, however many votes there are;
    it steadies labellers that hardly vote and washes out for the others.
    """
    accuracy = np.full(len(LABELLERS), trust)
    if not patterns:
        return accuracy
    v = np.array([[int(c) for c in p] for p in patterns])
    n = np.array(list(patterns.values()), float)
    cast = ((v > 0) * n[:, None]).sum(0)
    for _ in range(rounds):
        good = posterior(v, accuracy)
        right = np.where(v == 1, good[:, None], 0) + np.where(v == 2, 1 - good[:, None], 0)
        accuracy = np.clip(((right * n[:, None]).sum(0) + prior_votes * trust) / (cast + prior_votes), 0.5, 0.999)
    return accuracy


def posterior(v: np.ndarray, accuracy: np.ndarray) -> np.ndarray:
    """P(good) of vote rows."""
    odds = np.log(accuracy / (1 - accuracy))
    return 1 / (1 + np.exp(-np.clip(((v == 1) * odds - (v == 2) * odds).sum(1), -50, 50)))


def features(buf: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Hashed features as small integers: root shares of byte trigrams, and the shape values in steps."""
    b = buf.astype(np.uint32)
    out = np.zeros(CELLS, np.float32)
    if len(b) >= 3:
        g = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA6B) ^ b[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
        out = np.sqrt(np.bincount(g >> np.uint32(20), minlength=CELLS) / len(g)).astype(np.float32)
    row = np.minimum(out * 400, 255).astype(np.uint8)
    for j, value in enumerate(x):
        step = int(min(15, max(0, value * (16 if value <= 1 else 1))))
        row[(j * 16 + step) * 2654435761 % (1 << 32) >> 20] = 100
    return row


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(rows.astype(np.float32) / 100 @ self.weights + self.bias, -30, 30)))


def fit_scorer(rows: np.ndarray, target: np.ndarray, rounds: int = 200, rate: float = 0.05, decay: float = 1e-4) -> Scorer:
    """Logistic regression on soft targets, the classes weighing alike (Adam, full batch)."""
    w, b, m1, m2 = np.zeros(CELLS + 1, np.float32), 0, 0.0, 0.0
    x = np.concatenate((rows.astype(np.float32) / 100, np.ones((len(rows), 1), np.float32)), 1)
    bad, good = max(1e-6, (1 - target).sum()), max(1e-6, target.sum())
    weight = (target / good + (1 - target) / bad) / 2
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ ((p - target) * weight).astype(np.float32) + decay * w
        m1 = 0.9 * m1 + 0.1 * g
        m2 = 0.99 * m2 + 0.01 * g * g
        w = w - rate * (m1 / (1 - 0.9 ** t)) / (np.sqrt(m2 / (1 - 0.99 ** t)) + 1e-8)
    return Scorer(w[:-1].astype(np.float32), float(w[-1]))


def train(d: DataFrame, sample: int = 4000) -> Scorer | None:
    """Fit on ``d`` (a column text): EM over the votes of all rows, the scorer on the sample; None without text."""
    @F.pandas_udf("string")
    def cast_votes(texts: pd.Series) -> pd.Series:
        return pd.Series([votes(stats(text_bytes(t))) for t in texts])

    counts = d.select(cast_votes("text").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect()
    accuracy = estimate({r["v"]: r["n"] for r in counts})

    @F.pandas_udf("v string, row binary")
    def features_of(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            buf = text_bytes(t)
            x = stats(buf)
            out.append((votes(x), None if x is None else features(buf, x).tobytes()))
        return pd.DataFrame(out, columns=["v", "row"])

    h = F.xxhash64(F.lit(8), "text").alias("h")
    least = cut_lineage(d.where("text is not null").select(h).distinct().orderBy("h").limit(sample), "quality-sample")
    got = (d.where("text is not null").select(h, "text").join(F.broadcast(least), "h")
           .groupBy("h").agg(F.min("text").alias("text")).select("h", features_of("text").alias("r"))
           .where("r.row is not null").select("h", "r.*").orderBy("h").toPandas())
    if got.empty:
        return None
    got = got[got["v"] != votes(None)]  # without a vote there is nothing to learn
    if got.empty:
        return None
    target = posterior(np.array([[int(c) for c in p] for p in got["v"]]), accuracy)
    rows = np.stack([np.frombuffer(r, np.uint8) for r in got["row"]])
    return fit_scorer(rows, target)


def score(df: DataFrame, text: str = "text", keep: dict[str, str] | None = None, threshold: float = 0.3,
          sample: int = 4000) -> DataFrame:
    """The ``keep`` columns, ``score`` (0 to 1) and ``accepted`` of every row; learns from ``df`` itself."""
    keep = keep if keep is not None else {"doc_id": "doc_id"}
    shared = df.sparkSession.sparkContext.broadcast(train(pick(df, text=text), sample))

    @F.pandas_udf("double")
    @returning
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = np.zeros(len(texts))
            for at in range(0, len(texts), 512):
                rows, place = [], []
                for i, t in enumerate(texts.iloc[at:at + 512], at):
                    buf = text_bytes(t)
                    x = stats(buf)
                    if x is not None:
                        rows.append(features(buf, x))
                        place.append(i)
                if rows and shared.value is not None:
                    out[place] = shared.value.score(np.stack(rows))
            yield pd.Series(out)

    d = pick(df, **{f"k_{c}": src for c, src in keep.items()}, text=text).withColumn("score", scored("text"))
    return d.select(*[F.col(f"k_{c}").alias(c) for c in keep], "score", (F.col("score") >= threshold).alias("accepted"))
