"""Toxicity: scores against a plain version, held-out accuracy, misspellings, odd rows."""

import math
import zlib

import numpy as np

from linguaspark.llm import queries, toxicity


def plain_score(model, text):
    """The most toxic window by its own definition, word by word."""
    w = toxicity.tokens(text)
    margins = []
    for i in range(max(1, len(w) - toxicity.WINDOW + 1)):
        part = w[i:i + toxicity.WINDOW]
        cells = [c for x in part for c in toxicity.grams_of([x])[0]]
        margins.append(sum(float(model.weight[c]) for c in cells) / max(1, len(cells)) + model.bias)
    return 1 / (1 + math.exp(-max(margins)))


def sample_model():
    rng = np.random.default_rng(0)
    benign = ["table", "walking", "house", "green", "river", "thing", "morning", "paper", "window", "stone"]
    toxic = ["idiot", "pathetic", "worthless"]
    texts, y = [], []
    for i in range(300):
        w = list(rng.choice(benign, rng.integers(5, 60)))
        if i % 3 == 0:
            w[rng.integers(len(w))] = toxic[i // 3 % 3]
        texts.append(" ".join(w))
        y.append(int(i % 3 == 0))
    return toxicity.fit(texts, np.array(y), steps=40)


def test_scores_equal_the_plain_version_and_misspellings_are_found():
    m = sample_model()
    texts = ["", "  ", None, "table", "walking house green river thing morning paper idiot, window stone", "é" * 200 + " a", "an IDIOTT here",
             "green river thing " * 400 + "patheticc" + " green river thing" * 400, "a b c d e f g h", "<>"]
    got = m.scores(texts)
    assert np.allclose(got, [plain_score(m, t) for t in texts], atol=1e-6)
    assert np.allclose(m.scores(texts[::-1])[::-1], got) and np.allclose([m.scores([t])[0] for t in texts], got)
    assert got[4] > 0.5 and got[6] > 0.5 and got[7] > 0.5 and max(got[[0, 1, 2, 3]]) < 0.3
    assert m.scores(["worthles"])[0] > 0.5 and m.scores(["river paper window"])[0] < 0.3


def test_the_kept_words_are_renewed(monkeypatch):
    m = sample_model()
    want = m.scores(["an idiot", "green", "paper stone"] * 3)
    monkeypatch.setattr(toxicity, "CACHED", 1)
    for _ in range(3):
        assert np.allclose([m.scores([t])[0] for t in ["an idiot", "green", "paper stone"] * 3], want)


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op12_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    assert all(r.predicted == (r.score >= 0.3) for r in got.values())
    held = [(got[i].predicted, t) for i, t in labels.items() if got[i].held_out]
    assert np.mean([p for p, t in held if t]) >= 0.9 and np.mean([p for p, t in held if not t]) <= 0.05


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "t", 1.0), (2, "", "t", 1.0), (2, "", "t", 1.0), (None, "an idiot", "t", 1.0), (4, "w " * 20_000, "t", 1.0)],
                                 "doc_id long, text string, Text string, score double")
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1), (4, 1), (4, 0)], "doc_id long, toxic int")
    out = toxicity.judge(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    assert sorted((r.doc_id or 0, r.score, r.predicted) for r in out.collect()) == [(0, 0.0, 0), (1, 0.0, 0), (2, 0.0, 0), (2, 0.0, 0), (4, 0.0, 0)]
    assert toxicity.judge(docs.limit(0), labels).count() == 0 and toxicity.judge(docs, labels.limit(0)).count() == 5
