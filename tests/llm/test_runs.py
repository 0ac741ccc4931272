"""Periodic runs against brute force, planted runs against the rule as written, odd rows."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from linguaspark.llm import queries, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w, min_words=24, exponent=3):
    """By definition: for every period the maximal stretches, kept if no smaller period has them."""
    out = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(min_words, exponent * q):
                out.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, m, q) for (s, m), q in out.items())


def brute_row(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = brute_runs(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def columns(r):
    return (r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 12)), max_size=6),
       st.sampled_from([(24, 3), (6, 3), (4, 2), (9, 2)]))
def test_runs_equal_brute_force(parts, law):
    w = [x for phrase, times in parts for x in phrase * times]
    assert runs.runs_of(np.array(w, np.int32), *law) == brute_runs(w, *law)


def test_long_and_nested_runs():
    rng = random.Random(1)
    inner = ["a"] * 30 + ["b"]
    for w in (["x"] * 5000, inner * 9, ["p", "q"] * 400 + ["p"], [str(rng.random()) for _ in range(700)] * 3,
              [*[str(i) for i in range(40)], "end"] * 2, [str(i % 16) for i in range(600)] + ["z"] + [str(i % 16) for i in range(600)]):
        ids = runs.word_numbers([x.encode() for x in w])
        assert runs.runs_of(ids) == brute_runs(w)


def test_query_on_planted_documents(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") * rng.randint(1, 2) for _ in range(rng.randint(0, 120))) for _ in range(150)]
    texts += ["\t é é 　x\n" * 40, "one", "", "  \n", None, "a b " * 3000, " ".join(str(i % 9) for i in range(9000))]
    rows = [(i * 7, t, "C") for i, t in enumerate(texts)] + [(None, "u v w " * 20, "C"), (5, "k " * 30, "C"), (5, "k " * 30, "C")]
    spark.createDataFrame(rows, "doc_id long, text string, TEXT2 string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_runs(spark, str(tmp_path)).collect()
    order = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(map(columns, got), key=order) == sorted((brute_row(i, t) for i, t, _ in rows), key=order)
    assert any(r.n_runs for r in got) and any(r.n_runs > 1 for r in got)


def test_odd_rows(spark):
    odd = spark.createDataFrame([(1, None, 1, "c"), (2, "", 1, "c"), (3, "z " * 50, 1, "c"), (3, "z " * 50, 1, "c")],
                                "doc_id long, text string, n_runs int, Text string")
    got = sorted((r.doc_id, r.n_words, r.n_runs, r.collapsed, r.best and tuple(r.best)) for r in runs.find(odd).collect())
    assert got == [(1, 0, 0, "", None), (2, 0, 0, "", None), (3, 50, 1, "z", (0, 50, 1)), (3, 50, 1, "z", (0, 50, 1))]
    assert runs.find(odd.limit(0)).count() == 0
