"""Properties from the test strategy, on generated inputs (few examples: each runs Spark jobs)."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from linguaspark.operators import catalog as C
from linguaspark.operators import memory as M
from helpers import rows

E = "catalog string, lang string, key string, value string, ord bigint"
SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))

segment = st.text(alphabet="abcxyz09_", min_size=1, max_size=4)
keys = st.lists(st.lists(segment, min_size=1, max_size=4).map(".".join), min_size=1, max_size=25, unique=True)
values = st.text(alphabet=st.characters(codec="utf-8", exclude_categories=("Cs",)), max_size=12)


def conflict_free(ks):
    s = set(ks)
    return [k for k in ks if not any(other.startswith(k + ".") for other in s)]


@SETTINGS
@given(keys, st.data())
def test_flatten_nest_roundtrip(spark, ks, data):
    ks = conflict_free(ks)
    vals = [data.draw(values) for _ in ks]
    e = spark.createDataFrame([("app", "ja", k, v, i) for i, (k, v) in enumerate(zip(ks, vals))], E)
    back = C.flatten_catalogs(C.nest_catalogs(e)).entries
    assert rows(back, "key", "value") == sorted(zip(ks, vals))


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 15), st.sampled_from(["a", "b", "c"])), max_size=30),
       st.lists(st.tuples(st.integers(0, 15), st.sampled_from(["a", "b", "c"])), max_size=30))
def test_diff_partitions_source_and_upsert_idempotent(spark, src_rows, tgt_rows):
    src = spark.createDataFrame([("app", "en", f"k{k}", v, i) for i, (k, v) in enumerate(src_rows)], E)
    tgt = spark.createDataFrame([("app", "ja", f"k{k}", v, i) for i, (k, v) in enumerate(tgt_rows)], E)
    cls = C.classify_entries(src, tgt, ["ja"])
    assert cls.count() == len(src_rows)
    n_miss = C.missing_entries(src, tgt, ["ja"]).count()
    n_out = C.outdated_pairs(src, tgt, ["ja"]).count()
    n_same = cls.where("status = 'same'").count()
    assert n_miss + n_out + n_same == len(src_rows)
    inc = src.withColumnRenamed("ord", "seq").drop("lang").selectExpr("catalog", "'ja' as lang", "key", "value", "seq")
    once = C.upsert_entries(tgt, inc).select("catalog", "lang", "key", "value", "ord")
    twice = C.upsert_entries(once, inc).select("catalog", "lang", "key", "value")
    assert rows(once, "key", "value") == rows(twice, "key", "value")


@SETTINGS
@given(st.integers(20, 80), st.integers(1, 4), st.integers(0, 10_000))
def test_knn_prefix_property(spark, n, k, seed):
    rng = np.random.default_rng(seed)
    vecs = rng.integers(-3, 4, size=(n, 4)).astype(float)  # small integers: many exact ties
    df = spark.createDataFrame([(i, "x", [float(v) for v in vecs[i]]) for i in range(n)],
                               "id long, lang string, embedding array<float>")
    a = rows(M.knn(df, df, k, query_id="id", memory_id="id", exclude_self=True), "query_id", "rank", "hit_id")
    b = rows(M.knn(df, df, k + 1, query_id="id", memory_id="id", exclude_self=True, broadcast_rows=0, block=16),
             "query_id", "rank", "hit_id")
    assert a == [r for r in b if r[1] <= k]


import re  # noqa: E402

from linguaspark.operators import usage as U  # noqa: E402

text_chars = st.sampled_from(list("ab.c") + ["\u0085", " ", "\n", "é", "\U0001F600", " "])


@SETTINGS
@given(st.lists(st.text(alphabet=text_chars, max_size=20), min_size=1, max_size=25),
       st.lists(st.text(alphabet=text_chars, min_size=1, max_size=5), min_size=1, max_size=12, unique=True),
       st.integers(0, 3))
def test_substring_join_matches_python(spark, hay, needles, bound):
    h = spark.createDataFrame([(i, t) for i, t in enumerate(hay)], "hid int, text string")
    n = spark.createDataFrame([(x,) for x in needles], "needle string")
    got = rows(U.substring_join(n, h, broadcast_rows=bound).select("needle", "hid"))
    assert got == sorted((x, i) for x in needles for i, t in enumerate(hay) if x in t)


code_text = st.lists(st.sampled_from(list("t('\"ab.) \n") + ["t(", "t('", "alert(\""]), max_size=30).map("".join)
T_CALL = re.compile(r"""t\(\s*['"]([^'"]+)['"]""")


@SETTINGS
@given(st.lists(code_text, min_size=1, max_size=6))
def test_extract_keys_matches_python_regex(spark, contents):
    files = spark.createDataFrame([(f"f{i}.js", c) for i, c in enumerate(contents)], "file string, content string")
    got = rows(U.extract_keys(files), "key", "file", "line")
    want = sorted((m.group(1), f"f{i}.js", c[:m.start()].count("\n") + 1)
                  for i, c in enumerate(contents) for m in T_CALL.finditer(c))
    assert got == want
