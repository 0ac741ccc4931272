from pyspark.sql import functions as F

from linguaspark.operators import memory as M
from linguaspark.plans import jobs as J
from helpers import rows

E = "catalog string, lang string, key string, value string, ord bigint"


def test_translate_rounds_feed_memory(spark):
    src = spark.createDataFrame([("app", "en", f"k{i}", "Save file" if i % 2 else "Open", i) for i in range(20)], E)
    tgt = spark.createDataFrame([], E)
    mem = M.embed(spark.createDataFrame([("ja_x", "Close", "閉じる", "ja", "unknown", 0)],
                                        "id string, source_text string, translation string, lang string, "
                                        "context string, seq bigint"), "source_text")
    one = J.translate(src, tgt, ["ja"], memory=mem, batch_size=5)
    two = J.translate(src, tgt, ["ja"], memory=mem, batch_size=5, rounds=2)
    assert rows(one.entries, "key", "value") == rows(two.entries, "key", "value")
    assert rows(one.entries.where(F.col("key") == "k1"), "value") == [("[ja] Save file",)]
    late = {r.key: r.prompt for r in two.results.collect()}
    early = {r.key: r.prompt for r in one.results.collect()}
    # the second round sees the first round's translations in its similar list
    assert "was translated as \"[ja] Save file\"" in late["k19"]
    assert "[ja] Save file" not in early["k19"]
    assert one.memory_rows.count() == 20


def test_review_all_mode_and_import_glossary(spark):
    src = spark.createDataFrame([("app", "en", "a", "Hi", 1), ("app", "en", "b", "Bye", 2)], E)
    tgt = spark.createDataFrame([("app", "ja", "a", "Hi", 1), ("app", "ja", "b", "さよなら", 2)], E)
    assert J.review(src, tgt, ["ja"]).results.count() == 1
    res = J.review(src, tgt, ["ja"], all_keys=True)
    assert res.results.count() == 2
    assert rows(res.entries, "key", "value") == [("a", "Hi"), ("b", "さよなら")]
    c = res.counts.collect()[0]
    assert (c.n_reviewed, c.n_improved) == (2, 2)  # the mock's '[MOCK] No changes needed' counts
    g = spark.createDataFrame([], "term string, translations map<string,string>, context string, notes string, seq bigint")
    recs = spark.createDataFrame([("API", "API", None, None, 1), ("", "x", None, None, 2)],
                                 "term string, translation string, context string, notes string, seq bigint")
    merged, counts = J.import_glossary(g, recs, "ja")
    assert rows(merged, "term") == [("API",)]
    assert tuple(counts.collect()[0]) == (1, 1)


import sys  # noqa: E402

from pyspark import cloudpickle  # noqa: E402

# Providers defined in this test module must reach the Python workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class _Reviewer:
    """A Python batch provider: upper-cases the current translation; fails on one key's prompt."""

    def __call__(self, prompts):
        out = []
        for p in prompts:
            if "Original (English): Boom" in p:
                raise RuntimeError("model error")
            cur = p.split("Current translation (ja): ", 1)[1].split("\n", 1)[0]
            out.append(f"IMPROVED: {cur.upper()}\nCHANGES: upper-cased")
        return out


def test_review_python_provider_isolates_failures(spark):
    src = spark.createDataFrame([("app", "en", "a", "Hi", 1), ("app", "en", "b", "Boom", 2),
                                 ("app", "en", "c", "Ok", 3)], E)
    tgt = spark.createDataFrame([("app", "ja", "a", "hi-ja", 1), ("app", "ja", "b", "boom-ja", 2),
                                 ("app", "ja", "c", "Ok", 3)], E)
    res = J.review(src, tgt, ["ja"], _Reviewer(), max_parallel=2)
    assert rows(res.entries, "key", "value") == [("a", "HI-JA"), ("b", "boom-ja"), ("c", "Ok")]
    errs = {r.key: r.error for r in res.results.collect()}
    assert errs["a"] is None and "model error" in errs["b"]
    assert rows(res.memory_rows, "source_text", "translation") == [("Hi", "HI-JA")]


def test_translate_relevant_glossary_scope(spark):
    src = spark.createDataFrame([("app", "en", "a", "Open the File menu", 1), ("app", "en", "b", "Close", 2)], E)
    tgt = spark.createDataFrame([], E)
    g = spark.createDataFrame([("file", {"ja": "ファイル"}, None, None, 1), ("menu", {"ja": "メニュー"}, None, None, 2),
                               ("save", {"ja": "保存"}, None, None, 3), ("close", {"fr": "fermer"}, None, None, 4)],
                              "term string, translations map<string,string>, context string, notes string, seq bigint")
    res = J.translate(src, tgt, ["ja"], glossary=g, glossary_scope="relevant")
    p = {r.key: r.prompt for r in res.results.collect()}
    assert '- "file" should be translated as "ファイル"\n- "menu" should be translated as "メニュー"\n' in p["a"]
    assert "save" not in p["a"]
    assert "glossary" not in p["b"]  # 'close' has no ja translation
    full = {r.key: r.prompt for r in J.translate(src, tgt, ["ja"], glossary=g).results.collect()}
    assert '"save" should be translated as "保存"' in full["b"]


def test_review_relevant_glossary_scope(spark):
    src = spark.createDataFrame([("app", "en", "a", "Open file", 1)], E)
    tgt = spark.createDataFrame([("app", "ja", "a", "開く", 1)], E)
    g = spark.createDataFrame([("file", {"ja": "ファイル"}, None, None, 1), ("menu", {"ja": "メニュー"}, None, None, 2)],
                              "term string, translations map<string,string>, context string, notes string, seq bigint")
    p = J.review(src, tgt, ["ja"], glossary=g, glossary_scope="relevant").results.collect()[0].prompt
    assert '"file" should be translated as "ファイル"' in p and "menu" not in p


def test_missing_entries_are_found_once(spark, monkeypatch):
    from linguaspark.operators import catalog as C
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(v):
        seen.add(1)
        return v

    E = "catalog string, lang string, key string, value string, ord bigint"
    src = spark.createDataFrame([("app", "en", f"k{i}", f"v{i}", i) for i in range(20)], E)
    tgt = spark.createDataFrame([("app", "ja", "k0", "x", 0)], E)
    found = C.missing_entries
    monkeypatch.setattr(C, "missing_entries", lambda *a: found(*a).withColumn("value", counted("value")))
    assert J.translate(src, tgt, ["ja"]).entries.count() == 20
    res = J.translate(src, tgt, ["ja"])
    before = seen.value
    assert len(res.entries.collect()) == 20 and seen.value == before
