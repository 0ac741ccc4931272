import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from linguaspark.operators import inference as I
from linguaspark.operators.windows import batch_numbers, row_numbers
from helpers import rows

# Providers defined in this test module must reach the Python workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIM_T = "array<struct<source:string,translation:string,similarity:double>>"
GL_T = "array<struct<term:string,translation:string>>"


def test_translation_prompt_exact(spark):
    df = spark.createDataFrame([("Save", "ja", "button", [("Save all", "すべて保存", 0.9)], [("file", "ファイル")])],
                               f"text string, lang string, ctx string, sim {SIM_T}, gl {GL_T}")
    p = df.select(I.translation_prompt("text", "lang", "ctx", "sim", "gl").alias("p")).collect()[0].p
    assert p == ("Translate the following text from English to ja:\n\nSave\n\n"
                 "Context: This text is used as a button in the application.\n\n"
                 "Here are some similar translations for reference:\n"
                 '- "Save all" was translated as "すべて保存"\n\n'
                 "Please use the following glossary for consistent terminology:\n"
                 '- "file" should be translated as "ファイル"\n\n'
                 "Provide only the translation without any additional text or explanations.")


def test_translation_prompt_optional_parts_omitted(spark):
    df = spark.createDataFrame([("Save", "ja", "", [], None)], f"text string, lang string, ctx string, sim {SIM_T}, gl {GL_T}")
    p = df.select(I.translation_prompt("text", "lang", "ctx", "sim", "gl").alias("p")).collect()[0].p
    assert p == ("Translate the following text from English to ja:\n\nSave\n\n"
                 "Provide only the translation without any additional text or explanations.")


def test_review_prompt_exact(spark):
    df = spark.createDataFrame([("Hi", "やあ", "fr")], "s string, c string, lang string")
    p = df.select(I.review_prompt("s", "c", "lang").alias("p")).collect()[0].p
    assert p.startswith("Review and improve the following translation from English to fr:\n\n"
                        "Original (English): Hi\nCurrent translation (fr): やあ\n\n")
    assert p.endswith('CHANGES: [brief explanation of changes made, or "No changes needed" if unchanged]')


def test_parse_review_reply(spark):
    cases = [("IMPROVED: Better\nCHANGES: Fixed tone", "old", "Better", "Fixed tone"),
             ("  IMPROVED: Multi\nline\nCHANGES: x\n", "old", "Multi\nline", "x"),
             ("IMPROVED: only", "old", "only", "No changes provided"),
             ("nothing here", "old", "old", "No changes provided"),
             ("IMPROVED:   \nCHANGES: No changes needed", "old", "old", "No changes needed"),
             (None, "old", "old", "No changes provided")]
    df = spark.createDataFrame([(a, b) for a, b, _, _ in cases], "reply string, cur string")
    imp, ch = I.parse_review_reply("reply", "cur")
    got = [(r.i, r.c) for r in df.select(imp.alias("i"), ch.alias("c")).collect()]
    assert got == [(c, d) for _, _, c, d in cases]
    flags = spark.createDataFrame([("x",), ("No changes needed",), ("",), ("No changes provided",)], "c string")
    assert [r.f for r in flags.select(I.is_improvement("c").alias("f")).collect()] == [True, False, False, True]


def test_python_provider_isolates_failures(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "id int, value string")
    prov = I.MockTranslator("ja", fail_if=lambda t: t.endswith("7"))
    out = I.call_provider(df, prov, prompt_col="value", out_col="translated", max_parallel=5)
    got = {r.id: (r.translated, r.error) for r in out.collect()}
    assert got[3] == ("[ja] t3", None)
    assert got[7][0] is None and "provider failed" in got[7][1]
    assert sum(1 for v in got.values() if v[1]) == 4


def test_skip_done(spark):
    todo = spark.createDataFrame([("a",), ("b",)], "key string")
    done = spark.createDataFrame([("a",)], "key string")
    assert rows(I.skip_done(todo, done, ["key"])) == [("b",)]


def test_row_numbers_match_window(spark):
    from pyspark.sql import Window
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 5000).alias("o"))
    got = rows(row_numbers(df, ["g"], "o", num_partitions=16), "g", "o", "rn")
    want = rows(df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("o"))), "g", "o", "rn")
    assert got == want
    b = batch_numbers(df, ["g"], "o", 5).groupBy("g", "batch_id").count()
    assert b.agg(F.max("count")).collect()[0][0] == 5


def test_row_numbers_beyond_the_range_sample(spark):
    # 400,000 rows in 5,000 groups over many partitions, a wide column, null groups kept
    df = spark.range(0, 400_000, 1, 12).select(
        F.when(F.col("id") % 5000 != 7, F.col("id") % 5000).alias("g"), F.col("id").alias("o"),
        F.repeat(F.lit("x"), 60).alias("wide"))
    got = row_numbers(df, ["g"], "o", num_partitions=16)
    bad = got.where(F.col("rn") != F.floor(F.col("o") / 5000) + 1).count()
    assert (got.count(), bad) == (400_000, 0)
    assert got.where("g is null").count() == 80


class _Counted:
    """Writes every prompt it gets to a folder; breaks down (the process, not the call) while a file named ``broken`` is there."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, prompts):
        import os
        import uuid
        if "p13" in prompts and os.path.exists(f"{self.folder}/broken"):
            os._exit(1)
        if "bad" in prompts:
            raise RuntimeError("no")
        with open(f"{self.folder}/{uuid.uuid4().hex}.calls", "w") as f:
            f.write("\n".join(prompts))
        return [p.upper() for p in prompts]


def test_ledger_sends_no_answered_prompt_again(spark, tmp_dir):
    import glob
    import os

    def calls():
        return sorted(p for f in glob.glob(f"{tmp_dir}/*.calls") for p in open(f).read().split("\n"))
    df = spark.createDataFrame([(i, f"p{i % 30}") for i in range(60)] + [(60, None), (61, "bad")], "id int, prompt string")
    open(f"{tmp_dir}/broken", "w").close()
    with pytest.raises(Exception):  # noqa: B017  the worker died
        I.call_durably(df, _Counted(tmp_dir), f"{tmp_dir}/ledger", slices=10, attempts=2, at_once=1)
    kept = spark.read.parquet(f"{tmp_dir}/ledger").where("error is null").count()
    os.remove(f"{tmp_dir}/broken")
    for f in glob.glob(f"{tmp_dir}/*.calls"):
        os.remove(f)
    assert 0 < kept < 30
    got = {r.id: (r.reply, r.error) for r in I.call_durably(df, _Counted(tmp_dir), f"{tmp_dir}/ledger", slices=10).collect()}
    assert len(calls()) == len(set(calls())) == 30 - kept  # only what was missing, each once
    assert all(got[i] == (f"P{i % 30}", None) for i in range(60))
    assert got[60] == (None, "no prompt") and got[61] == (None, "RuntimeError: no")
    assert I.call_durably(df, _Counted(tmp_dir), f"{tmp_dir}/ledger").where("error is null").count() == 60
    assert len(calls()) == 30 - kept

