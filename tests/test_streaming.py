import os

from linguaspark.streaming.incremental import ingest_memory, read_memory, read_missing, stream_missing
from helpers import rows

TM = "id string, source_text string, translation string, lang string, context string, seq bigint"
E = "catalog string, lang string, key string, value string, ord bigint"


def land(spark, path, data, schema):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(path)


def test_memory_ingest_is_incremental(spark, tmp_dir):
    src, table, ckpt = f"{tmp_dir}/in", f"{tmp_dir}/tm", f"{tmp_dir}/ckpt"
    land(spark, src, [("ja_a", "a", "A1", "ja", "unknown", 1), ("ja_b", "b", "B1", "ja", "unknown", 1)], TM)
    land(spark, src, [("ja_a", "a", "A2", "ja", "unknown", 2)], TM)
    schema = spark.read.parquet(src).schema
    ingest_memory(spark, src, table, ckpt, schema)
    assert rows(read_memory(spark, table), "id", "translation") == [("ja_a", "A2"), ("ja_b", "B1")]
    batches = sorted(os.listdir(table))
    land(spark, src, [("ja_b", "b", "B3", "ja", "unknown", 3), ("ja_a", "a", "old", "ja", "unknown", 0)], TM)
    ingest_memory(spark, src, table, ckpt, schema)
    new_batches = [b for b in sorted(os.listdir(table)) if b not in batches and b.startswith("batch_id=")]
    assert len(new_batches) == 1  # only the new file was processed
    assert rows(read_memory(spark, table), "id", "translation") == [("ja_a", "A2"), ("ja_b", "B3")]


def test_missing_stream(spark, tmp_dir):
    src, out, ckpt = f"{tmp_dir}/src", f"{tmp_dir}/out", f"{tmp_dir}/ck"
    land(spark, src, [("app", "en", "a", "A", 1), ("app", "en", "b", "B", 2)], E)
    tgt = spark.createDataFrame([("app", "ja", "a", "x", 1)], E)
    stream_missing(spark, src, tgt, out, ckpt, spark.read.parquet(src).schema, ["ja", "fr"])
    assert rows(read_missing(spark, out), "lang", "key") == [("fr", "a"), ("fr", "b"), ("ja", "b")]


def test_compact_memory(spark, tmp_dir):
    from linguaspark.sources.memory_store import read_memory as read_table
    from linguaspark.streaming.incremental import compact_memory
    src, table, ckpt = f"{tmp_dir}/in", f"{tmp_dir}/tm", f"{tmp_dir}/ckpt"
    land(spark, src, [("ja_a", "a", "A1", "ja", "unknown", 1), ("fr_b", "b", "B", "fr", "unknown", 1)], TM)
    land(spark, src, [("ja_a", "a", "A2", "ja", "unknown", 2)], TM)
    ingest_memory(spark, src, table, ckpt, spark.read.parquet(src).schema)
    compact_memory(spark, table, f"{tmp_dir}/compact")
    assert rows(read_table(spark, f"{tmp_dir}/compact", ["ja"]), "id", "translation") == [("ja_a", "A2")]
    assert {"lang=fr", "lang=ja"} <= set(os.listdir(f"{tmp_dir}/compact"))


def test_fold_settles_batches_and_readers_skip_them(spark, tmp_dir):
    from linguaspark.streaming.incremental import drop_folded, fold_batches, table_state
    src, table, ckpt = f"{tmp_dir}/in", f"{tmp_dir}/tm", f"{tmp_dir}/ckpt"
    schema = spark.createDataFrame([], TM).schema

    def arrive(*writes):
        for i, text, seq in writes:
            land(spark, src, [(i, "s", text, "ja", "unknown", seq)], TM)
        ingest_memory(spark, src, table, ckpt, schema, files_per_batch=1)

    want = lambda: rows(read_memory(spark, table), "id", "translation")
    arrive(("a", "A1", 1), ("b", "B1", 1))
    assert fold_batches(spark, table) == [(0, 1)]
    arrive(("a", "A2", 2), ("b", "late", 0))
    assert table_state(spark, table) == ([(0, 1)], [2, 3])
    files = read_memory(spark, table).inputFiles()
    assert not any("batch_id=0" in f or "batch_id=1" in f for f in files) and any("run=0-1" in f for f in files)
    assert want() == [("a", "A2"), ("b", "B1")]
    assert fold_batches(spark, table, fan=1) == [(0, 3)]
    assert want() == [("a", "A2"), ("b", "B1")]
    assert fold_batches(spark, table) == [(0, 3)]  # nothing new
    assert drop_folded(spark, table) == 4 + 2
    arrive(("c", "C1", 5))
    assert table_state(spark, table) == ([(0, 3)], [4])
    assert want() == [("a", "A2"), ("b", "B1"), ("c", "C1")]


def test_unfinished_fold_and_batch_do_not_count(spark, tmp_dir):
    from linguaspark.streaming.incremental import fold_batches, table_state
    src, table, ckpt = f"{tmp_dir}/in", f"{tmp_dir}/tm", f"{tmp_dir}/ckpt"
    land(spark, src, [("a", "s", "A1", "ja", "unknown", 1)], TM)
    ingest_memory(spark, src, table, ckpt, spark.createDataFrame([], TM).schema)
    fold_batches(spark, table)
    os.remove(f"{table}/_folded/run=0-0/_SUCCESS")
    os.makedirs(f"{table}/batch_id=1")  # begun, not finished
    assert table_state(spark, table) == ([], [0])
    assert rows(read_memory(spark, table), "translation") == [("A1",)]
    assert fold_batches(spark, table) == [(0, 0)]  # written again
