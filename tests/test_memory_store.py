from linguaspark.sources.memory_store import read_memory, write_memory
from helpers import rows

SCHEMA = "id string, source_text string, translation string, lang string, context string, embedding array<float>, seq bigint"


def tm(spark, data):
    return spark.createDataFrame([(i, s, t, l, "unknown", [1.0, 0.0], q) for i, s, t, l, q in data], SCHEMA)


def test_upsert_keep_append(spark, tmp_dir):
    p = f"{tmp_dir}/tm"
    write_memory(tm(spark, [("ja_a", "a", "A1", "ja", 1), ("fr_a", "a", "FA", "fr", 1)]), p)
    write_memory(tm(spark, [("ja_a", "a", "A2", "ja", 2), ("ja_b", "b", "B", "ja", 2)]), p)
    assert rows(read_memory(spark, p), "id", "translation") == [("fr_a", "FA"), ("ja_a", "A2"), ("ja_b", "B")]
    write_memory(tm(spark, [("ja_a", "a", "A3", "ja", 3)]), p, mode="keep")
    assert rows(read_memory(spark, p, ["ja"]), "id", "translation") == [("ja_a", "A2"), ("ja_b", "B")]
    write_memory(tm(spark, [("ja_a", "a", "A4", "ja", 4)]), p, mode="append")
    assert read_memory(spark, p, ["ja"]).count() == 3
    assert read_memory(spark, f"{tmp_dir}/none").count() == 0
