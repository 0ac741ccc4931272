import json
import os

import pytest
from pyspark.sql import functions as F

from linguaspark.sources import files as S
from linguaspark.sources import tree
from helpers import rows


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_read_catalogs_tree_and_optional(spark, tmp_dir):
    write(f"{tmp_dir}/cat/app/en.json", json.dumps({"a": {"b": "x"}, "c": "y"}))
    write(f"{tmp_dir}/cat/app/ja.json", json.dumps({"a": {"b": "エックス"}}, indent=2, ensure_ascii=False))
    write(f"{tmp_dir}/cat/web/en.json", "{broken")
    f = S.read_catalogs(spark, f"{tmp_dir}/cat")
    assert rows(f.entries, "catalog", "lang", "key", "value") == [
        ("app", "en", "a.b", "x"), ("app", "en", "c", "y"), ("app", "ja", "a.b", "エックス")]
    assert rows(f.rejects, "catalog") == [("web",)]
    assert S.read_catalogs(spark, f"{tmp_dir}/nope").entries.count() == 0
    with pytest.raises(FileNotFoundError):
        S.read_catalogs(spark, f"{tmp_dir}/nope", required=True)


def test_write_catalogs_roundtrip_and_conflict_refusal(spark, tmp_dir):
    e = spark.createDataFrame([("app", "ja", "a.b", "x", 1), ("app", "ja", "c", "y", 2)],
                              "catalog string, lang string, key string, value string, ord bigint")
    S.write_catalogs(e, f"{tmp_dir}/out")
    back = S.read_catalogs(spark, f"{tmp_dir}/out").entries
    assert rows(back, "catalog", "lang", "key", "value") == [("app", "ja", "a.b", "x"), ("app", "ja", "c", "y")]
    bad = spark.createDataFrame([("app", "ja", "a", "x", 1), ("app", "ja", "a.b", "y", 2)],
                                "catalog string, lang string, key string, value string, ord bigint")
    with pytest.raises(ValueError):
        S.write_catalogs(bad, f"{tmp_dir}/out2")


def test_code_files_filter(spark, tmp_dir):
    write(f"{tmp_dir}/code/src/a.tsx", "t('k')")
    write(f"{tmp_dir}/code/node_modules/b.js", "t('k')")
    write(f"{tmp_dir}/code/img.bin", "t('k')")
    got = rows(S.read_code_files(spark, f"{tmp_dir}/code"), "file")
    assert got == [("src/a.tsx",)]


def test_files_of_any_name_are_read_and_unreadable_ones_are_told(spark, tmp_dir):
    for name in ("_app.tsx", "x.tsx", ".hidden/y.tsx", "pages/_document.tsx", "dist/z.tsx", "a b#%.tsx"):
        write(f"{tmp_dir}/code/{name}", f"t('{name}')")
    os.symlink(f"{tmp_dir}/gone", f"{tmp_dir}/code/lost.tsx")
    found = S.scan_code(spark, f"{tmp_dir}/code", extensions=["tsx"])
    want = sorted(["_app.tsx", "x.tsx", ".hidden/y.tsx", "pages/_document.tsx", "a b#%.tsx"])
    assert rows(found.files, "path", "content") == [(n, f"t('{n}')") for n in want]
    assert [(r.path, "gone" in r.reason or "No such file" in r.reason) for r in found.rejects.collect()] == [("lost.tsx", True)]
    assert rows(S.read_code_files(spark, f"{tmp_dir}/code", ["tsx"]), "file") == [(n,) for n in want]


def test_unreadable_catalogs_are_rejected_and_imports_fail(spark, tmp_dir):
    write(f"{tmp_dir}/cat/app/en.json", '{"k": "v"}')
    os.symlink(f"{tmp_dir}/gone", f"{tmp_dir}/cat/app/ja.json")
    f = S.read_catalogs(spark, f"{tmp_dir}/cat")
    assert rows(f.entries, "catalog", "lang", "key") == [("app", "en", "k")]
    assert rows(f.rejects, "catalog", "lang") == [("app", "ja")]
    with pytest.raises(Exception, match="ja.json"):
        S.read_catalog_files(spark, f"{tmp_dir}/cat").collect()
    with pytest.raises(Exception, match="ja.json"):
        S.read_translation_import(spark, f"{tmp_dir}/cat").collect()


def test_scan_packs_by_size_and_a_store_of_spark_only_is_read_by_spark(spark, tmp_dir, monkeypatch):
    for i in range(25):
        write(f"{tmp_dir}/t/d{i % 3}/{i}.json", "x" * 100)
    monkeypatch.setattr(tree, "PART_BYTES", 450)
    parts = tree.TreeReader(f"{tmp_dir}/t", [".json"]).partitions()
    assert [len(p.names) for p in parts] == [4, 4, 4, 4, 4, 4, 1] and len({n for p in parts for n in p.names}) == 25
    monkeypatch.setattr(S, "can_list", lambda root: False)
    assert S.read_whole_files(spark, f"{tmp_dir}/t", suffixes=("7.json",)).files.count() == 2


E = "catalog string, lang string, key string, value string, ord bigint"


def test_written_catalogs_are_read_back_in_place(spark, tmp_dir):
    e = spark.createDataFrame([("app", "ja", "b", "1", 1), ("app", "ja", "a.10", "x", 2), ("app", "ja", "a.9", "y\u2028", 3),
                               (".", "en", "k", "v", 1), ("deep/er #1%", "fr", "k", "w", 1)], E)
    assert S.write_catalogs(e, f"{tmp_dir}/out") == 3
    assert sorted(f"{d[len(tmp_dir):]}/{n}" for d, _, ns in os.walk(f"{tmp_dir}/out") for n in ns if not n.endswith(".crc")) == [
        "/out/app/ja.json", "/out/deep/er #1%/fr.json", "/out/en.json"]
    with open(f"{tmp_dir}/out/app/ja.json", encoding="utf-8") as f:
        assert f.read() == '{\n  "b": "1",\n  "a": {\n    "9": "y\u2028",\n    "10": "x"\n  }\n}\n'
    back = S.read_catalogs(spark, f"{tmp_dir}/out")
    assert rows(back.entries, "catalog", "lang", "key", "value") == [
        (".", "en", "k", "v"), ("app", "ja", "a.10", "x"), ("app", "ja", "a.9", "y\u2028"), ("app", "ja", "b", "1"), ("deep/er #1%", "fr", "k", "w")]
    # read, change and write to the same place: the old file is replaced when the new one is whole
    S.write_catalogs(back.entries.where("catalog = 'app'").withColumn("value", F.upper("value")), f"{tmp_dir}/out")
    again = S.read_catalogs(spark, f"{tmp_dir}/out").entries
    assert ("app", "ja", "a.10", "X") in rows(again, "catalog", "lang", "key", "value") and again.count() == 5


def test_a_failed_write_leaves_the_old_files(spark, tmp_dir):
    S.write_catalogs(spark.createDataFrame([("app", "ja", "k", "old", 1)], E), f"{tmp_dir}/out")
    bad = spark.createDataFrame([("app", "ja", "k", "new", 1)], E).withColumn(
        "value", F.raise_error(F.lit("broken input")).cast("string"))
    with pytest.raises(Exception, match="broken input"):
        S.write_catalogs(bad, f"{tmp_dir}/out", check_conflicts=False)
    twice = spark.createDataFrame([("app/ja.json", "1"), ("app/ja.json", "2")], "path string, content string").repartition(2, "content")
    with pytest.raises(ValueError, match="more than once"):
        tree.write_files(twice, f"{tmp_dir}/out")
    assert rows(S.read_catalogs(spark, f"{tmp_dir}/out").entries, "value") == [("old",)]
    assert [n for n in os.listdir(f"{tmp_dir}/out") if n.startswith(tree.STAGE)] == []


def test_csv_and_json_imports(spark, tmp_dir):
    write(f"{tmp_dir}/t.csv", "hello,hola,extra\n\n  \ngoodbye , adiós\r\nonlykey\n")
    got = rows(S.read_translation_import(spark, f"{tmp_dir}/t.csv", "csv"), "key", "value")
    assert got == [("goodbye", "adiós"), ("hello", "hola"), ("onlykey", None)]
    write(f"{tmp_dir}/t.json", json.dumps({"hello": "hola", "n": 5, "z": None, "o": {"x": "y"}}))
    got = rows(S.read_translation_import(spark, f"{tmp_dir}/t.json"), "key", "value")
    assert got == [("hello", "hola"), ("n", "5"), ("o", "[object Object]"), ("z", "null")]
    write(f"{tmp_dir}/g.csv", "API,API,tech,keep,surplus\nLogin,ログイン\n")
    g = rows(S.read_glossary_import(spark, f"{tmp_dir}/g.csv", "csv"), "term", "translation", "context", "notes")
    assert g == [("API", "API", "tech", "keep"), ("Login", "ログイン", None, None)]


def test_glossary_file_missing_is_empty(spark, tmp_dir):
    assert S.read_glossary(spark, f"{tmp_dir}/none.json").count() == 0
    write(f"{tmp_dir}/g.json", json.dumps([{"term": "API", "translations": {"ja": "API"}, "context": "tech"}]))
    g = S.read_glossary(spark, f"{tmp_dir}/g.json").collect()
    assert g[0].term == "API" and g[0].translations == {"ja": "API"}


def test_drop_stage_tables(spark):
    from linguaspark.session import cut_lineage, drop_stage_tables
    df = cut_lineage(spark.range(10), "probe")
    assert df.count() == 10
    assert drop_stage_tables(spark) >= 1
    assert drop_stage_tables(spark) == 0


def test_writing_one_language_leaves_the_others(spark, tmp_dir):
    from linguaspark.sources import files
    row = lambda lang: spark.createDataFrame([("app", lang, "a.b", lang, 0)], "catalog string, lang string, key string, value string, ord long")
    files.write_catalogs(row("ja"), f"{tmp_dir}/out")
    files.write_catalogs(row("fr"), f"{tmp_dir}/out")
    assert {r.lang for r in files.read_catalog_files(spark, f"{tmp_dir}/out").collect()} == {"ja", "fr"}


def test_tasks_write_and_rename_the_files(spark, tmp_dir, monkeypatch):
    def on_the_driver(*args):
        raise AssertionError("the driver renames files")

    monkeypatch.setattr(tree, "ThreadPoolExecutor", on_the_driver)
    long = "/".join(["folder" * 10] * 6)  # more than one name may have
    made = [(f"d{i % 7}/f{i}.txt", f"text {i}") for i in range(300)] + [(f"{long}/x", "é\ny"), ("empty", None)]
    df = spark.createDataFrame(made, "path string, content string")
    assert tree.write_files(df, f"{tmp_dir}/out") == len(made)
    found = tree.scan(spark, f"{tmp_dir}/out")
    assert rows(found.files) == sorted((p, f"{c or ''}\n") for p, c in made)
    assert [n for n in os.listdir(f"{tmp_dir}/out") if n.startswith(tree.STAGE)] == []
    assert tree.write_files(df.limit(0), f"{tmp_dir}/out") == 0


def test_a_path_twice_in_one_task_is_an_error(spark, tmp_dir):
    twice = spark.createDataFrame([("a", "1"), ("a", "2")], "path string, content string").coalesce(1)
    with pytest.raises(ValueError, match="more than once"):
        tree.write_files(twice, f"{tmp_dir}/out")
    assert os.listdir(f"{tmp_dir}/out") == []
