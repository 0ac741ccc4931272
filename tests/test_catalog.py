import json
import random

import pytest
from pyspark.sql import functions as F

from linguaspark.operators import catalog as C
from helpers import rows


def entries(spark, data, lang="en", catalog="app"):
    return spark.createDataFrame([(catalog, lang, k, v, i) for i, (k, v) in enumerate(data)],
                                 "catalog string, lang string, key string, value string, ord bigint")


def files(spark, docs):
    return spark.createDataFrame([(c, "en", d if isinstance(d, str) else json.dumps(d)) for c, d in docs],
                                 "catalog string, lang string, json string")


def flat(spark, doc, catalog="app"):
    f = C.flatten_catalogs(files(spark, [(catalog, doc)]))
    return [(r.key, r.value) for r in f.entries.orderBy("ord").collect()], f.rejects


def test_flatten_nested_and_order(spark):
    doc = {"common": {"button": {"submit": "Submit", "cancel": "Cancel"}}, "title": "T"}
    got, _ = flat(spark, doc)
    assert got == [("common.button.submit", "Submit"), ("common.button.cancel", "Cancel"), ("title", "T")]


def test_flatten_scalars_vanish_arrays_index(spark):
    doc = '{"n": 5, "b": true, "arr": ["p", {"x": "q"}], "s": "{\\"x\\":1}", "e": {}}'
    got, _ = flat(spark, doc)
    assert got == [("arr.0", "p"), ("arr.1.x", "q"), ("s", '{"x":1}')]


def test_flatten_index_like_names_first_and_duplicates(spark):
    doc = '{"b": "1", "500": "x", "404": "y", "a": "2", "b": "3"}'
    got, _ = flat(spark, doc)
    # index-like names ascending first; a duplicate keeps its first place and last value
    assert got == [("404", "y"), ("500", "x"), ("b", "3"), ("a", "2")]


def test_flatten_null_and_bad_json_reject_file(spark):
    f = C.flatten_catalogs(files(spark, [("bad", '{"a": null, "b": "x"}'), ("broken", "{nope"),
                                         ("ok", '{"k": "v"}')]))
    assert rows(f.entries, "catalog", "key") == [("ok", "k")]
    assert sorted(r.catalog for r in f.rejects.collect()) == ["bad", "broken"]


def test_flatten_empty_member_name_no_dot(spark):
    got, _ = flat(spark, '{"": {"a": "x"}}')
    assert got == [("a", "x")]


def test_nest_pretty_print_and_roundtrip(spark):
    e = entries(spark, [("common.ok", "OK"), ("title", 'Say "hi"'), ("common.no", "No"), ("404", "nf")])
    out = C.nest_catalogs(e).collect()[0].json
    expected = {"404": "nf", "common": {"ok": "OK", "no": "No"}, "title": 'Say "hi"'}
    assert out == json.dumps(expected, indent=2, ensure_ascii=False)
    back = C.flatten_catalogs(C.nest_catalogs(e)).entries
    assert rows(back, "key", "value") == rows(e, "key", "value")


def _nested(pairs):
    """Brute force: a dict of dicts, filled in order."""
    root = {}
    for key, value in pairs:
        node, parts = root, key.split(".")
        for p in parts[:-1]:
            node = node.setdefault(p, {})
        node[parts[-1]] = value

    def ordered(n):
        if not isinstance(n, dict):
            return n
        number = lambda k: k.isdigit() and (k == "0" or k[0] != "0") and int(k) < 4294967295
        return {k: ordered(n[k]) for k in sorted(filter(number, n), key=int) + [k for k in n if not number(k)]}
    return ordered(root)


def test_nest_lines_match_brute_force(spark):
    rnd = random.Random(5)
    names = ["a", "b", "10", "2", "0", "01", "", 'q"t', "z"]
    pairs, seen = [], set()
    for i in range(400):
        parts = [rnd.choice(names) for _ in range(rnd.randint(1, 4))]
        key = ".".join(parts) + ".leaf" + str(rnd.randint(0, 2))  # no key is a prefix of another
        pairs.append((key, f"v{i}"))
        seen.add(key)
    e = entries(spark, pairs)
    assert C.nest_catalogs(e).collect()[0].json == json.dumps(_nested(pairs), indent=2, ensure_ascii=False)
    pieces = C.nest_lines(e.unionByName(e.limit(1).withColumn("lang", F.lit(None).cast("string")))).collect()
    assert sorted(r.n for r in pieces if r.lang is not None) == list(range(1, len(seen) + 1))
    assert [r.text for r in pieces if r.lang is None] == [json.dumps(_nested(pairs[:1]), indent=2)]
    assert C.nest_lines(e.limit(0)).count() == 0


def test_nest_last_wins_keeps_first_position(spark):
    e = entries(spark, [("a", "1"), ("b", "2"), ("a", "3")])
    assert json.loads(C.nest_catalogs(e).collect()[0].json) == {"a": "3", "b": "2"}
    assert C.nest_catalogs(e).collect()[0].json.index('"a"') < C.nest_catalogs(e).collect()[0].json.index('"b"')


def test_path_conflicts(spark):
    e = entries(spark, [("a", "x"), ("a.b", "y"), ("a.b.c", "z"), ("q", "w")])
    assert rows(C.path_conflicts(e), "leaf_key", "deeper_key") == [("a", "a.b"), ("a", "a.b.c"), ("a.b", "a.b.c")]


def test_diff_missing_outdated_same(spark):
    src = entries(spark, [("k1", "Hello"), ("k2", "Bye"), ("k3", "Same"), ("k1", "Hello2")])
    tgt = entries(spark, [("k2", "Adios"), ("k3", "Same"), ("k9", "extra")], lang="es")
    assert rows(C.missing_entries(src, tgt, ["es"]), "key", "value") == [("k1", "Hello"), ("k1", "Hello2")]
    assert rows(C.outdated_pairs(src, tgt, ["es"]), "key", "source_value", "target_value") == [("k2", "Bye", "Adios")]
    assert rows(C.reviewable_entries(src, tgt, ["es"]), "key") == [("k2",), ("k3",)]
    cov = C.coverage(src, tgt, ["es"]).collect()[0].asDict()
    assert (cov["n_source"], cov["n_target"], cov["n_missing"], cov["n_outdated"], cov["n_same"], cov["n_extra"]) \
        == (4, 3, 2, 1, 1, 1)


def test_empty_target_value_counts_as_translated(spark):
    src = entries(spark, [("k", "Hello")])
    tgt = entries(spark, [("k", "")], lang="ja")
    assert C.missing_entries(src, tgt, ["ja"]).count() == 0
    assert C.outdated_pairs(src, tgt, ["ja"]).count() == 1


def test_missing_when_no_target_language_rows(spark):
    src = entries(spark, [("k", "Hello")])
    tgt = entries(spark, [], lang="ja")
    assert C.missing_entries(src, tgt, ["ja", "fr"]).count() == 2


def test_last_wins(spark):
    e = entries(spark, [("a", "1"), ("a", "2"), ("b", "3")])
    assert rows(C.last_wins(e), "key", "value") == [("a", "2"), ("b", "3")]


def test_upsert_and_counts_new_key_repeated(spark):
    ex = entries(spark, [("a", "1"), ("b", "2")], lang="ja")
    inc = spark.createDataFrame([("app", "ja", "a", "A", 1), ("app", "ja", "n", "N1", 2), ("app", "ja", "n", "N2", 3),
                                 ("app", "ja", "x", "", 4), ("app", "ja", None, "v", 5)],
                                "catalog string, lang string, key string, value string, seq bigint")
    up = C.upsert_entries(ex, inc)
    assert rows(up, "key", "value", "is_new") == [("a", "A", False), ("b", "2", False), ("n", "N2", True)]
    c = C.import_counts(ex, inc).collect()[0]
    assert (c.n_added, c.n_updated, c.n_skipped) == (2, 1, 2)


def test_merge_translations_failed_rows_absent(spark):
    tgt = entries(spark, [("a", "A")], lang="ja")
    src = entries(spark, [("a", "a"), ("b", "b"), ("c", "c")])
    miss = C.missing_entries(src, tgt, ["ja"])
    res = spark.createDataFrame([("app", "ja", "b", "[ja] b", None), ("app", "ja", "c", None, "boom")],
                                "catalog string, lang string, key string, translated string, error string")
    assert rows(C.merge_translations(tgt, miss, res), "key", "value", "is_new") == [("a", "A", False),
                                                                                   ("b", "[ja] b", True)]


@pytest.mark.parametrize("depth", [17])
def test_deep_catalog(spark, depth):
    doc = "x"
    for i in reversed(range(depth)):
        doc = {f"l{i}": doc}
    got, _ = flat(spark, doc)
    assert got == [(".".join(f"l{i}" for i in range(depth)), "x")]


def test_events_props_flatten_to_nothing(spark):
    from linguaspark.plans import fixtures as fx
    from helpers import SMOKE
    f = C.flatten_catalogs(fx.event_prop_files(spark, SMOKE))
    assert f.entries.count() == 0
    assert f.rejects.count() == 0
    assert F is not None


def test_nest_flatten_control_and_line_separator_characters(spark):
    vals = ["a\u0085b", "c d", "\x1d\x93e", "tab\tnl\ncr\r", 'q"uote\\']
    e = entries(spark, [(f"k{i}", v) for i, v in enumerate(vals)])
    back = C.flatten_catalogs(C.nest_catalogs(e)).entries
    assert rows(back, "key", "value") == sorted((f"k{i}", v) for i, v in enumerate(vals))


def test_flatten_edge_documents(spark):
    deep = lambda n: '{"a":' * n + '"x"' + "}" * n
    docs = {"dup": '{"b": "1", "a": {"x": "y"}, "b": {"c": "2"}}', "half": '{"k": "\\ud83d\\ude00 \\ud800"}', "nan": '{"k": NaN}', "bom": '﻿{"k": "v"}',
            "edge": deep(64), "deep": deep(65), "abyss": deep(100_000), "big": '{"n": ' + "9" * 5000 + ', "k": "v"}', "null": None,
            "ids": '{"4294967295": "late", "4294967294": "max", "007": "text", "7": "num"}', "empty": "{}", "text": '"x"'}
    f = C.flatten_catalogs(spark.createDataFrame(list(docs.items()), "catalog string, json string"), ids=["catalog"])
    got = {}
    for r in f.entries.orderBy("catalog", "ord").collect():
        got.setdefault(r.catalog, []).append((r.key, r.value))
    assert got == {"dup": [("b.c", "2"), ("a.x", "y")], "half": [("k", "\U0001F600 �")], "edge": [(".".join("a" * 64), "x")], "big": [("k", "v")],
                   "ids": [("7", "num"), ("4294967294", "max"), ("4294967295", "late"), ("007", "text")]}
    assert {r.catalog: r.reason for r in f.rejects.collect()} == {
        "nan": "unparseable or not an object", "bom": "unparseable or not an object", "null": "unparseable or not an object",
        "text": "unparseable or not an object", "deep": "nested deeper than 64", "abyss": "nested deeper than 64"}
