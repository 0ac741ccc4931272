from linguaspark.operators import glossary as G
from helpers import rows

SCHEMA = "term string, translations map<string,string>, context string, notes string, seq bigint"


def gloss(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_upsert_case_insensitive_merge(spark):
    ex = gloss(spark, [("Hello", {"ja": "こんにちは", "fr": "Bonjour"}, "greet", "n1", 1), ("Bye", {"ja": "さようなら"}, None, None, 2)])
    inc = gloss(spark, [("HELLO", {"de": "Hallo", "fr": "Salut"}, None, "n2", 10)])
    out = {r.term: r for r in G.upsert(ex, inc).collect()}
    assert set(out) == {"HELLO", "Bye"}
    h = out["HELLO"]
    assert h.translations == {"ja": "こんにちは", "fr": "Salut", "de": "Hallo"}
    assert (h.context, h.notes) == ("greet", "n2")
    assert [tuple(x) for x in h.seq] == [(0, "", 0), (0, "", 1)]  # the old side, then the entry's own order


def test_import_records_skip_invalid_and_unsupplied(spark):
    rec = spark.createDataFrame([("a", "A", "", None, 1), ("", "x", None, None, 2), ("b", None, None, None, 3)],
                                "term string, translation string, context string, notes string, seq bigint")
    e = G.import_records_to_entries(rec, "ja").collect()
    assert [(r.term, r.translations, r.context) for r in e] == [("a", {"ja": "A"}, None)]


def test_remove_for_language_search(spark):
    g = gloss(spark, [("Hello", {"ja": "こんにちは", "fr": ""}, None, None, 1), ("World", {"fr": "Monde"}, None, None, 2)])
    assert rows(G.remove(g, spark.createDataFrame([("HELLO",)], "term string")), "term") == [("World",)]
    assert rows(G.for_language(g, ["fr"]), "term", "translation") == [("World", "Monde")]
    assert rows(G.search(g, "MON"), "term") == [("World",)]
    assert G.search(g, "").count() == 2
    q = spark.createDataFrame([("ell",), ("monde",), ("zz",), ("",), ("",)], "query string")
    assert rows(G.search_many(g, q), "query", "term") == [("", "Hello"), ("", "World"), ("ell", "Hello"), ("monde", "World")]


def test_prompt_lists_order(spark):
    g = gloss(spark, [("b", {"ja": "B"}, None, None, 1), ("10", {"ja": "X"}, None, None, 2),
                      ("a", {"ja": "A"}, None, None, 3), ("2", {"ja": "Y"}, None, None, 4)])
    lst = G.prompt_lists(g).collect()[0].glossary
    assert [x.term for x in lst] == ["2", "10", "b", "a"]


def test_apply_terms_longest_first_word_bounded(spark):
    g = spark.createDataFrame([("new york", "NY"), ("york", "Y"), ("or", "OR")], "term string, translation string")
    t = spark.createDataFrame([(1, "New York and york, or more"), (2, "yorkshire")], "id int, text string")
    got = dict(rows(G.apply_terms(t, g), "id", "applied"))
    assert got == {1: "NY and Y, OR more", 2: "yorkshire"}


def test_upsert_incoming_wins_with_colliding_seq(spark):
    cols = "term string, translations map<string,string>, context string, notes string, seq long"
    old = spark.createDataFrame([("A", {"fr": "a-old"}, None, None, 0), ("B", {"fr": "b-old"}, None, None, 1)], cols)
    new = spark.createDataFrame([("b", {"fr": "b-new"}, None, None, 0), ("c", {"fr": "c"}, None, None, 1)], cols)
    out = G.upsert(old, new).orderBy("seq").collect()
    assert [(r.term, r.translations["fr"]) for r in out] == [("A", "a-old"), ("b", "b-new"), ("c", "c")]
    split = new.selectExpr("term", "translations", "context", "notes", "struct(0L as blk, seq as mid) as seq")
    assert [r.term for r in G.upsert(old, split).orderBy("seq").collect()] == ["A", "b", "c"]


def test_apply_terms_in_one_pass(spark):
    cols = "term string, translation string, lang string, seq int"
    g = spark.createDataFrame([("new york", "York City", "x", 1), ("York", "old", "x", 1), ("york", "Y", "x", 2), ("C++", "C$1\\\\", "x", 1),
                               ("york", "other", "y", 3), ("İz", "iz", "x", 1), ("", "never", "x", 1), ("city here", "CH", "x", 1)], cols)
    t = spark.createDataFrame([(1, "x", "new york here"), (2, "x", "NEW YORK, York; newyork york_ C++ c+++"), (3, "y", "york new york"),
                               (4, "x", None), (5, "x", "İz İ york"), (6, "z", "york"), (7, "x", "")], "id int, lang string, text string")
    got = {r.id: r.applied for r in G.apply_terms(t, g, lang_col="lang").collect()}
    assert got == {1: "York City here", 2: "York City, Y; newyork york_ C$1\\\\ C$1\\\\+", 3: "other new other", 4: None, 5: "iz İ Y",
                   6: "york", 7: ""}


def test_apply_terms_equals_a_plain_scan(spark):
    import random
    rng = random.Random(3)
    terms = {" ".join(rng.choice("ab cd e F g").split(" ")[0] + rng.choice(["", "x"]) for _ in range(rng.randint(1, 3))) for _ in range(60)}
    g = {t.lower(): f"<{i}>" for i, t in enumerate(sorted(terms)) if t.strip()}
    texts = ["".join(rng.choice(["a", "b", "x", " ", " ", "F", "ax", ".", "g"]) for _ in range(rng.randint(0, 40))) for _ in range(200)]

    def plain(s):
        out, i, low = "", 0, s.lower()
        while i < len(s):
            for n in range(len(s) - i, 0, -1):
                j = i + n
                if low[i:j] in g and not (i and s[i - 1].isalnum() and s[i].isalnum()) and \
                        not (j < len(s) and s[j - 1].isalnum() and s[j].isalnum()):
                    out, i = out + g[low[i:j]], j
                    break
            else:
                out, i = out + s[i], i + 1
        return out
    got = G.apply_terms(spark.createDataFrame(list(enumerate(texts)), "id int, text string"),
                        spark.createDataFrame(list(g.items()), "term string, translation string")).collect()
    assert {r.id: r.applied for r in got} == {i: plain(s) for i, s in enumerate(texts)}


def test_merged_glossaries_merge_again(spark):
    cols = "term string, translations map<string,string>, context string, notes string, seq long"
    one = lambda *ts: spark.createDataFrame([(t, {"fr": t}, None, None, -i) for i, t in enumerate(ts)], cols)
    first = G.upsert(one("b", "a"), one("d", "c", "a"))
    again = G.upsert(first, G.upsert(one("f", "e"), one("b", "g")))
    assert [r.term for r in again.orderBy("seq").collect()] == ["a", "b", "c", "d", "e", "f", "g"]
