import random

from linguaspark.operators import usage as U
from helpers import rows


def code(spark, files):
    return spark.createDataFrame(list(files.items()), "file string, content string")


def test_extract_keys_lines_and_quirks(spark):
    src = ("import x;\nconst { t } = useTranslation();\nt('a.b'); t('a.b');\n"
           "alert(\"hi there\")\nconst y = t(\n  'multi.line')\n")
    got = rows(U.extract_keys(code(spark, {"f.jsx": src})), "key", "line")
    # the same key twice on one line gives two rows; alert(" matches (no word boundary);
    # a call whose quote is on the next line reports the line of "t("
    assert got == [("a.b", 3), ("a.b", 3), ("hi there", 4), ("multi.line", 5)]


def test_extract_keys_only_hook_files(spark):
    f = code(spark, {"a.jsx": "const { t } = useTranslation()\nt('k1')", "b.jsx": "t('k2')"})
    assert rows(U.extract_keys(f, only_hook_files=True), "key") == [("k1",)]
    assert rows(U.extract_keys(f), "key") == [("k1",), ("k2",)]


def test_contexts_window_clipped_and_substring(spark):
    f = code(spark, {"a.txt": "line1\nkey1\nline3\nline4\nline5\nline6\nkey1 again",
                     "b.txt": "auth.loginTitle here"})
    keys = spark.createDataFrame([("key1",), ("auth.login",), ("nothere",)], "key string")
    got = rows(U.key_contexts(keys, f), "key", "file", "line_no", "context")
    assert got == [("auth.login", "b.txt", 1, "auth.loginTitle here"),
                   ("key1", "a.txt", 2, "line1\nkey1\nline3\nline4"),
                   ("key1", "a.txt", 7, "line5\nline6\nkey1 again")]


def test_substring_join_matches_brute_force(spark):
    rnd = random.Random(7)
    alpha = "abcde."
    hay = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    needles = sorted({"".join(rnd.choice(alpha) for _ in range(rnd.randint(1, 6))) for _ in range(80)})
    h = spark.createDataFrame([(i, t) for i, t in enumerate(hay)], "hid int, text string")
    n = spark.createDataFrame([(x,) for x in needles], "needle string")
    got = rows(U.substring_join(n, h).select("needle", "hid"))
    want = sorted((x, i) for x in needles for i, t in enumerate(hay) if x in t)
    assert got == want


def test_first_contexts_and_text(spark):
    f = code(spark, {"a.js": "k\nk\nk\nk", "b.js": "k"})
    keys = spark.createDataFrame([("k",), ("none",)], "key string")
    ctx = U.key_contexts(keys, f, n=0)
    top = rows(U.first_contexts(ctx), "key", "file", "line_no", "rank")
    assert top == [("k", "a.js", 1, 1), ("k", "a.js", 2, 2), ("k", "a.js", 3, 3)]
    text = dict(rows(U.context_text(keys, ctx), "key", "text"))
    assert text["k"] == 'Key "k" is used in:\n- a.js:1\n  k\n- a.js:2\n  k\n- a.js:3\n  k'
    assert text["none"] == 'Key "none" - no usage context found'


def test_context_stats_and_status(spark):
    f = code(spark, {"a.js": "t('x')\nt('y')\nfoo"})
    keys = spark.createDataFrame([("x",), ("zzz",)], "key string")
    st = U.context_stats(keys, U.key_usages(keys, f)).collect()[0]
    assert (st.n_contexts, st.n_keys_with_context, st.n_keys) == (1, 1, 2)
    cat = spark.createDataFrame([("x",), ("q",)], "key string")
    got = rows(U.usage_status(U.extract_keys(f), cat), "key", "status")
    assert got == [("q", "unused"), ("x", "used"), ("y", "undefined")]


def test_path_filter(spark):
    df = spark.createDataFrame([("src/a.ts",), ("node_modules/x/a.ts",), ("a/dist/b.js",), ("c.py",),
                                ("d.bin",), ("vendor/v.go",)], "p string")
    keep = rows(df.where(U.path_filter("p", U.CONTEXT_EXTENSIONS, U.CONTEXT_EXCLUDES)))
    assert keep == [("c.py",), ("src/a.ts",)]


def test_substring_join_above_broadcast_bound(spark):
    hay = spark.createDataFrame([(1, "ab.cde"), (2, "xyz"), (3, "a")], "hid int, text string")
    n = spark.createDataFrame([("a",), ("cd",), ("xyz",), ("q",)], "needle string")
    got = rows(U.substring_join(n, hay, broadcast_rows=1).select("needle", "hid"))
    assert got == [("a", 1), ("a", 3), ("cd", 1), ("xyz", 2)]


def test_extract_keys_marks_and_no_shuffle(spark):
    f = code(spark, {"a.js": "\u0001t('a\u0001b')\nt('t(\"x\"') t(\n'c\nd')\n\u0002t('e')", "empty.js": "", "none.js": None})
    keys = U.extract_keys(f)
    assert rows(keys, "file", "key", "line") == [("a.js", "a\u0001b", 1), ("a.js", "c\nd", 2), ("a.js", "e", 5),
                                                 ("a.js", "t(", 2)]
    assert "Exchange" not in keys._jdf.queryExecution().executedPlan().toString()


def test_context_of_every_width_matches_brute_force(spark):
    files = {"a": "k\nx\nk k\n\ny\nz\nk", "b": "k", "c": "", "d": None, "e": "x\n" * 50 + "k"}
    keys = spark.createDataFrame([("k",), ("x",)], "key string")
    for n in (0, 1, 2, 7):
        want = []
        for name, text in files.items():
            lines = (text or "").split("\n")
            want += [(k, name, i + 1, "\n".join(lines[max(0, i - n):i + n + 1]))
                     for k in "kx" for i, line in enumerate(lines) if k in line]
        assert rows(U.key_contexts(keys, code(spark, files), n=n)) == sorted(want)


def test_substring_join_in_blocks_by_bytes(spark):
    hay = spark.createDataFrame([(i, f"item {i} of part.{i}.name") for i in range(200)], "hid int, text string")
    n = spark.createDataFrame([(f"part.{i}.name", i) for i in range(0, 200, 5)], "needle string, nid int")
    got = rows(U.substring_join(n, hay, broadcast_bytes=100).select("nid", "hid"))
    assert got == [(i, i) for i in range(0, 200, 5)]


def test_substring_join_goes_through_the_hay_twice_at_most(spark):
    hay = spark.range(400).selectExpr("id as hid", "concat('t(part.', id, '.name) red ring') as text")
    n = spark.createDataFrame([(f"part.{i}.name",) for i in range(400)] + [("ring",), ("r",)], "needle string")
    found = U.substring_join(n, hay, broadcast_rows=2, broadcast_bytes=100)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (") <= 2
    got = rows(found.select("needle", "hid"))
    assert got == sorted([(f"part.{i}.name", i) for i in range(400)] + [(x, i) for x in ("ring", "r") for i in range(400)])


def test_needles_are_looked_up_by_a_gram_of_their_own(spark):
    nd = spark.range(1000, 3000).selectExpr("concat('part.', id, '.name') as _n")
    grams = U._needle_grams(nd, U._gram_sizes(3))
    assert grams.count() == grams.select("_gram").distinct().count() == 2000


def test_substring_join_of_bytes_matches_brute_force(spark):
    rnd = random.Random(11)
    word = lambda n, letters: "".join(rnd.choice(letters) for _ in range(n))
    hay = [word(rnd.randint(0, 90), "ab\u00e9\u6587\U0001f600 ") for _ in range(150)] + ["a" * 200, "", None, "x" * (U.CUT_BYTES + 5)]
    needles = {t[i:i + rnd.randint(1, 60)] for t in hay[:150] if t for i in [rnd.randrange(len(t))]}
    needles |= {"aaa", "a" * 120, "x" * 50, "zz", word(45, "ab")}
    h = spark.createDataFrame(list(enumerate(hay)), "hid int, text string")
    n = spark.createDataFrame([(x,) for x in sorted(needles)] + [("",), (None,), ("aaa",)], "needle string")
    got = rows(U.substring_join(n, h, broadcast_rows=40).select("needle", "hid"))
    assert got == sorted((x, i) for x in needles for i, t in enumerate(hay) if t and x in t)


def test_gram_counts_are_joined_by_shuffle_however_small_the_estimate(spark):
    # longer than their gram, so that they have a choice; the estimate of the range is far below any broadcast bound
    nd = spark.range(1000, 1400).selectExpr("concat('some.key.', id, '.title') as _n").union(spark.createDataFrame([("ab",), ("zz",)], "_n string"))
    grams = U._needle_grams(nd, U._gram_sizes(3))
    assert "Broadcast" not in grams._jdf.queryExecution().executedPlan().toString()
    assert grams.count() == grams.select("_n").distinct().count() == grams.select("_gram").distinct().count() == 402


def test_hay_sends_the_searched_text_alone_to_python(spark):
    hay = spark.createDataFrame([(1, "red ring", "around"), (2, None, "x"), (3, "", "red"), (4, "red red", None)], "hid int, text string, ctx string")
    n = spark.createDataFrame([("red",), ("ring",), ("red ring",)], "needle string")
    found = U.substring_join(n, hay)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "[probe(text" in plan and plan.count("probe(") <= 2
    assert rows(found.select("needle", "hid")) == [("red", 1), ("red", 4), ("red ring", 1), ("ring", 1)]
