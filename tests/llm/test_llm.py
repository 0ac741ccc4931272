"""Small brute-force, round-trip and edge-case tests of the corpus operators."""

import hashlib
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from linguaspark.llm import ann, decontaminate, html, langid, ngram_join, pieces, quality, queries, secrets, sharding, suffixes
from linguaspark.llm.common import pick

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, Text string, shard int"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(20_000))
ODD = [(1, None), (2, ""), (3, "  \n"), (4, "one"), (5, "one"), (5, "one"), (None, "null id text here now"), (7, LONG), (8, LONG + " end")]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, short, repeated and long texts, a null id, extra columns with clashing names."""
    return spark.createDataFrame([(i, t, None, "s", 1, "clash", 9) for i, t in ODD], DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")


def plain(df):
    return pick(df, doc_id="doc_id", text="text")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))


def shingles(t, k):
    w = words(t)
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def clusters(rows, k, num):
    """Smallest id reachable, by comparing all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= num * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = [min((rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None), default=None)
           for i in range(len(rows))]
    return [o if s else r[0] for o, s, r in zip(out, sets, rows)]


# ------------------------------------------------------------------ sharding

def test_sharding_law_and_slots(spark, docs):
    p = sharding.shuffle_shards(docs, 16, bucket_bytes=4000).toPandas()
    assert sorted(p.doc_id) == sorted(r.doc_id for r in docs.collect())
    assert all(sorted(g) == list(range(len(g))) for _, g in p.groupby("shard").slot)
    moved = p[p.grown_shard != p["shard"]]
    assert set(moved.grown_shard) <= {16} and len(moved) < len(p) / 4
    again = sharding.shuffle_shards(docs.repartition(3), 16, bucket_bytes=4000).toPandas().set_index("doc_id").slot
    assert (p.set_index("doc_id").slot == again.loc[p.doc_id]).all()
    assert p.sort_values(["shard", "slot"]).doc_id.tolist() != p.sort_values(["shard", "doc_id"]).doc_id.tolist()


def test_sharding_odd_rows(spark, odd, tmp_path):
    out = sharding.shuffle_shards(odd, 4)
    assert out.count() == len(ODD) and out.columns.count("shard") == 1
    assert sharding.shuffle_shards(odd.limit(0), 4).count() == 0
    assert sharding.write_shards(odd, str(tmp_path / "s"), 4).count() == len(ODD)


def test_sharding_equals_its_law(spark, docs):
    """Size, crc32 and both shards recomputed; with xxhash64 of the xxhash library."""
    import zlib
    got = {r.doc_id: r for r in queries.op1_sharding(spark, SF).collect()}
    for r in docs.collect():
        raw = (r.text or "").encode()
        assert (got[r.doc_id]["size"], got[r.doc_id].text_crc32, got[r.doc_id].law) == (len(raw) + 1, zlib.crc32(raw), "key")
    for n, col in ((16, "shard"), (17, "grown_shard")):
        hashes = docs.select("doc_id", *[F.xxhash64(F.lit(17), F.lit(s), "doc_id").alias(f"s{s}") for s in range(n)]).collect()
        assert all(got[h.doc_id][col] == max(range(n), key=lambda s: h[f"s{s}"]) for h in hashes)


def test_sharding_hot_id_and_equal_rows(spark):
    """A third of the rows share one id, half of these are equal in everything: no bucket is far over its size."""
    text = "x" * 99
    rows = [(7, text, i) for i in range(3500)] + [(7, text, -1)] * 3500 + [(i, text, i) for i in range(100, 13100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra int").selectExpr("*", "parse_json('[1]') as v", "map(1, 2) as m")
    p = sharding.shuffle_shards(df, 4, bucket_bytes=20_000).select("doc_id", "shard", "bucket", "slot").toPandas()
    assert len(p) == len(rows) and p.groupby("bucket").size().max() <= 2 * 200
    assert all(sorted(g) == list(range(len(g))) for _, g in p.groupby("shard").slot)
    assert p[p.doc_id == 7]["shard"].nunique() == 1


# ------------------------------------------------------------------ secrets

def brute_spans(text):
    pat = {"assign": r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""}
    out = [(m.start(), 0, m.end()) for m in re.finditer(pat["assign"], text, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def scan(df, **kw):
    return secrets.scan(df, queries.tokenizer("byte_bpe_50k.tiktoken"), queries.split_pattern(), **kw)


def test_secrets_base_and_random(spark):
    key = "q7Zp2XvL9mK4tR8wYc3NbH6sJd1F"
    texts = ['é Token = "abcdef123" x', "AKIA" + "A1" * 9, "0123456789abcdef01234567", f"id {key} end", "paſſword=abcdefgh",
             "d41d8cd98f00b204e9800998ecf8427e", "550e8400-e29b-41d4-a716-446655440000", "some_long_identifier_name/with/path", None]
    got = scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), redact=True).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        base = brute_spans(t or "")
        assert r.base_sha256 == hashlib.sha256(secrets.spell(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in base) for j in range(3)]
    assert got[3].spans == f"random:3:{3 + len(key)}" and got[3].redacted == "id [SECRET] end"
    assert [r.n_random for r in got] == [0, 0, 0, 1, 0, 0, 0, 0, 0] and got[8].redacted is None


def test_secrets_key_beside_base_spans(spark):
    """What a base span does not cover of a run is still judged."""
    key, digest, access = "q7Zp2XvL9mK4tR8wYc3NbH6sJd1F", "d41d8cd98f00b204e9800998ecf8427e", "AKIA" + "A1" * 8
    texts = [f"/files/{digest}/{key} x", f"{access}/{key}", f"{digest}-{key}", f"{key}={digest}", f"{key}/{access}/{key}",
             f"{digest}/550e8400-e29b-41d4-a716-446655440000", f"{digest}/some_long_identifier_name"]
    got = scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), redact=True).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        assert r.base_sha256 == hashlib.sha256(secrets.spell(brute_spans(t)).encode()).hexdigest()
        assert key not in r.redacted and digest not in r.redacted and access not in r.redacted
    assert [r.n_random for r in got] == [1, 1, 1, 1, 2, 0, 0]
    assert got[0].redacted.startswith("/files/[SECRET]") and got[0].redacted.endswith(" x")
    assert got[5].redacted == f"[SECRET]{texts[5][32:]}" and got[6].redacted == f"[SECRET]{texts[6][32:]}"


def test_secrets_key_in_long_runs(spark):
    """Ordinary text joined to a key does not hide it, however long the run."""
    key, second = "q7Zp2XvL9mK4tR8wYc3NbH6sJd1F", "mX4/vQ9z+T7kLw2/Rb8Yp3Hs=="
    path = "application/components/configuration/documentation/development/"
    chain = "request_handler_configuration_manager_"
    texts = [path * 2 + key, path * 40 + key + "/" + path * 40, chain * 50 + key, path * 2 + second, path * 3 + key + "=" + path + second,
             path * 2 + "qZpXvLmKtRwYcNbHsJdFgWxQ", path * 60, chain * 60, path * 2 + "550e8400-e29b-41d4-a716-446655440000/" + path,
             path + "D41D8CD98F00B204E9800998ECF8427E/" + path, path + "2021/03/04/12345678901234567890/" + path]
    got = scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), redact=True).orderBy("doc_id").collect()
    at = len(path) * 40
    assert got[0].redacted == path * 2 + "[SECRET]"
    assert got[1].spans == f"random:{at}:{at + len(key)}" and got[2].redacted == chain * 50 + "[SECRET]"
    assert got[3].redacted == path * 2 + "[SECRET]" and key not in got[4].redacted and second not in got[4].redacted
    assert got[5].redacted == path * 2 + "[SECRET]"
    assert [r.n_random for r in got[6:]] == [0] * 5


def test_secrets_in_capitals(spark):
    """Random capitals are found, words in capitals are not."""
    rng = random.Random(8)
    keys = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(rng.randint(24, 64))) for _ in range(100)]
    plain_words = ["CONFIGURATIONMANAGEMENT", "INTERNATIONALIZATION", "AUTHENTICATIONPROVIDER", "RESPONSIBILITIES2024"]
    got = scan(spark.createDataFrame(list(enumerate(keys + plain_words)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert sum(r.n_random > 0 for r in got[:100]) >= 95
    assert [r.n_random for r in got[100:]] == [0] * 4


def test_best_parts_equal_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        x = [rng.randint(-4, 4) for _ in range(rng.randint(0, 12))]
        want, todo = [], [(0, len(x))]
        while todo:  # by definition: the best stretch (the shortest of equal sums, then the first), then both sides
            a, b = todo.pop()
            best = max(((sum(x[i:j]), i - j, -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            if best[0] > 0:
                want.append(best[3:])
                todo += [(a, best[3]), (best[4], b)]
        got = secrets.best_parts(x)
        assert sum(sum(x[i:j]) for i, j in got) == sum(sum(x[i:j]) for i, j in want)
        assert {i for i, v in enumerate(x) if v > 0} <= {i for a, b in got for i in range(a, b)}


def test_secrets_odd_rows(odd):
    assert {r.spans for r in scan(odd).collect()} == {""}
    assert scan(odd.limit(0)).count() == 0


# ------------------------------------------------------------------ decontamination

def test_decontamination_equals_brute_force(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(docs, items).collect()}
    ds, its = [(r[0], shingles(r[1], 5)) for r in docs.collect()], [(r[0], shingles(r[1], 5)) for r in items.collect()]
    assert got == {(d, i) for d, a in ds for i, b in its if b and len(a & b) >= 0.8 * len(b)} and got
    kept = {r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()}
    assert kept == {d for d, _ in ds} - {d for d, _ in got}


def test_decontamination_text_ids_and_equal_items(spark):
    words = [f"w{i}" for i in range(40)]
    item, other = " ".join(words[10:22]), " ".join(f"x{i}" for i in range(12))
    docs = spark.createDataFrame([("d1", " ".join(words)), ("d2", " ".join(words)), ("d3", "nothing of it here at all")],
                                 "doc_id string, text string")
    items = spark.createDataFrame([("q-a", item), ("q-b", item.upper()), ("q-c", other), (None, item)], "item_id string, text string")
    got = Counter((r.doc_id, r.item_id, r.n_shared) for r in decontaminate.find(docs, items).collect())
    assert got == Counter({(d, i, 8): 1 for d in ("d1", "d2") for i in ("q-a", "q-b", None)})
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()] == ["d3"]


def test_decontamination_bit_table_follows_the_keys():
    assert [decontaminate.table_bits(n) for n in (0, 1000, 1 << 20, 1 << 21, 1 << 23, 1 << 40)] == [24, 24, 25, 26, 27, 27]


def test_decontamination_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (4, LONG[500:900])], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.find(odd, items).collect())
    assert got == {(4, 3): 1, (5, 3): 2, (7, 4): 1, (8, 4): 1}
    assert decontaminate.find(odd, items.limit(0)).count() == 0
    assert decontaminate.find(odd.limit(0), items).count() == 0


# ------------------------------------------------------------------ html

def test_html_blocks_and_labels(spark):
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]
    model = html.train(pages[:60])
    wrong = n = 0
    for p in pages:
        bs = html.blocks(p)
        y = model.label([html.vectors(bs)])[0] >= 0.5
        wrong += sum(v != ("article" in b.path) for v, b in zip(y, bs))
        n += len(bs)
    assert wrong <= 0.005 * n
    bs = html.blocks("<p>a &amp;\n b<br>c<script>x</script><p>d <b>e</b> < f<!-- g --><div class='x>y'>h")
    assert [b.text for b in bs] == ["a & b c", "d e < f", "h"]
    assert html.blocks(None) == [] and html.blocks("<script>never closed") == []


def test_html_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, None, "<article><p>x"), (3, None, "<article><p>x")],
                               "page_id long, url string, html string")
    got = html.extract(df).collect()
    assert len(got) == 4 and got[0].text == "" and got[0].n_chars == 0
    assert html.extract(df.limit(0)).count() == 0


# ------------------------------------------------------------------ suffix array

def test_two_stage_order():
    rng = np.random.default_rng(1)
    for n, a in [(1, 2), (40, 2), (500, 3), (900, 200)]:
        t = rng.integers(0, a, n).astype(np.uint8)
        b = t.tobytes()
        assert suffixes.two_stage_order(t, n + 8).tolist() == sorted(range(n), key=lambda i: b[i:])


@pytest.mark.parametrize("block,piece", [(2 << 20, 4096), (900, 300)])
def test_suffix_dedup_equals_brute_force(spark, docs, odd, monkeypatch, block, piece):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffixes, "PIECE", piece)
    df = docs.select("doc_id", "text").union(plain(odd).where("doc_id < 7 or doc_id is null").select(F.col("doc_id") + 10**6, "text"))
    df = df.union(spark.createDataFrame([(10**7, "ab " * 200), (10**7 + 1, "é" * 150), (None, LONG[:9000]), (10**7 + 2, LONG[300:9300])],
                                        "doc_id long, text string"))
    # runs of spaces of several lengths; a passage with other words before and behind it in each text
    rng, passage = random.Random(4), LONG[20_000:20_400]
    own = [f"{rng.random()}{' ' * (700 + i)}{rng.random()}" for i in range(4)]
    own += [" ".join([*(str(rng.random()) for _ in range(12)), passage, *(str(rng.random()) for _ in range(12))]) for _ in range(25)]
    df = df.union(spark.createDataFrame(list(enumerate(own, 10**8)), "doc_id long, text string"))
    rows = [(r[0], (r[1] or "").encode()) for r in df.collect()]
    seen = Counter(b[j:j + 200] for _, b in rows for j in range(len(b) - 199))
    want = Counter()
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 199):
            if seen[b[j:j + 200]] > 1:
                gone[j:j + 200] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0]))) == 1)
        want[i, len(b), int(gone.sum()), len(edge), hashlib.sha256(kept).hexdigest()] += 1
    got = Counter(tuple(r) for r in suffixes.dedup(df).drop("kept").collect())
    assert got == want
    assert suffixes.dedup(df.limit(0)).count() == 0


def test_suffix_dedup_long_texts_null_ids_clashing_columns(spark, odd):
    n = len(LONG.encode())
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.dedup(odd).collect())
    assert got == Counter((i, len((t or "").encode()), n if i in (7, 8) else 0, int(i in (7, 8)),
                           b" end" if i == 8 else b"" if i == 7 else (t or "").encode()) for i, t in ODD)


# ------------------------------------------------------------------ pieces

def test_pieces_equal_the_library(spark, odd):
    import sentencepiece
    path = queries.tokenizer("piece_bpe_32k.model")
    own, lib = pieces.Pieces(open(path, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(5)
    parts = ["a", "th", "er", " ", "  ", "\n", "\t", ".", "é", "漢", "▁", "</s>", "_", "²", "{", " " * 33, "\x00", "🙂", "'s", "==", "ing", "A"]
    for t in ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + ["a" * 5000, " " * 999, LONG[:20000]]:
        ids = lib.encode(t, add_bos=True, add_eos=True)
        assert own.encode(t) == struct.pack(f"<{len(ids)}I", *ids)
        assert own.decode(ids) == lib.decode(ids)
    got = pieces.encode(odd, path).collect()
    assert len(got) == len(ODD) and got[0].n_tokens == 2 and got[7].decoded == LONG
    assert pieces.encode(odd.limit(0), path).count() == 0


# ------------------------------------------------------------------ n-gram join

@pytest.mark.parametrize("k,num,frequent,crowded", [(3, 90, 64, 512), (5, 80, 64, 512), (2, 75, 2, 3)])
def test_ngram_join_equals_brute_force(spark, docs, monkeypatch, k, num, frequent, crowded):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "LOCAL_LEAST", min(4, frequent))
    monkeypatch.setattr(ngram_join, "CROWDED", crowded)
    rng = random.Random(2)
    base = words(LONG)[:120]
    near = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"new{rng.random()}"
        near.append((10**6 + i, " ".join(w)))
    df = docs.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string"))
    rows = [tuple(r) for r in df.collect()]
    want = {i: (len(shingles(t, k)), c) for (i, t), c in zip(rows, clusters(rows, k, num))}
    got = {r.id: (r.n_shingles, r.component) for r in ngram_join.join(df, k=k, num=num).collect()}
    assert got == want


def test_ngram_join_odd_rows(odd):
    got = Counter((r.id, r.n_shingles, r.component) for r in ngram_join.join(odd).collect())
    n = len(shingles(LONG, 3))
    assert got == {(1, 0, 1): 1, (2, 0, 2): 1, (3, 0, 3): 1, (4, 1, 4): 1, (5, 1, 4): 2, (None, 3, None): 1, (7, n, 7): 1, (8, n + 1, 7): 1}
    assert ngram_join.join(odd.limit(0)).count() == 0
    kept = sorted((r.doc_id or 0) for r in ngram_join.keep_one(plain(odd), k=3, num=90).collect())
    assert kept == [0, 1, 2, 3, 4, 7]


# ------------------------------------------------------------------ quality

def test_quality_against_labels(spark, docs):
    got = {r.doc_id: r.accepted for r in quality.score(docs).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == docs.count()
    assert np.mean([got[i] == bool(q) for i, q in labels.items()]) > 0.95


def test_accuracies_of_known_voters_are_found():
    rng = np.random.default_rng(5)
    truth = np.array([0.95, 0.6, 0.9, 0.7, 0.8, 0.65, 0.85, 0.75, 0.92])
    for n in (20_000, 200_000):
        good = rng.random(n) < 0.5
        right = rng.random((n, 9)) < truth
        v = np.where(rng.random((n, 9)) < 0.3, 0, np.where(right == good[:, None], 1, 2))
        got = quality.estimate(Counter("".join(map(str, row)) for row in v.tolist()))
        assert np.abs(got - truth).max() < 0.03


def test_quality_odd_rows(odd):
    got = {r.doc_id: r.score for r in quality.score(odd).collect()}
    assert got[1] == got[2] == got[3] == 0 and len(got) == 8
    assert quality.score(odd.limit(0)).count() == 0


# ------------------------------------------------------------------ neighbours

def test_neighbours_recall_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.normal(size=(1500, 16)), np.tile(rng.normal(size=(1, 16)), (700, 1))))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [None] * 16), (5400, [1.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("id") % 100 == 0).collect()
    hit = n = 0
    for q in range(0, len(x), 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        mine = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])]
        assert len(mine) == 10
        hit += len(set(order) & set(mine))
        n += 10
        if q >= 1500:
            assert mine == order
    assert hit / n >= 0.9 and all(r.query_id < 5000 for r in got)
    assert ann.search(df.limit(0), F.col("id") % 100 == 0).count() == 0
    assert ann.search(df.where("vec_id in (0, 1)"), F.col("id") % 100 == 0).count() == 1


def test_neighbours_small_outlier_groups(spark):
    """Most rows equal, the rest far groups of four: every query gets its ten, also one whose id stands on many rows."""
    rng = np.random.default_rng(4)
    hot = np.tile(rng.normal(size=(1, 8)), (4000, 1))
    far = np.repeat(rng.normal(size=(60, 8)) * 50, 4, axis=0) + rng.normal(size=(240, 8)) * 0.01
    x = np.concatenate((hot, far))
    ids = list(range(len(x))) + [4000] * 30  # 30 more rows with a query's id
    df = spark.createDataFrame([(i, x[i].tolist()) for i in ids], "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("id") >= 4000, leaf_rows=16).collect()
    mine = {}
    for r in got:
        mine.setdefault(r.query_id, []).append(r["rank"])
    assert {q: sorted(v) for q, v in mine.items()} == {q: list(range(1, 11)) for q in range(4000, 4240)}
    assert all(r.query_id != r.vec_id for r in got)
    few = df.where("vec_id in (4000, 4001, 4005)")
    assert Counter(r.query_id for r in ann.search(few, F.col("id") >= 4000).collect()) == {4000: 2, 4001: 10, 4005: 10}


# ------------------------------------------------------------------ language

def test_langid_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_langid_odd_rows(odd):
    assert {(r.lang_pred, r.score) for r in langid.identify(odd).collect()} == {("und", 0.0)}
    assert langid.identify(odd.limit(0)).count() == 0


# ------------------------------------------------------------------ pipeline

def test_pipeline_stages(spark, docs):
    import corpus_pipeline as P
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "tokens"]
    ids, d = [], docs
    for _, stage in P.STAGES[:-1]:
        d = stage(spark, d, SF)
        assert d.columns == docs.columns
        ids.append({r.doc_id for r in d.collect()})
    assert ids[0] >= ids[1] >= ids[2] == ids[3]
    assert {r.doc_id for r in P.run(spark, SF).collect()} == ids[3]


def test_pipeline_stages_with_clashing_names(spark, odd):
    import corpus_pipeline as P
    key = "q7Zp2XvL9mK4tR8wYc3NbH6sJd1F"
    df = odd.union(spark.createDataFrame([(90, f"id {key} end", None, "s", 1, key, 9)], DOC))
    assert P.quality_filter(spark, df, SF).columns == df.columns
    d = df
    for _, stage in P.STAGES[1:-1]:
        d = stage(spark, d, SF)
        assert d.columns == df.columns
    got = {r[0]: tuple(r) for r in d.collect()}
    assert got[90] == (90, "id [SECRET] end", None, "s", 15, key, 9)
    assert sorted(i or 0 for i in got) == [0, 1, 2, 3, 4, 7, 90]
    assert P.tokens(spark, d, SF).count() == len(got)
