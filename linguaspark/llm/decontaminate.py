"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are short, documents may be long, so whole-document signatures
would drown an item. Items are partitioned by the size of their shingle set
(classes grow by half). For each class a document is cut into overlapping
windows of twice the class size, so an item that stands in the document
lies within one window and their Jaccard similarity is at least a quarter at
the default containment. Each of ``bands`` minima of a window is a key; one
equal minimum makes a candidate. At a similarity of 1/4, 48 minima miss one
pair in a million. Candidates are verified by exact containment of the
item's shingles in the whole document.

Keys that no item has are dropped in the scan by a bit table sized by the
counted keys; the rest meets the items' keys in an equi-join. Items of equal
shingle sets are searched as one and told apart at the end; candidates are
pairs of digests, and shingle sets join them only for the exact check. No
document text is shuffled except those of candidates.

The bit table has 16 bits a key, from 2^24 to 2^27 bits (16 MB). It is at its
bound from 8 million keys on (170,000 different items) and passes ever more
keys beyond that, which costs time and no results.

Defined cases: null and empty texts and items have no shingles and match
nothing; with fewer than k words the whole sequence is the one shingle, so an item of
fewer than k words is found only as a whole document, not inside a longer
one (the registered SQL has the same rule);
items of equal shingles are reported each, whatever the type of their ids; equal documents are reported each; an empty
table on either side gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linguaspark.llm.common import (BITS, U64, bit_table, cut_lineage, in_bits, may_be, mix, pick,
                                    returning, shingle_hashes, shingle_set, texts_by_hash, with_text_hash, word_hashes)

GROWTH = 1.5
BANDS = 48


def size_class(n: int) -> int:
    """The least c with n <= class_size(c)."""
    c = 0
    while class_size(c) < n:
        c += 1
    return c


def class_size(c: int) -> int:
    return int(np.ceil(GROWTH ** c))


def _seeds(bands: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    return x[:bands], x[bands:] | U64(1)


def keys_of(minima: np.ndarray, c: int, first: int) -> np.ndarray:
    """Keys of minima (bands x windows) for class ``c``; ``first`` is the number of the first band."""
    band = np.arange(first + 1, first + 1 + len(minima), dtype=U64) + U64(c * 4096)
    return mix(minima ^ (band * U64(0xD1342543DE82EF95))[:, None])


def window_keys(shingles: np.ndarray, classes: list[int], bands: int, cells: int = 4_000_000) -> np.ndarray:
    """Keys of every window of a document (shingles in text order) for the classes; bands in turns for long texts."""
    out = []
    xor, odd = _seeds(bands)
    step = max(1, cells // len(shingles))
    for at in range(0, bands, step):
        h = (shingles[None] ^ xor[at:at + step, None]) * odd[at:at + step, None]
        h ^= h >> U64(32)
        for c in classes:
            block = np.minimum.reduceat(h, np.arange(0, h.shape[1], class_size(c)), axis=1)
            both = np.minimum(block[:, 1:], block[:, :-1]) if block.shape[1] > 1 else block
            out.append(keys_of(both, c, at).ravel())
    return np.concatenate(out) if out else np.empty(0, U64)


def item_keys(shingles: np.ndarray, bands: int) -> np.ndarray:
    xor, odd = _seeds(bands)
    h = (shingles[None] ^ xor[:, None]) * odd[:, None]
    low = (h ^ h >> U64(32)).min(1)
    return keys_of(low[:, None], size_class(len(shingles)), 0).ravel()


def table_bits(n_keys: int) -> int:
    """Size of the bit table, as a power of two, for so many keys."""
    return min(27, max(BITS, (16 * n_keys).bit_length()))


def contained(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id",
              item_text: str = "text", k: int = 5, containment: float = 0.8,
              bands: int = BANDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents (doc_id, text, th), the found pairs (th, sid, n_shingles, n_shared) and the items (item_id, sid).

    th is the hash of a text, sid the digest of an item's shingle set; ids keep their type.
    """
    spark = docs.sparkSession
    d = with_text_hash(pick(docs, doc_id=id, text=text))
    tests = pick(items, item_id=item_id, text=item_text)

    @F.pandas_udf("s binary, keys array<long>, c int")
    def signed(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            s = shingle_set(t, k)
            rows.append((s.tobytes(), item_keys(s, bands).view(np.int64), size_class(len(s))) if len(s) else (None, None, None))
        return pd.DataFrame(rows, columns=["s", "keys", "c"]).astype({"c": "Int32"})

    marked = tests.withColumn("x", signed("text")).where("x.s is not null").select(
        "item_id", F.sha2("x.s", 256).alias("sid"), "x.*")
    marked = cut_lineage(marked, "decontaminate-items")
    members = marked.select("item_id", "sid")
    alike = marked.groupBy("sid").agg(F.first(F.struct("s", "keys", "c")).alias("x")).select("sid", "x.*")
    index = cut_lineage(alike.select("sid", "c", F.explode("keys").alias("key")), "decontaminate-keys")
    classes = sorted(r["c"] for r in index.select("c").distinct().collect())  # a few: sizes grow by half
    size = table_bits(index.count())
    bits = bit_table(spark, index, "key", size)

    @returning
    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ths, keys = [], []
            for th, t in zip(b["th"], b["text"], strict=True):
                s = shingle_hashes(word_hashes(t)[0], k)
                if len(s):
                    found = window_keys(s, classes, bands)
                    found = np.unique(found[in_bits(bits.value, found, size)])
                    ths.append(np.full(len(found), th, np.int64))
                    keys.append(found.view(np.int64))
            if ths:
                yield pd.DataFrame({"th": np.concatenate(ths), "key": np.concatenate(keys)})

    hits = d.where("th is not null").select("th", "text").mapInPandas(probe, "th long, key long")
    pairs = cut_lineage(hits.join(index.select("key", "sid"), "key").select("th", "sid").distinct(), "decontaminate-pairs")
    texts = texts_by_hash(d, pairs.select("th").distinct())

    @returning
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"th": b["th"], "own": [shingle_set(t, k).tobytes() for t in b["text"]]})

    @F.pandas_udf("long")
    def shared(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([len(np.intersect1d(np.frombuffer(x, U64), np.frombuffer(y, U64), assume_unique=True))
                          for x, y in zip(a, b, strict=True)])

    found = (pairs.join(marked.select("sid", "s").groupBy("sid").agg(F.first("s").alias("s")), "sid")
             .join(texts.mapInPandas(sets, "th long, own binary"), "th")
             .select("th", "sid", (F.octet_length("s") / 8).cast("long").alias("n_shingles"), shared("own", "s").alias("n_shared"))
             .where(F.col("n_shared") >= containment * F.col("n_shingles")))
    return d, cut_lineage(found, "decontaminate-found"), members


def find(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of every item contained in a document; see ``contained``."""
    d, found, members = contained(docs, items, **options)
    return (d.select("doc_id", "th").join(found, "th").join(members, "sid")
            .select("doc_id", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment")))


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that contain an item; only documents that may contain one are shuffled."""
    _, found, _ = contained(docs, items, text=text, **options)
    bad = cut_lineage(found.select("th").distinct(), "decontaminate-bad")
    keyed = docs.withColumn("__th", F.when(F.col(text).isNotNull(), F.xxhash64(text)))
    apart = may_be(keyed, "__th", bad, "th", keep=False).drop("__th")
    met = may_be(keyed, "__th", bad, "th").join(bad.withColumnRenamed("th", "__th"), "__th", "left_anti").drop("__th")
    return apart.unionByName(met)
