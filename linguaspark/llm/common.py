"""Shared helpers of the llm operators: column picking, word hashing, components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linguaspark.session import cut_lineage

U64 = np.uint64
BITS = 24  # size of the bit tables: 2^24 bits, 2 MB, whatever the input


def returning(f):
    """For functions over batches in Python workers: memory goes back to the system when a task ends.

    Spark uses a worker again for the tasks of other stages; without this,
    each keeps the most that any of them ever took.
    """
    @functools.wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # glibc only
                ctypes.CDLL(None).malloc_trim(0)
    return run


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """``df`` reduced to the named columns, ``pick(df, id="doc_id")`` selects doc_id as id.

    Columns are resolved by position, so frames whose other columns clash
    (same name twice, or names differing in case only) work: an exact name
    wins over one that differs in case, the first of equal names wins.
    """
    names = df.columns
    flat = df.toDF(*[f"__c{i}" for i in range(len(names))])
    out = []
    for dst, src in cols.items():
        hits = [i for i, n in enumerate(names) if n == src] or \
               [i for i, n in enumerate(names) if n.lower() == src.lower()]
        if not hits:
            raise ValueError(f"column {src!r} not found in {names}")
        out.append(F.col(f"__c{hits[0]}").alias(dst))
    return flat.select(*out)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit (in place)."""
    h ^= h >> U64(33)
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


_BASE = 0x9E3779B97F4A7C15 | 1
_POW: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}
BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


def _powers(kind: str, n: int) -> np.ndarray:
    """Powers of the odd base ("up") or of its inverse modulo 2^64 ("down")."""
    p = _POW[kind]
    if len(p) < n:
        step = U64(_BASE if kind == "up" else pow(_BASE, -1, 1 << 64))
        size = 1 << (n - 1).bit_length()
        full = np.full(size, step, U64)
        full[0] = 1
        p = _POW[kind] = np.multiply.accumulate(full)
    return p[:n]


class Spans:
    """64-bit hashes of any byte ranges of one buffer, from one pass of prefix sums.

    H(s, e) = sum of value(b[i]) * base^(i - s); equal bytes give equal
    hashes wherever they stand.
    """

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(BYTE_VALUE[buf] * _powers("up", n), out=self.sums[1:])
        self.down = _powers("down", n + 1)

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        h += (ends - starts).astype(U64) * U64(0xA24BAED4963EE407)
        return mix(h)

    def windows(self, size: int) -> np.ndarray:
        """Hash of every window of ``size`` bytes."""
        n = len(self.sums) - size
        if n <= 0:
            return np.empty(0, U64)
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_bytes(text: str | None) -> np.ndarray:
    """UTF-8 bytes of a text (null: none); lone surrogates cannot occur in Spark strings."""
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words ``[^\\x20\\x09-\\x0D]+``."""
    solid = np.zeros(len(buf) + 2, bool)
    solid[1:-1] = ~_IS_SPACE[buf]
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    return edge[::2], edge[1::2]


def word_hashes(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words of a text, A-Z lower-cased."""
    buf = _LOWER[text_bytes(text)]
    s, e = word_bounds(buf)
    return Spans(buf).hash(s, e), s, e


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, in order; fewer words: one hash of them all."""
    n = len(words)
    if n == 0:
        return np.empty(0, U64)
    m = min(k, n)
    h = np.full(n - m + 1, m, U64)
    for i in range(m):
        h = mix((h ^ words[i:n - m + 1 + i]) * U64(0x9FB21C651E98DF25) + U64(i + 1))
    return h


def hash_sample(df: DataFrame, cols: list[str], n: int) -> DataFrame:
    """At most ``n`` rows of least hash of ``cols``.

    A first cut by the share of rows wanted leaves about 1.2 n rows in all,
    so that tasks hand on only their part of the sample, however many they are.
    """
    total = df.count()
    h = F.pmod(F.xxhash64(F.lit(n), *cols), F.lit(1 << 30))
    if total > n:
        df = df.where(h < int((1.2 * n + 20) / total * (1 << 30)) + 1)
    return df.orderBy(h, *cols).limit(n)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The distinct shingles of a text, as sorted 64-bit hashes."""
    return np.unique(shingle_hashes(word_hashes(text)[0], k))


def bit_words(keys: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """The leading bits of every key as a bit array: (w, b), the number of a 64-bit word and its value."""
    return (keys.select(F.shiftrightunsigned(key, 64 - bits).alias("c")).groupBy(F.shiftright("c", 6).alias("w"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(c & 63 as int))")).alias("b")))


def bit_table(spark: SparkSession, keys: DataFrame, key: str, bits: int = BITS):
    """A broadcast bit array of 2^bits bits with the leading bits of every key set."""
    table = np.zeros(1 << (bits - 6), np.int64)
    got = bit_words(keys, key, bits).toPandas()  # at most 2^(bits - 6) rows
    table[got["w"].to_numpy()] = got["b"].to_numpy()
    return spark.sparkContext.broadcast(table)


def in_bits(table: np.ndarray, keys: np.ndarray, bits: int = BITS) -> np.ndarray:
    c = keys.view(U64) >> U64(64 - bits)
    return (table.view(U64)[(c >> U64(6)).astype(np.int64)] >> (c & U64(63)) & U64(1)).astype(bool)


def with_text_hash(d: DataFrame) -> DataFrame:
    """Adds ``th``, a hash of the column text (null for a null text)."""
    return d.withColumn("th", F.when(F.col("text").isNotNull(), F.xxhash64("text")))


def may_be(df: DataFrame, key: str, keys: DataFrame, of: str, keep: bool = True, bits: int = BITS) -> DataFrame:
    """Rows of ``df`` whose 64-bit ``key`` may be among ``keys`` (or, without ``keep``, surely is not).

    The bit table of the keys is joined as a broadcast of at most
    2^(bits - 6) rows, so this is a filter in the scan, without a shuffle.
    A null key is in no table.
    """
    words = bit_words(keys, of, bits).select(F.col("w").alias("__w"), F.col("b").alias("__b"))
    cell = F.shiftrightunsigned(key, 64 - bits)
    at = df.withColumn("__at", F.shiftright(cell, 6)).join(F.broadcast(words), F.col("__at") == F.col("__w"), "inner" if keep else "left")
    hit = F.coalesce(F.expr(f"shiftrightunsigned(__b, cast(shiftrightunsigned({key}, {64 - bits}) & 63 as int)) & 1"), F.lit(0)) == 1
    return at.where(hit if keep else ~hit).drop("__at", "__w", "__b")


def texts_by_hash(d: DataFrame, wanted: DataFrame) -> DataFrame:
    """(th, text) once for each wanted hash, and perhaps for a few others; ``d`` has text and th.

    A bit table drops nearly all other texts before anything is shuffled.
    """
    return may_be(d, "th", wanted, "th").groupBy("th").agg(F.min("text").alias("text"))


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "cc") -> DataFrame:
    """(node, root) for every node of an undirected edge list; root is the least node reachable.

    Alternating large-star and small-star rounds. A star round keeps every
    component connected, points each node at the least node known to it,
    and at the end each component is one star around its root. All steps
    are a grouped minimum (combined before the shuffle) and an equi-join.
    Rounds are few (logarithmic in practice); each is written to the shared
    folder, so neither plans nor recovery grow. A node with very many
    neighbours is only ever aggregated by minimum, never collected.
    """
    from linguaspark.session import materialize_with_metrics
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e, m = materialize_with_metrics(e, name, s=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), n=F.count(F.lit(1)))
    while m["n"]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        nxt, m2 = materialize_with_metrics(
            small.where("u <> v").distinct(), name,
            s=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), n=F.count(F.lit(1)))
        e, done, m = nxt, m2 == m, m2
        if done:
            break
    root = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return root.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


__all__ = ["BITS", "BYTE_VALUE", "Spans", "U64", "bit_table", "bit_words", "components", "hash_sample", "cut_lineage", "in_bits", "may_be", "mix",
           "pick", "returning", "shingle_hashes", "shingle_set", "text_bytes", "texts_by_hash", "with_text_hash", "word_bounds",
           "word_hashes"]
