"""Code usage: key extraction, substring search, context windows and summaries.

Code files are rows ``(file, content)``. Substring search (J10) is an
exact equi-join on grams: every needle is looked up by its rarest gram,
nearly as long as itself, candidates are verified with ``contains``. No
cross join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

# Key-call pattern, hook pattern and default file globs.
T_CALL_RE = "t\\(\\s*['\"]([^'\"]+)['\"]"
HOOK_RE = "const\\s*\\{\\s*t\\s*\\}\\s*=\\s*useTranslation\\(\\)"
KEY_SCAN_EXTENSIONS = ["js", "jsx", "ts", "tsx"]
KEY_SCAN_EXCLUDES = ["node_modules", "dist", "build"]
CONTEXT_EXTENSIONS = ["txt", "md", "html", "css", "js", "jsx", "ts", "tsx", "json", "xml", "yaml", "yml",
                      "vue", "svelte", "php", "rb", "py", "java", "c", "cpp", "cs", "go"]
CONTEXT_EXCLUDES = ["node_modules", "dist", "build", ".git", "vendor"]
CONTEXT_LINES = 2
MAX_CONTEXTS_PER_KEY = 3


def path_filter(path_col, extensions: list[str], excludes: list[str]):
    """include by extension, exclude any path with an excluded directory component."""
    ext = "\\.(" + "|".join(e.replace(".", "\\.") for e in extensions) + ")$"
    exc = "(^|/)(" + "|".join(x.replace(".", "\\.") for x in excludes) + ")/"
    c = F.col(path_col) if isinstance(path_col, str) else path_col
    return c.rlike(ext) & ~c.rlike(exc)


# ---------------------------------------------------------------------------
# P4/P5 key extraction with line numbers
# ---------------------------------------------------------------------------


# Stands before each call in the copy that is cut into lines. Neither it nor its stand-in can be part of the
# pattern's fixed letters, blanks or quotes, so swapping one for the other leaves every match where it is.
_MARK, _STAND_IN = "\u0001", "\u0002"


def extract_keys(files: DataFrame, only_hook_files: bool = False) -> DataFrame:
    """Every ``t('key')`` call: ``(key, file, line)``; one row per match.

    Matches are found on the whole text (the pattern may cross lines). A mark
    is put before each of them and the marked text is cut into lines: a line
    holding m marks is the line of the next m matches. One pass per text, in
    the scan task; no shuffle.
    """
    f = files
    if only_hook_files:
        f = f.where(F.col("content").rlike(HOOK_RE))
    marked = F.regexp_replace(F.translate("content", _MARK, _STAND_IN), T_CALL_RE, _MARK + "$0")
    m = f.select("file", F.split(marked, "\n", -1).alias("lines"),
                 F.regexp_extract_all("content", F.lit(T_CALL_RE), 1).alias("ks"))
    marks = lambda x: F.length(x) - F.length(F.replace(x, F.lit(_MARK), F.lit("")))
    nos = F.flatten(F.transform("lines", lambda x, i: F.array_repeat(i + 1, marks(x))))
    return (m.select("file", F.explode(F.arrays_zip("ks", nos.alias("nos"))).alias("m"))
            .select(F.col("m.ks").alias("key"), "file", F.col("m.nos").cast("int").alias("line")))


def file_lines(files: DataFrame) -> DataFrame:
    """``(file, line_no, line)``, 1-based, empty and trailing lines kept."""
    return files.select("file", F.posexplode(F.split("content", "\n", -1)).alias("pos", "line")).select(
        "file", (F.col("pos") + 1).cast("int").alias("line_no"), "line")


def lines_in_context(files: DataFrame, n: int = CONTEXT_LINES) -> DataFrame:
    """``(file, line_no, line, around)``: each line with the lines ``line_no-n .. line_no+n``, clipped to the file.

    ``around`` is a slice of the file's own line array, so a line's
    neighbours need no second scan and no join.
    """
    cut = files.select("file", F.split("content", "\n", -1).alias("lines"))
    rows = F.transform("lines", lambda x, i: F.struct(
        (i + 1).cast("int").alias("line_no"), x.alias("line"),
        F.slice("lines", F.greatest(i + 1 - n, F.lit(1)), F.least(i, F.lit(n)) + n + 1).alias("around")))
    return cut.select("file", F.inline(rows))


# ---------------------------------------------------------------------------
# J10 exact substring join
# ---------------------------------------------------------------------------


_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
LONGEST_GRAM = 38
CUT_BYTES = 1 << 20       # text hashed at once in a task
TABLE_BITS = 16           # bits a needle of the table that hay grams are probed in, two probes each
LONGEST_TABLE = 1 << 29   # bits; beyond it more grams pass in vain, none is lost


def _gram_sizes(q: int) -> list[int]:
    """Bytes of the grams: every length below ``q``, then each about a third longer than the one before."""
    sizes = list(range(1, q + 1))
    while sizes[-1] < LONGEST_GRAM:
        sizes.append(sizes[-1] + max(1, sizes[-1] // 3))
    return sizes


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def _hashed(codes: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(g, 64-bit hash of the g bytes from each place on) for the ascending sizes g; hashes of 2^k bytes make up all others."""
    powers = {1: codes.astype(np.uint64) + np.uint64(1)}
    for g in sizes:
        if len(codes) < g:
            return
        done, out = 0, None
        for k in (1 << i for i in range(g.bit_length())):
            if k not in powers:
                half = powers[k // 2]
                powers[k] = half[:len(half) - k // 2] * _power(k // 2) + half[k // 2:]
            if g & k:
                piece = powers[k][done:]
                out = piece if out is None else out[:len(piece)] * _power(k) + piece
                done += k
        h = out[:len(codes) - g + 1]
        h = (h ^ (h >> np.uint64(32))) * _MIX
        yield g, (h ^ (h >> np.uint64(29))) * _MIX ^ np.uint64(g)


def _cuts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``CUT_BYTES``: (number of the first, all their bytes, where each begins and the last ends)."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, ends, data = texts.buffers()
    at = np.frombuffer(ends, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    codes = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + CUT_BYTES, "right")) - 1)
        yield first, codes[at[first]:at[last]], at[first:last + 1] - at[first]
        first = last


def _grams_of(texts: pa.Array, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(g, number of the text, hash) of every gram of g bytes inside one text."""
    for first, codes, at in _cuts(texts):
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        left = at[1:][row] - np.arange(len(codes))
        for g, h in _hashed(codes, sizes):
            inside = np.flatnonzero(left[:len(h)] >= g)
            yield g, row[inside] + first, h[inside]


def _size_of(length: Column, sizes: list[int]) -> Column:
    return reduce(lambda c, g: F.when(length >= g, F.lit(g)).otherwise(c), sizes[1:], F.lit(sizes[0]))


def _lists(n: int, rows: list[np.ndarray], values: list[np.ndarray]) -> pa.Array:
    """For each of ``n`` rows the distinct values (64-bit hashes) found in it, as an Arrow list of bigints."""
    row, h = (np.concatenate([np.zeros(0, t), *x]) for t, x in ((np.int64, rows), (np.uint64, values)))
    order = np.lexsort((h, row))
    row, h = row[order], h[order].view(np.int64)
    if len(row):
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])
        row, h = row[new], h[new]
    ends = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(h))


def _needle_grams(nd: DataFrame, sizes: list[int]) -> DataFrame:
    """``(_n, _size, _gram)``: every needle with the gram it is looked up by, of the longest size that fits into it.

    Of its grams it is the one that the fewest needles hold, so that a place of the hay meets few needles. A needle
    of just a gram's length has no choice, and as needles are distinct it adds one at most to the count of a gram:
    only longer ones are counted. The counts are as many as the grams, so they are joined by shuffle, never broadcast
    (size estimates know nothing of the grams to a needle).
    """
    nd = nd.withColumn("_size", _size_of(F.octet_length("_n"), sizes))

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def grams(texts: pa.Array, size: pa.Array) -> pa.Array:
        want = size.to_numpy(zero_copy_only=False)
        found = [(row[own], h[own]) for g, row, h in _grams_of(texts, np.unique(want).tolist()) for own in [want[row] == g]]
        return _lists(len(texts), [row for row, _ in found], [h for _, h in found])

    every = lambda df: df.select("*", F.explode(grams("_n", "_size")).alias("_gram"))
    choice = every(nd.where(F.octet_length("_n") > F.col("_size")))
    held = choice.groupBy("_gram").agg(F.count(F.lit(1)).alias("_c"))
    # the count, ties by half the gram, in one bigint: buffers of plain numbers are aggregated by hash
    rank = F.shiftleft(F.least("_c", F.lit(1 << 30)), 32) + F.col("_gram").bitwiseAND(0xFFFFFFFF)
    chosen = choice.join(held.hint("shuffle_hash"), "_gram").groupBy("_n", "_size").agg(F.min_by("_gram", rank).alias("_gram"))
    return every(nd.where(F.octet_length("_n") == F.col("_size"))).unionByName(chosen)


def _places(h, bits: int) -> tuple:
    """The two bits of a gram (numpy hashes) in a table of ``bits`` bits."""
    mask = np.uint64(bits - 1)
    return h & mask, (h >> np.uint64(32)) & mask


def _bit_table(grams: DataFrame, n: int) -> np.ndarray:
    """Both bits of every gram, as bytes of eight bits each; Spark builds it in pieces of 4 KB."""
    bits = min(LONGEST_TABLE, max(1 << 15, 1 << (n * TABLE_BITS - 1).bit_length()))
    mask = F.lit(bits - 1)
    at = grams.select(F.explode(F.array(F.col("_gram").bitwiseAND(mask), F.shiftrightunsigned("_gram", 32).bitwiseAND(mask))).alias("b"))
    pieces = at.groupBy(F.bitmap_bucket_number(F.col("b") + 1).alias("piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("b") + 1)).alias("set"))
    table = np.zeros(bits // 8, np.uint8)
    for r in pieces.collect():  # at most LONGEST_TABLE bits
        part = np.frombuffer(bytes(r["set"]), np.uint8)
        table[(r["piece"] - 1) * len(part):][:len(part)] = part
    return table


def _hits(hay: DataFrame, hay_col: str, grams: DataFrame, n: int, sizes: list[int]) -> DataFrame:
    """The hay rows once per gram in them that is in the table of the needles' grams, with it as ``_gram``.

    Python sees the searched text alone; the other columns stay in the JVM.
    """
    table = hay.sparkSession.sparkContext.broadcast(_bit_table(grams, n))

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def probe(texts: pa.Array) -> pa.Array:
        bits, rows, hashes = table.value, [], []

        def passing(h, at, probed):
            place = _places(h, len(bits) * 8)[probed]
            ok = np.flatnonzero(bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
            return h[ok], ok if at is None else at[ok]

        for first, codes, ends in _cuts(texts):
            for g, h in _hashed(codes, sizes):
                h, at = passing(*passing(h, None, 0), 1)
                row = np.searchsorted(ends, at, "right") - 1
                inside = at + g <= ends[row + 1]
                rows.append(row[inside] + first)
                hashes.append(h[inside])
        return _lists(len(texts), rows, hashes)

    return hay.select("*", F.explode(probe(hay_col)).alias("_gram"))


def spread(hay: DataFrame) -> DataFrame:
    """``hay`` over one task per core at least, where its estimated size makes fewer input splits than that.

    The estimate comes from the plan's statistics; no job runs.
    """
    spark = hay.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(hay._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return hay.repartition(cores) if size < cores * split else hay


def substring_join(needles: DataFrame, hay: DataFrame, needle_col: str = "needle",
                   hay_col: str = "text", q: int = 3, broadcast_rows: int = 100_000,
                   broadcast_bytes: int = 8 << 20) -> DataFrame:
    """All (needle row, hay row) pairs with ``contains(hay, needle)``, exactly.

    Every needle is looked up by one of its grams: a needle shorter than
    ``q`` bytes by itself, a longer one by a gram of at least three quarters
    of its length (up to ``LONGEST_GRAM``), the one fewest needles hold.
    Candidates are verified with ``contains``; empty needles are dropped.

    The needles and their grams are written once, as the same table serves
    all below. Needles of the gram sizes with the fewest needles, together up
    to ``broadcast_rows`` and ``broadcast_bytes``, are broadcast and joined
    where the hay lies; the hits of all others are joined by their grams. So
    the hay is gone through twice at most, however many needles there are. A
    bit table of the needles' grams keeps hay rows without a hit out of the
    join. Other columns of the needle rows join the verified pairs.
    """
    sizes = _gram_sizes(q)
    nd = needles.select(F.col(needle_col).alias("_n")).where(F.length("_n") > 0).distinct()
    grams = cut_lineage(_needle_grams(nd, sizes), "needle-grams")
    stats = grams.groupBy("_size").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("_n")).alias("bytes")).collect()  # a row a size
    small, large, n, size = [], [], 0, 0
    for r in sorted(stats, key=lambda r: (r["n"], r["_size"])):
        n, size = n + r["n"], size + r["bytes"]
        (small if n <= broadcast_rows and size <= broadcast_bytes else large).append(r)

    def found(group, hint):
        of = sorted(r["_size"] for r in group)
        own = grams.where(F.col("_size").isin(of)).select("_n", "_gram")
        return (_hits(hay, hay_col, own, sum(r["n"] for r in group), of).join(hint(own), "_gram")
                .where(F.col(hay_col).contains(F.col("_n"))).drop("_gram"))

    passes = [found(g, hint) for g, hint in ((small, F.broadcast), (large, lambda df: df.hint("merge"))) if g]
    pairs = reduce(DataFrame.unionByName, passes) if passes else hay.where(F.lit(False)).withColumn("_n", F.lit(""))
    nrows = needles.withColumnRenamed(needle_col, "_n")
    if len(nrows.columns) > 1:
        pairs = pairs.join(nrows, "_n")
    return pairs.withColumnRenamed("_n", needle_col)


# ---------------------------------------------------------------------------
# J10 + P8 usage contexts, W2 top-n, P9 text, A3 stats, J13 status
# ---------------------------------------------------------------------------


def key_usages(keys: DataFrame, files: DataFrame, q: int = 3) -> DataFrame:
    """F7 + J10: ``(key, file, line_no)`` for every line containing the key (once per line)."""
    lines = file_lines(spread(files))
    return substring_join(keys.select("key").distinct(), lines, needle_col="key", hay_col="line", q=q).select(
        "key", "file", "line_no")


def key_contexts(keys: DataFrame, files: DataFrame, n: int = CONTEXT_LINES, q: int = 3) -> DataFrame:
    """``(key, file, line_no, context)`` for every usage of every key.

    The context is the lines ``line_no-n .. line_no+n`` of the file, clipped,
    joined by newlines. Each line carries its context into the substring
    join, so the usages need no second look at the files.
    """
    lines = lines_in_context(spread(files), n).select("file", "line_no", "line", F.array_join("around", "\n").alias("context"))
    found = substring_join(keys.select("key").distinct(), lines, needle_col="key", hay_col="line", q=q)
    return found.select("key", "file", "line_no", "context")


def first_contexts(contexts: DataFrame, k: int = MAX_CONTEXTS_PER_KEY) -> DataFrame:
    """The first k contexts per key by (file, line_no); planned as a partial window group limit."""
    w = Window.partitionBy("key").orderBy("file", "line_no")
    return contexts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def contexts_per_key(keys: DataFrame, contexts: DataFrame) -> DataFrame:
    """Every asked key with all its contexts; keys without usage keep one row with null file.

    Long form ``(key, file, line_no, context)``: a key's full list can be
    as large as its usages, so it is never gathered into one row.
    """
    return keys.select("key").distinct().join(contexts, "key", "left").select("key", "file", "line_no", "context")


# Context text layout.
_KEY_USED = 'Key "{}" is used in:\n'
_KEY_UNUSED = 'Key "{}" - no usage context found'


def context_text(keys: DataFrame, contexts: DataFrame, k: int = MAX_CONTEXTS_PER_KEY) -> DataFrame:
    """Per key, its description block (first k usages, inner lines indented by 2)."""
    top = first_contexts(contexts, k)
    item = F.concat(F.lit("- "), F.col("file"), F.lit(":"), F.col("line_no").cast("string"), F.lit("\n  "),
                    F.replace(F.col("context"), F.lit("\n"), F.lit("\n  ")))
    blocks = (top.groupBy("key")
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("t")))),
                                            lambda x: x["t"]), "\n").alias("_b")))
    kk = keys.select("key").distinct()
    return kk.join(blocks, "key", "left").select(
        "key", F.when(F.col("_b").isNull(), F.concat(F.lit('Key "'), F.col("key"), F.lit('" - no usage context found')))
        .otherwise(F.concat(F.lit('Key "'), F.col("key"), F.lit('" is used in:\n'), F.col("_b"))).alias("text"))


def combine_context(manual, extracted):
    """P10: manual context, a blank line, then 'Context from codebase:' and the extracted text."""
    m = F.coalesce(manual if not isinstance(manual, str) else F.col(manual), F.lit(""))
    x = F.coalesce(extracted if not isinstance(extracted, str) else F.col(extracted), F.lit(""))
    code = F.when(x == "", F.lit("")).otherwise(F.concat(F.lit("Context from codebase:\n"), x))
    return F.when((m != "") & (x != ""), F.concat(m, F.lit("\n\n"), code)).otherwise(F.concat(m, code))


def context_stats(keys: DataFrame, contexts: DataFrame) -> DataFrame:
    """A3: contexts found, keys with at least one, keys asked."""
    kk = keys.select("key").distinct()
    per = contexts.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    j = kk.join(per, "key", "left")
    return j.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("n_contexts"),
                 F.count_if(F.col("c") > 0).alias("n_keys_with_context"),
                 F.count(F.lit(1)).alias("n_keys"))


def usage_status(usages: DataFrame, catalog_keys: DataFrame) -> DataFrame:
    """Key status — used (in code and catalog), unused (catalog only), undefined (code only)."""
    u = usages.groupBy("key").agg(F.count(F.lit(1)).alias("n_usages"))
    c = catalog_keys.select("key").distinct().withColumn("_in_catalog", F.lit(True))
    j = u.join(c, "key", "full_outer")
    return j.select("key", F.coalesce("n_usages", F.lit(0)).cast("bigint").alias("n_usages"),
                    F.when(F.col("_in_catalog").isNull(), "undefined")
                    .when(F.col("n_usages").isNull(), "unused").otherwise("used").alias("status"))
