"""n-gram Jaccard self-join with token-combination prefixes.

Documents are sets of k-word shingles (64-bit hashes). Two documents link
when their Jaccard similarity reaches a threshold t. The tokens of a set are
put in one global order: rare ones first, frequent ones last, each by hash.

* Rare classes: a similar pair shares a token among the first
  n - ceil(t n) + 1 tokens of each set. The rare tokens of that prefix are
  indexed singly.
* Frequent classes: if a similar pair shares no rare token, all it shares is
  frequent. At most d = floor(n (1-t)/t) tokens are in one set only, so among
  the first 2d + 2 tokens of the union at least d + 2 are shared, and two of
  them stand side by side in both sets. So in the extended prefix of 2d + 2
  tokens each two neighbouring frequent tokens are indexed as a combination.

Both together lose no pair, whichever tokens count as frequent; which do is
counted over all documents (see ``frequent_tokens``).

Keys are joined in two rounds. First every set meets the least-ranked set
of each of its keys only, a number of pairs in proportion to the keys,
however hot a key is; the verified links form components. Then the pairs
under a key whose members still belong to different components are formed
and verified, so no link between different components is lost. Equal sets
are one node from the start.

Defined cases: null or empty texts (or white space only) have empty sets and
link with nothing; with fewer than k words the whole sequence is the one
shingle; repeated rows and ids are nodes of one set and share a component;
a component's id is the least non-null id in it; an empty table gives no
rows; other columns are not read. 64-bit set and shingle hashes stand for
the texts: the chance that any two of a billion different sets collide is
about one in forty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linguaspark.llm.common import (U64, bit_table, components, cut_lineage, in_bits, may_be,
                                    mix, pick, returning, shingle_set, with_text_hash)

FREQUENT = 64      # documents from which a token counts as frequent
LOCAL_LEAST = 4    # occurrences within one chunk of a task below which a token is not reported
CHUNK = 1_000_000  # tokens counted at once
CROWDED = 512      # sets from which a single key is found to be frequent after all
ROUNDS = 4         # passes at most over the texts to move such tokens to the end of the order


def set_id(s: np.ndarray) -> int:
    """A hash of a whole set, as a signed 64-bit integer (0 for the empty set)."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        h = mix(np.array([mix(s ^ U64(0x5851F42D4C957F2D)).sum() + U64(len(s))], U64))
    return int(h.view(np.int64)[0])


def set_table(d: DataFrame, k: int) -> DataFrame:
    """One pass over the texts, written: a row per document (id, th, n, sid) and, apart, locally repeated tokens.

    ``th`` is a hash of the text, ``sid`` of its shingle set. Token rows
    (``th`` null) hold a token in ``sid`` and its count in ``n``.
    """
    @returning
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        size = 0

        def repeated() -> pd.DataFrame:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            tokens, n = tokens[n >= LOCAL_LEAST], n[n >= LOCAL_LEAST]
            return pd.DataFrame({"id": pd.array([None] * len(n), "Int64"), "th": pd.array([None] * len(n), "Int64"),
                                 "n": n, "sid": tokens.view(np.int64)})

        for b in batches:
            ns, sids = [], []
            for t in b["text"]:
                s = shingle_set(t, k)
                ns.append(len(s))
                sids.append(set_id(s))
                held.append(s)
                size += len(s)
                if size >= CHUNK:
                    yield repeated()
                    held, size = [], 0
            yield pd.DataFrame({"id": pd.array(b["id"], "Int64"), "th": pd.array(b["th"], "Int64"), "n": ns, "sid": sids})
        if held:
            yield repeated()

    src = d.select("id", F.coalesce("th", F.lit(0)).alias("th"), "text")
    return cut_lineage(src.mapInPandas(sets, "id long, th long, n long, sid long"), "ngram-sets")


def frequent_tokens(table: DataFrame, least: int = FREQUENT) -> DataFrame:
    """The tokens (sid) that are seen to occur in about ``least`` documents or more.

    Tasks report only tokens repeated within them. Tokens spread thinly are
    found later, by the number of sets under their key; which tokens count
    as frequent decides efficiency, not results.
    """
    return (table.where("th is null").groupBy("sid").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("sid"))


def prefix_keys(s: np.ndarray, frequent: np.ndarray, num: int, den: int) -> tuple[np.ndarray, ...]:
    """(key, rank, lead, is a combination) of one set, see the module text.

    ``lead`` counts the tokens that a pair first met at this key cannot
    share: those before a single, all rare ones for a combination.
    """
    n = len(s)
    rare, often = s[~frequent], s[frequent]
    p1 = n - -(-num * n // den) + 1
    p2 = min(n, 2 * (n * (den - num) // num) + 2)
    singles = rare[:p1]
    m = max(0, p2 - len(rare))
    o = often[:m]
    both = mix((o[:-1] * U64(0x9E3779B97F4A7C15)) ^ (o[1:] + U64(0x632BE59BD9B4E019))) if len(o) > 1 else np.empty(0, U64)
    rank = np.concatenate((np.arange(len(singles)), len(rare) + np.arange(len(both))))
    combo = np.zeros(len(rank), bool)
    combo[len(singles):] = True
    return np.concatenate((singles, both)), rank, np.where(combo, len(rare), rank), combo


def key_table(d: DataFrame, bits, k: int, num: int, den: int) -> DataFrame:
    """Second pass over the texts, written: the prefix keys (key, rank, lead, combo, n, sid) of every set."""
    @returning
    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            seen: set[int] = set()
            for t in b["text"]:
                s = shingle_set(t, k)
                sid = set_id(s)
                if not len(s) or sid in seen:
                    continue
                seen.add(sid)
                key, rank, lead, combo = prefix_keys(s, in_bits(bits.value, s), num, den)
                out.append((key, rank, lead, combo, np.full(len(key), len(s)), np.full(len(key), sid)))
            if out:
                key, rank, lead, combo, n, sid = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pd.DataFrame({"key": key.view(np.int64), "rank": rank.astype(np.int32),
                                    "lead": lead.astype(np.int32), "combo": combo,
                                    "n": n.astype(np.int32), "sid": sid})

    return cut_lineage(d.select("text").mapInPandas(keys, "key long, rank int, lead int, combo boolean, n int, sid long"), "ngram-keys")


def may_link(a: str, b: str, num: int, den: int) -> Column:
    """Size and position filters for two members of a key.

    At the key where a similar pair meets first (a rare token, or any
    combination if it shares no rare token) the overlap is at most what
    follows the ``lead`` in either set; a pair need only pass there. Ranks
    of a shared combination differ by unshared tokens only.
    """
    na, nb, ra, rb, la, lb = (F.col(f"{x}.{c}").cast("long") for c in ("n", "rank", "lead") for x in (a, b))
    sizes = den * F.least(na, nb) >= num * F.greatest(na, nb)
    after = (num + den) * F.least(na - la, nb - lb) >= num * (na + nb)
    close = num * F.abs(ra - rb) <= (den - num) * F.least(na, nb)
    return sizes & after & (close | ~F.col(f"{a}.combo"))


def sketch(s: np.ndarray) -> bytes:
    """A bitmap of a set: the leading bits of its hashes, about two bits of room for each."""
    bits = max(6, int(2 * len(s) - 1).bit_length())
    out = np.zeros(1 << bits, bool)
    out[(s >> U64(64 - bits)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def most_shared(na: int, a: bytes, nb: int, b: bytes) -> int:
    """An upper bound of the common tokens of two sets from their sketches: a bit in one only is a token in one only."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    x, y = np.unpackbits(x).view(bool), np.unpackbits(y).view(bool)
    size = min(len(x), len(y))  # both lengths are powers of two: fold the finer one
    x, y = x.reshape(size, -1).any(1), y.reshape(size, -1).any(1)
    both = np.count_nonzero(x & y)
    return min(na - (np.count_nonzero(x) - both), nb - (np.count_nonzero(y) - both))


def set_vectors(d: DataFrame, table: DataFrame, pairs: DataFrame, k: int, of) -> DataFrame:
    """(sid, n, data) for the sets of the pairs, written; data is ``of`` a set's sorted hashes.

    A set is read from one text that has it, where the text lies: a bit table
    of text hashes drops nearly all other texts, and only data is shuffled.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    chosen = cut_lineage(table.where("th is not null").join(ends, "sid", "left_semi")
                         .groupBy("sid").agg(F.min("th").alias("th")), "ngram-wanted")

    @returning
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ss = [shingle_set(t, k) for t in b["text"]]
            yield pd.DataFrame({"sid": [set_id(s) for s in ss], "n": [len(s) for s in ss], "data": [of(s) for s in ss]})

    found = may_be(d, "th", chosen, "th").select("text").mapInPandas(sets, "sid long, n long, data binary")
    return cut_lineage(found.groupBy("sid").agg(F.min("n").alias("n"), F.min("data").alias("data")), "ngram-vectors")


def verified(pairs: DataFrame, d: DataFrame, table: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold exactly; pairs that the sketches rule out never meet as sets."""
    def reaches(both: int, na: int, nb: int) -> bool:
        return den * both >= num * (na + nb - both)

    @F.pandas_udf("boolean")
    def possible(na: pd.Series, a: pd.Series, nb: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([reaches(most_shared(m, x, n, y), m, n) for m, x, n, y in zip(na, a, nb, b, strict=True)], dtype=bool)

    @F.pandas_udf("boolean")
    def similar(na: pd.Series, a: pd.Series, nb: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a), bool)
        for i, (m, x, n, y) in enumerate(zip(na, a, nb, b, strict=True)):
            both = np.intersect1d(np.frombuffer(x, U64), np.frombuffer(y, U64), assume_unique=True)
            out[i] = reaches(len(both), m, n)
        return pd.Series(out)

    def meet(pairs: DataFrame, vectors: DataFrame, test) -> DataFrame:
        for x in ("b", "a"):
            pairs = pairs.join(vectors.select(F.col("sid").alias(x), F.col("n").alias("n" + x), F.col("data").alias("d" + x)), x)
        return pairs.where(test("na", "da", "nb", "db")).select("a", "b")

    near = cut_lineage(meet(pairs, set_vectors(d, table, pairs, k, sketch), possible), "ngram-possible")
    return meet(near, set_vectors(d, table, near, k, lambda s: s.tobytes()), similar)


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def join(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """A row per document: id, n_shingles, group (its component, null for empty sets), th (hash of its text),
    component (the least id reachable by links, its own included).

    Links: den * |intersection| >= num * |union| of the k-word shingle sets;
    num / den must be 0.7 or more. Documents with empty sets are components
    of their own.
    """
    if not 10 * num >= 7 * den or num > den:
        raise ValueError("the threshold must be between 0.7 and 1")
    spark = docs.sparkSession
    d = with_text_hash(pick(docs, id=id, text=text))
    table = set_table(d, k)
    rows = table.where("th is not null")
    tokens = frequent_tokens(table)
    for turn in range(ROUNDS):
        keys = key_table(d, bit_table(spark, tokens, "sid"), k, num, den)
        # keys that two different sets have
        shared = cut_lineage(keys.groupBy("key", "combo").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi"),
                                                              F.count(F.lit(1)).alias("n")).where("lo <> hi"), "ngram-shared")
        crowded = shared.where(~F.col("combo") & (F.col("n") > CROWDED)).select(F.col("key").alias("sid"))
        if turn == ROUNDS - 1 or crowded.isEmpty():
            break
        tokens = tokens.union(crowded)
    shared = shared.select("key").distinct()

    # a bit table drops nearly all other keys in the scan
    met = cut_lineage(may_be(keys, "key", shared, "key").join(shared, "key", "left_semi").distinct(), "ngram-met")
    stars = met.groupBy("key").agg(F.min(F.struct("lead", "rank", "n", "sid", "combo")).alias("star"))

    # round one: each set with the first set of each of its keys
    first = (met.join(stars, "key").where("sid <> star.sid").select("star", "sid", F.struct("lead", "rank", "n", "sid", "combo").alias("own"))
             .where(may_link("own", "star", num, den))
             .select(*_ordered(F.col("sid"), F.col("star.sid"))).distinct())
    first = cut_lineage(first, "ngram-pairs")
    links = cut_lineage(verified(first, d, table, k, num, den), "ngram-links")
    groups = cut_lineage(components(links, name="ngram-components"), "ngram-components")

    # round two: pairs under one key whose components still differ
    at = (met.join(groups.withColumnRenamed("node", "sid"), "sid", "left")
          .withColumn("root", F.coalesce("root", "sid")))
    at = cut_lineage(at, "ngram-at")
    torn = at.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    at = at.join(torn, "key", "left_semi")
    rest = (at.alias("x").join(at.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.root") < F.col("y.root"))
                               & may_link("x", "y", num, den))
            .select(*_ordered(F.col("x.sid"), F.col("y.sid"))).distinct().join(first, ["a", "b"], "left_anti"))
    rest = cut_lineage(rest, "ngram-pairs")
    more = cut_lineage(verified(rest, d, table, k, num, den), "ngram-links")
    if not more.isEmpty():
        groups = cut_lineage(components(links.union(more), name="ngram-components"), "ngram-components")

    # sets -> components -> documents
    least = rows.where("n > 0").groupBy("sid").agg(F.min("id").alias("least"))
    node = (least.join(groups.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid")))
    node = cut_lineage(node, "ngram-nodes")
    of = node.groupBy("root").agg(F.min("least").alias("component"))
    where = node.join(of, "root").select("sid", "root", "component")
    out = rows.join(where, "sid", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.col("root").alias("group"), "th",
                      F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each component: the least id (null ids last), then the least text hash.

    Documents with empty sets all stay; rows equal in id and text are one
    document. Only documents of components with several members are
    shuffled; a bit table lets the others pass in the scan.
    """
    rows = cut_lineage(join(docs, id, text, k, num, den), "ngram-rows").where("group is not null")
    place = F.struct(F.col("id").isNull().alias("u"), "id", "th")
    best = rows.groupBy("group").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("best")).where("c > 1")
    members = (rows.join(best.select("group", "best"), "group")
               .groupBy(F.xxhash64("id", "th").alias("hk")).agg(F.max(place == F.col("best")).alias("stays")))
    members = cut_lineage(members, "ngram-members")
    keyed = docs.withColumn("__hk", F.when(F.col(text).isNotNull(), F.xxhash64(F.col(id).cast("long"), F.xxhash64(text))))
    apart = may_be(keyed, "__hk", members, "hk", keep=False).drop("__hk")
    met = (may_be(keyed, "__hk", members, "hk")
           .join(members.withColumnRenamed("hk", "__hk").withColumnRenamed("stays", "__stays"), "__hk", "left"))
    lone = met.where("__stays is null").drop("__hk", "__stays")
    chosen = met.where("__stays").dropDuplicates(["__hk"]).drop("__hk", "__stays")
    return apart.unionByName(lone).unionByName(chosen)
