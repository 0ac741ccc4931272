"""Translation memory (TM): rows, keyed writes, pairing, embeddings and k-nearest search.

TM rows: ``(id, source_text, translation, lang, context, embedding, seq)``,
stored partitioned by ``lang``. k-NN search (J11) is exact: query and
memory rows of a language are cut into blocks of bounded size, every
(query block, memory block) pair is scored in one numpy matrix product
inside ``cogroup().applyInPandas``, each block pair keeps only its local
top-k (ties kept), and a final per-query top-k picks the result. No row
pairs are materialised.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import base64_utf8, falsy, half_up_round
from ..schemas import ENTRY_KEYS
from .catalog import last_wins

# Fixed value: context stored when none is given.
UNKNOWN_CONTEXT = "unknown"


def tm_id(lang, source_text):
    """``lang + '_' + base64(utf8(source))`` without line breaks."""
    lang = F.col(lang) if isinstance(lang, str) else lang
    return F.concat(lang, F.lit("_"), base64_utf8(source_text))


def default_context(*candidates):
    """The first non-empty candidate, else 'unknown'."""
    cols = [F.when(~falsy(c), F.col(c) if isinstance(c, str) else c) for c in candidates]
    return F.coalesce(*cols, F.lit(UNKNOWN_CONTEXT))


def paired_entries(source: DataFrame, target: DataFrame, langs: list[str] | None = None) -> DataFrame:
    """For each source row whose key has a target: the key's last source and last target text."""
    from .catalog import with_target_langs
    src = with_target_langs(source, target, langs)
    s_last = last_wins(src.select(*ENTRY_KEYS, "value", "ord")).select(
        *ENTRY_KEYS, F.col("value").alias("source_text"))
    t_last = last_wins(target.select(*ENTRY_KEYS, "value", "ord")).select(
        *ENTRY_KEYS, F.col("value").alias("translation"))
    return src.select(*ENTRY_KEYS, "ord").join(s_last, ENTRY_KEYS).join(t_last, ENTRY_KEYS)


def tm_rows(pairs: DataFrame, context: str | None = None, seq: str | None = None) -> DataFrame:
    """TM rows from ``(lang, source_text, translation[, context])`` pairs."""
    ctx_cands = ([F.lit(context)] if context else []) + (["context"] if "context" in pairs.columns else [])
    out = pairs.select(tm_id("lang", F.col("source_text")).alias("id"), "source_text", "translation", "lang",
                       default_context(*ctx_cands).alias("context"),
                       *([F.col("embedding")] if "embedding" in pairs.columns else
                         [F.lit(None).cast("array<float>").alias("embedding")]),
                       (F.col(seq) if seq else F.lit(0)).cast("bigint").alias("seq"))
    return out


def upsert_latest(rows: DataFrame) -> DataFrame:
    """One row per id, the latest write (highest seq) wins; partial aggregation."""
    return last_wins(rows, keys=["id"], order="seq")


def keep_first(rows: DataFrame) -> DataFrame:
    """One row per id, the first write wins."""
    rest = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.min_by(F.struct(*rest), "seq").alias("_f")).select("id", "_f.*")


def inconsistent_translations(rows: DataFrame) -> DataFrame:
    """D3: source texts with more than one distinct translation within a language."""
    return (rows.groupBy("lang", "source_text")
            .agg(F.count_distinct("translation").alias("n_translations"))
            .where(F.col("n_translations") > 1))


# ---------------------------------------------------------------------------
# M3 embeddings
# ---------------------------------------------------------------------------


class HashingEmbedder:
    """Deterministic character-trigram feature hashing; a stand-in embedding model.

    A trigram of code points a, b, c of the text between two spaces counts
    at place h % dim, h = 961 a + 31 b + c, upwards if h / dim is even, else
    downwards. Any picklable callable ``f(list[str]) -> np.ndarray[n, dim]``
    can be used instead; the query side and the memory side must use the
    same one.
    """

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        padded = [f" {t or ''} " for t in texts]
        c = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        row = np.repeat(np.arange(len(texts)), [len(p) for p in padded])
        if len(c) < 3:
            return np.zeros((len(texts), self.dim), np.float32)
        h = 961 * c[:-2] + 31 * c[1:-1] + c[2:]
        inside = row[:-2] == row[2:]
        h, row = h[inside], row[:-2][inside]
        sign = 1.0 - 2.0 * (h // self.dim % 2)
        return np.bincount(row * self.dim + h % self.dim, sign, len(texts) * self.dim).reshape(len(texts), self.dim).astype(np.float32)


def embed(df: DataFrame, text_col: str, embedder=None, out: str = "embedding") -> DataFrame:
    """M3: add an ``array<float>`` embedding via an iterator pandas UDF (model built once per task)."""
    emb = embedder or HashingEmbedder()

    @F.pandas_udf("array<float>")
    def _embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            m = emb(s.fillna("").tolist())
            yield pd.Series(list(np.asarray(m, dtype=np.float32)))

    return df.withColumn(out, _embed(F.col(text_col)))


# ---------------------------------------------------------------------------
# J11 exact k-nearest neighbours (cosine), W3 top-k, O1, P16/P17
# ---------------------------------------------------------------------------


SCORES = 1 << 21  # similarities held at once in a task


def _top_block(k: int, exclude_self: bool):
    def score(qdf: pd.DataFrame, mdf: pd.DataFrame) -> pd.DataFrame:
        cols = ["part", "query_id", "hit_id", "similarity"]
        if qdf.empty or mdf.empty:
            return pd.DataFrame({c: [] for c in cols})
        M = np.stack(mdf["vec"].to_numpy()).astype(np.float64)
        top = pd.concat(_batch_topk(qdf["qid"].to_numpy(), np.stack(qdf["vec"].to_numpy()), mdf["mid"].to_numpy(), M, k, exclude_self))
        return top.assign(part=qdf["part"].iloc[0])[cols]
    return score


def _batch_topk(qids, Q, mids, M, k: int, exclude_self: bool) -> Iterator[pd.DataFrame]:
    """Top-k of every query over one memory batch, for so many queries at a time that ``SCORES`` holds their scores."""
    mn = np.linalg.norm(M, axis=1)
    some = max(1, SCORES // len(M))
    for at in range(0, len(Q), some):
        yield _some_topk(qids[at:at + some], Q[at:at + some].astype(np.float64), mids, M, mn, k, exclude_self)


def _some_topk(qids, Q, mids, M, mn, k: int, exclude_self: bool) -> pd.DataFrame:
    with np.errstate(divide="ignore", invalid="ignore"):
        S = (Q @ M.T) / np.outer(np.linalg.norm(Q, axis=1), mn)
    S = np.nan_to_num(S, copy=False, nan=0.0)
    if exclude_self:
        S[qids[:, None] == mids[None, :]] = -np.inf
    kk = min(k, S.shape[1])
    kth = np.partition(S, -kk, axis=1)[:, -kk]
    r, c = np.nonzero((S >= kth[:, None]) & np.isfinite(S))
    out = pd.DataFrame({"query_id": qids[r], "hit_id": mids[c], "similarity": S[r, c]})
    return out.sort_values(["query_id", "similarity", "hit_id"], ascending=[True, False, True]).groupby(
        "query_id", sort=False).head(k)


def knn(queries: DataFrame, memory: DataFrame, k: int, part_col: str = "lang",
        query_id: str = "query_id", memory_id: str = "id", vec_col: str = "embedding",
        block: int = 4096, exclude_self: bool = False, broadcast_rows: int = 200_000) -> DataFrame:
    """For each query the k most similar memory rows of the same ``part_col``.

    Output ``(part, query_id, rank, hit_id, similarity)``; similarity is
    cosine, rounded to 6 places after ranking, ties broken by hit id. Rows
    without a vector on either side are no hit and have none.

    Two exact plans:

    * the query set has at most ``broadcast_rows`` rows (checked with one
      bounded count): it is broadcast and the memory is scanned in place, no
      shuffle of memory rows; each task keeps a local top-k per query;
    * otherwise queries and memory are cut into hash blocks of about
      ``block`` rows per language and every (query block, memory block) pair
      is scored in ``cogroup().applyInPandas``.

    Either way a final ``row_number() <= k`` (a partial window group limit)
    picks the result from at most (tasks x k) candidates per query.
    """
    q = queries.select(F.col(part_col).cast("string").alias("part"), F.col(query_id).alias("qid"),
                       F.col(vec_col).alias("vec"))
    m = memory.select(F.col(part_col).cast("string").alias("part"), F.col(memory_id).alias("mid"),
                      F.col(vec_col).alias("vec"))
    qid_t = dict(queries.select(query_id).dtypes)[query_id]
    mid_t = dict(memory.select(memory_id).dtypes)[memory_id]
    q, m = q.where("vec is not null"), m.where("vec is not null")
    schema = f"part string, query_id {qid_t}, hit_id {mid_t}, similarity double"
    if q.limit(broadcast_rows + 1).count() <= broadcast_rows:
        cand = _knn_broadcast(q.toPandas(), m, k, exclude_self, schema)
    else:
        cand = _knn_blocks(q, m, k, exclude_self, schema, block)
    w = Window.partitionBy("part", "query_id").orderBy(F.desc("similarity"), F.asc("hit_id"))
    return (cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("part", "query_id", "rank", "hit_id", F.round("similarity", 6).alias("similarity")))


def _knn_broadcast(local: pd.DataFrame, m: DataFrame, k: int, exclude_self: bool, schema: str) -> DataFrame:
    spark = m.sparkSession
    payload = {}
    for part, g in local.groupby("part"):
        payload[part] = (g["qid"].to_numpy(), np.stack(g["vec"].to_numpy()))
    bc = spark.sparkContext.broadcast(payload)

    def run(batches):
        qs = bc.value
        for pdf in batches:
            for part, g in pdf.groupby("part"):
                if part not in qs or g.empty:
                    continue
                M = np.stack(g["vec"].to_numpy()).astype(np.float64)
                for top in _batch_topk(*qs[part], g["mid"].to_numpy(), M, k, exclude_self):
                    yield top.assign(part=part)[["part", "query_id", "hit_id", "similarity"]]

    return m.mapInPandas(run, schema)


def _knn_blocks(q: DataFrame, m: DataFrame, k: int, exclude_self: bool, schema: str, block: int) -> DataFrame:
    nq = q.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / block).alias("nqb"))
    nm = m.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / block).alias("nmb"))
    nb = nq.join(nm, "part")
    qb = (q.join(nb, "part")
          .withColumn("qb", F.pmod(F.xxhash64("qid"), F.col("nqb")))
          .withColumn("mb", F.explode(F.sequence(F.lit(0), F.col("nmb") - 1))))
    mb = (m.join(nb, "part")
          .withColumn("mb", F.pmod(F.xxhash64("mid"), F.col("nmb")))
          .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("nqb") - 1))))
    keys = ["part", "qb", "mb"]
    return (qb.select(*keys, "qid", "vec").groupBy(*keys)
            .cogroup(mb.select(*keys, "mid", "vec").groupBy(*keys))
            .applyInPandas(_top_block(k, exclude_self), schema))


def similarity_percent(col):
    """Similarity as a whole percent, halves rounded up."""
    return half_up_round(F.col(col) * 100).cast("int")


def search_top(queries: DataFrame, memory: DataFrame, k: int = 5, **kw) -> DataFrame:
    """O1: the best k hits per query with their percent score."""
    return knn(queries, memory, k, **kw).withColumn("percent", similarity_percent("similarity"))


def attach_similar(entries: DataFrame, hits: DataFrame, memory: DataFrame, k: int = 3,
                   entry_id: str = "query_id", memory_id: str = "id") -> DataFrame:
    """M6: an array<struct<source, translation, similarity>> per entry (empty when none)."""
    h = (hits.join(memory.select(F.col(memory_id).alias("hit_id"), "source_text", "translation"), "hit_id")
         .groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(
             "rank", F.col("source_text").alias("source"), "translation", "similarity"))),
             lambda x: F.struct(x["source"].alias("source"), x["translation"].alias("translation"),
                                x["similarity"].alias("similarity"))).alias("similar")))
    j = entries.join(h.withColumnRenamed("query_id", entry_id), entry_id, "left")
    return j.withColumn("similar", F.coalesce("similar", F.array().cast(
        "array<struct<source:string,translation:string,similarity:double>>")))


def block_count(n: int, block: int) -> int:
    return max(1, math.ceil(n / block))
