"""Registered translation-memory and k-NN queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import memory as M
from . import fixtures as fx
from .registry import register
from .sql_fixtures import PAIRS, SRC_DUP, TGT_DUP, TGT_LAST, with_

_PAIRS_SQL = with_(src=SRC_DUP, tgt=TGT_DUP, tl=TGT_LAST) + """
, sl as (select catalog, key, arg_max(value, ord) as v from src group by catalog, key)
select s.catalog, 'ja' as lang, s.key, s.ord, sl.v as source_text, tl.value as translation,
       concat('ja_', to_base64(encode(sl.v))) as id, 'unknown' as context
from src s join sl on sl.catalog = s.catalog and sl.key = s.key
           join tl on tl.catalog = s.catalog and tl.key = s.key"""


@register("tm_pairs", _PAIRS_SQL)
def tm_pairs(spark, sf):
    p = M.paired_entries(fx.source_entries_dup(spark, sf), fx.target_entries_dup(spark, sf), ["ja"])
    return p.select("catalog", "lang", "key", "ord", "source_text", "translation",
                    M.tm_id("lang", F.col("source_text")).alias("id"),
                    M.default_context().alias("context"))


def tm_writes(spark, sf):
    """Two rounds of TM writes from conversation pairs: all pairs, then revised ones (conv_id % 3 = 0)."""
    p = fx.conversation_pairs(spark, sf)
    seq = F.col("conv_id") * 1000 + F.col("turn")
    first = p.withColumn("seq", seq)
    revised = p.where(F.col("conv_id") % 3 == 0).select(
        "conv_id", "turn", "lang", "source_text",
        F.concat(F.lit("rev "), F.col("translation")).alias("translation"),
        (seq + F.lit(1000000000)).alias("seq"))
    return M.tm_rows(first.unionByName(revised), seq="seq").drop("embedding")


_WRITES_SQL = with_(pairs=PAIRS) + """
, w as (select concat(lang, '_', to_base64(encode(source_text))) as id, source_text, translation, lang,
               'unknown' as context, conv_id * 1000 + turn as seq from pairs
        union all
        select concat(lang, '_', to_base64(encode(source_text))), source_text, concat('rev ', translation), lang,
               'unknown', conv_id * 1000 + turn + 1000000000 from pairs where conv_id % 3 = 0)
"""


@register("tm_upsert_latest", _WRITES_SQL + """
select * from w qualify row_number() over (partition by id order by seq desc) = 1""")
def tm_upsert_latest(spark, sf):
    return M.upsert_latest(tm_writes(spark, sf))


@register("tm_append", _WRITES_SQL + "select * from w")
def tm_append(spark, sf):
    return tm_writes(spark, sf)


@register("tm_keep_first", _WRITES_SQL + """
select * from w qualify row_number() over (partition by id order by seq) = 1""")
def tm_keep_first(spark, sf):
    return M.keep_first(tm_writes(spark, sf))


@register("tm_inconsistent", _WRITES_SQL + """
select lang, source_text, count(distinct translation) as n_translations from w
group by lang, source_text having count(distinct translation) > 1""")
def tm_inconsistent(spark, sf):
    return M.inconsistent_translations(tm_writes(spark, sf))


_KNN_SQL = """
with e as (select vec_id, label, embedding from embeddings)
, p as (select cast(a.label as varchar) as part, a.vec_id as query_id, b.vec_id as hit_id,
               list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) as exact
        from {q} a join e b on a.label = b.label and a.vec_id <> b.vec_id)
, r as (select *, row_number() over (partition by query_id order by exact desc, hit_id) as rn,
              round(exact, 6) as similarity from p)
"""


@register("tm_knn", _KNN_SQL.format(q="e") + """
select part, query_id, cast(rn as integer) as rank, hit_id, similarity from r where rn <= 3""")
def tm_knn(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    return M.knn(e, e, 3, part_col="label", query_id="vec_id", memory_id="vec_id", exclude_self=True)


_FIRST_PER_LABEL = "(select * from e where vec_id in (select min(vec_id) from e group by label))"


@register("tm_search_topk", _KNN_SQL.format(q=_FIRST_PER_LABEL) + """
select part, query_id, cast(rn as integer) as rank, hit_id, similarity,
       cast(floor(similarity * 100 + 0.5) as integer) as percent
from r where rn <= 5""")
def tm_search_topk(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    firsts = e.groupBy("label").agg(F.min("vec_id").alias("vec_id")).join(e, ["label", "vec_id"])
    return M.search_top(firsts, e, 5, part_col="label", query_id="vec_id", memory_id="vec_id",
                        exclude_self=True)
