"""Registered glossary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.order import positions
from ..operators import glossary as G
from ..operators import inference as I
from . import fixtures as fx
from .registry import register
from .sql_fixtures import GLOSS_IN, GLOSS_LONG, with_

IMPORT_LANG = "europe"

_UPSERT = with_(ex=GLOSS_LONG, inc=GLOSS_IN) + f"""
, ok as (select * from inc where coalesce(term, '') <> '' and coalesce(translation, '') <> '')
, al as (select lower(term) as lt, term, context, notes, seq from ex
         union all select lower(term), term, nullif(context, ''), nullif(notes, ''), seq from ok)
, attr as (select lt, arg_max(term, seq) as term,
                  arg_max(context, seq) filter (where context is not null) as context,
                  arg_max(notes, seq) filter (where notes is not null) as notes, min(seq) as seq
           from al group by lt)
, tr as (select lower(term) as lt, lang, translation, seq from ex
         union all select lower(term), '{IMPORT_LANG}', translation, seq from ok)
, trl as (select lt, lang, arg_max(translation, seq) as translation from tr group by lt, lang)
, g as (select a.term, t.lang, t.translation, a.context, a.notes, a.seq from attr a join trl t on a.lt = t.lt)
"""


def upserted(spark, sf):
    inc = G.import_records_to_entries(fx.glossary_incoming(spark, sf), IMPORT_LANG)
    return G.upsert(fx.glossary_existing(spark, sf), inc)


def _long(glossary):
    return glossary.select("term", F.explode("translations").alias("lang", "translation"),
                           "context", "notes", "seq")


def _numbered(df, *groups):
    """``pos``, the place by ``seq`` in each group, instead of ``seq``."""
    return positions(df, list(groups), "seq").drop("seq")


@register("glossary_upsert", _UPSERT + """
select term, lang, translation, context, notes, dense_rank() over (order by seq) as pos from g""")
def glossary_upsert(spark, sf):
    return _long(_numbered(upserted(spark, sf)).withColumnRenamed("pos", "seq")).withColumnRenamed("seq", "pos")


@register("glossary_remove", with_(ex=GLOSS_LONG) + """
select term, lang, translation, seq from ex
where lower(term) not in (select lower(n_name) from nation where n_nationkey % 4 = 0)""")
def glossary_remove(spark, sf):
    gone = fx.table(spark, sf, "nation").where(F.col("n_nationkey") % 4 == 0).select(F.col("n_name").alias("term"))
    return _long(G.remove(fx.glossary_existing(spark, sf), gone)).select("term", "lang", "translation", "seq")


@register("glossary_for_lang", _UPSERT + """
select lang, term, arg_max(translation, seq) as translation, row_number() over (partition by lang order by min(seq)) as pos
from g where coalesce(translation, '') <> '' group by lang, term""")
def glossary_for_lang(spark, sf):
    return _numbered(G.for_language(upserted(spark, sf)), "lang")


_QUERIES_SQL = """select distinct lower(right(n_name, 2)) as q from nation
union select distinct unnest(string_split(lower(n_name), ' ')) from nation union select ''"""


@register("glossary_search", _UPSERT + f"""
, q as ({_QUERIES_SQL})
, texts as (select distinct term, lower(term) as text, seq from g
            union select term, lower(translation), seq from g)
select query, term, row_number() over (partition by query order by seq) as pos
from (select distinct q.q as query, t.term, t.seq from q join texts t on contains(t.text, q.q))""")
def glossary_search(spark, sf):
    n = fx.table(spark, sf, "nation")
    qs = (n.select(F.lower(F.substring("n_name", -2, 2)).alias("query"))
          .unionByName(n.select(F.explode(F.split(F.lower("n_name"), " ")).alias("query")))
          .unionByName(n.select(F.lit("").alias("query"))).distinct())
    return _numbered(G.search_many(upserted(spark, sf), qs).select("query", "term", "seq"), "query")


@register("glossary_prompt_map", _UPSERT + f"""
, fl as (select lang, term, arg_max(translation, seq) as translation, min(seq) as seq
         from g where coalesce(translation, '') <> '' group by lang, term)
select lang, concat('{I.GLOSSARY_HEAD.replace(chr(10), "', chr(10), '")}',
                    string_agg(concat('- "', term, '" should be translated as "', translation, '"', chr(10)), ''
                               order by seq), chr(10)) as text
from fl group by lang""")
def glossary_prompt_map(spark, sf):
    lists = G.prompt_lists(upserted(spark, sf))
    return lists.select("lang", I._glossary_part("glossary").alias("text"))


@register("glossary_find", _UPSERT + """
select lower(n.n_name) as query, g.term, g.lang, g.translation
from nation n join g on lower(g.term) = lower(n.n_name)""")
def glossary_find(spark, sf):
    n = fx.table(spark, sf, "nation").select(F.lower("n_name").alias("query"))
    found = G.find_term(upserted(spark, sf), n)
    return found.select("query", "term", F.explode("translations").alias("lang", "translation"))


@register("glossary_apply", """
with recursive x as (
  select p_partkey as id, case when p_partkey % 2 = 0 then upper(p_name) else p_name end as name, string_split(p_name, ' ') as l
  from part)
, words as (select distinct unnest(l) as w from x)
, pairs as (select distinct concat(l[i], ' ', l[i + 1]) as w
            from (select l, unnest(range(1, len(l))) as i from x where id % 3 = 0))
, t as (select id, concat(name, ' ', p_type) as text, string_split(concat(name, ' ', p_type), ' ') as l
        from x join part on p_partkey = id)
, walk(id, i, done) as (
  select id, 1, cast([] as varchar[]) from t
  union all
  select k.id, case when p.w is null then k.i + 1 else k.i + 2 end,
         list_append(k.done, case when p.w is not null then concat('[', upper(p.w), ']')
                                  when s.w is not null then concat('<', upper(s.w), ' ', s.w, '>') else t.l[k.i] end)
  from walk k join t on t.id = k.id and k.i <= len(t.l)
  left join pairs p on p.w = lower(concat(t.l[k.i], ' ', t.l[k.i + 1])) and k.i < len(t.l)
  left join words s on s.w = lower(t.l[k.i]))
select w.id, t.text, array_to_string(w.done, ' ') as applied
from walk w join t on t.id = w.id where w.i > len(t.l)""")
def glossary_apply(spark, sf):
    """Words of part names, given twice (the later counts), and pairs of neighbouring words, which go before their words."""
    p = fx.table(spark, sf, "part")
    words = fx.part_word_keys(spark, sf).select(F.col("key").alias("term"))
    # a translation holds its own term again: what was put in must not be replaced anew
    late = words.select("term", F.concat(F.lit("<"), F.upper("term"), F.lit(" "), "term", F.lit(">")).alias("translation"), F.lit(2).alias("seq"))
    early = words.select("term", F.lit("zzz").alias("translation"), F.lit(1).alias("seq"))
    parts = F.split("p_name", " ")
    pairs = p.where("p_partkey % 3 = 0").select(F.explode(F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, i, 2), " "))).alias("term")).distinct()
    pairs = pairs.select("term", F.concat(F.lit("["), F.upper("term"), F.lit("]")).alias("translation"), F.lit(1).alias("seq"))
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    texts = p.select(F.col("p_partkey").alias("id"), F.concat(name, F.lit(" "), "p_type").alias("text"))
    return G.apply_terms(texts, early.unionByName(late).unionByName(pairs))
