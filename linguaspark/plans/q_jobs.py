"""Registered end-to-end jobs over nested catalogs, code, glossary and memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.order import positions
from ..operators import catalog as C
from ..operators.imports import TRANSLATION_FIELDS, parse_delimited
from ..session import cut_lineage, new_work_path
from ..sources import files, memory_store
from . import fixtures as fx
from . import jobs as J
from .q_import import translation_csv_lines
from .q_inference import ja_glossary
from .registry import register
from .sql_fixtures import INCOMING, SRC_DUP, TGT_DUP, TGT_LAST, with_


def _as_files(entries):
    """Entries -> nested JSON documents -> entries again (the catalog file round trip), gone through once however often they are read."""
    return cut_lineage(C.flatten_catalogs(C.nest_catalogs(entries)).entries, "catalog-entries")


def _memory(spark, sf):
    rows, _ = J.build_memory(fx.source_entries_dup(spark, sf), fx.target_entries_dup(spark, sf), ["ja"])
    return rows


@register("job_translate", with_(src=SRC_DUP, tgt=TGT_DUP, tl=TGT_LAST) + """
, ml as (select catalog, 'ja' as lang, key, arg_max(value, ord) as value from src s
         where not exists (select 1 from tgt t where t.catalog = s.catalog and t.key = s.key)
         group by catalog, key)
select catalog, lang, key, value from tl
union all
select catalog, lang, key, concat('[ja] ', value) from ml""")
def job_translate(spark, sf):
    src = _as_files(fx.source_entries_dup(spark, sf))
    tgt = _as_files(fx.target_entries_dup(spark, sf))
    res = J.translate(src, tgt, ["ja"], glossary=ja_glossary(spark, sf), memory=_memory(spark, sf),
                      code_files=fx.code_files_from_parts(spark, sf), context=None)
    return _as_files(res.entries).select("catalog", "lang", "key", "value")


def _rule_review_provider():
    from ..operators import inference as I
    return I.expression_provider(lambda df: F.concat(
        F.lit("IMPROVED: "), F.upper(df["target_value"]), F.lit("\nCHANGES: "),
        F.when(df["target_value"] == F.upper(df["target_value"]), F.lit(I.NO_CHANGES))
        .otherwise(F.lit("upper-cased"))))


@register("job_review", with_(src=SRC_DUP, tgt=TGT_DUP, tl=TGT_LAST) + """
, od as (select distinct s.catalog, s.key from src s join tl t on t.catalog = s.catalog and t.key = s.key
         where s.value is distinct from t.value)
select t.catalog, t.lang, t.key,
       case when od.key is null then t.value else coalesce(nullif(upper(t.value), ''), t.value) end as value
from tl t left join od on od.catalog = t.catalog and od.key = t.key""")
def job_review(spark, sf):
    src = _as_files(fx.source_entries_dup(spark, sf))
    tgt = _as_files(fx.target_entries_dup(spark, sf))
    res = J.review(src, tgt, ["ja"], _rule_review_provider(), glossary=ja_glossary(spark, sf))
    return _as_files(res.entries).select("catalog", "lang", "key", "value")


_MISSING_LAST = """ml as (select catalog, 'ja' as lang, key, arg_max(value, ord) as value from src s
         where not exists (select 1 from tgt t where t.catalog = s.catalog and t.key = s.key)
         group by catalog, key)"""


@register("job_build_search", with_(src=SRC_DUP, tgt=TGT_DUP, tl=TGT_LAST) + f"""
, {_MISSING_LAST}
, sl as (select catalog, key, arg_max(value, ord) as value from src group by catalog, key)
, pr as (select sl.value as source_text, t.value as translation,
                row_number() over (partition by sl.value order by s.ord desc, s.catalog desc, s.key desc) as last
         from src s join sl on sl.catalog = s.catalog and sl.key = s.key join tl t on t.catalog = s.catalog and t.key = s.key)
, mem as (select concat('ja_', to_base64(encode(source_text))) as id, source_text, translation from pr where last = 1)
, texts as (select source_text as t from mem union select value from ml)
, grams as (select t, 961 * unicode(substr(p, i, 1)) + 31 * unicode(substr(p, i + 1, 1)) + unicode(substr(p, i + 2, 1)) as h
            from (select t, concat(' ', t, ' ') as p, unnest(range(1, length(t) + 1)) as i from texts))
, vec as (select t, h % 64 as b, sum(case when (h // 64) % 2 = 0 then 1 else -1 end) as v from grams group by t, h % 64)
, norm as (select t, sqrt(sum(v * v)) as n from vec group by t)
, qt as (select distinct value as t from ml)
, dots as (select q.t as qt, m.source_text as mt, sum(a.v * b.v) as d
           from qt q join vec a on a.t = q.t join vec b on b.b = a.b join mem m on m.source_text = b.t group by 1, 2)
, best as (select qt.t, m.id, m.source_text, m.translation, coalesce(d.d / (nq.n * nm.n), 0) as s,
                  row_number() over (partition by qt.t order by coalesce(d.d / (nq.n * nm.n), 0) desc, m.id) as rank
           from qt cross join mem m left join dots d on d.qt = qt.t and d.mt = m.source_text
           join norm nq on nq.t = qt.t join norm nm on nm.t = m.source_text
           qualify rank <= 3)
select ml.key as query_id, b.rank, b.id as hit_id, round(b.s, 6) as similarity,
       cast(floor(round(b.s, 6) * 100 + 0.5) as integer) as percent, b.source_text, b.translation
from ml join best b on b.t = ml.value""")
def job_build_search(spark, sf):
    """Build the TM from the catalogs, then search it with the missing keys' source texts (k=3)."""
    memory = _memory(spark, sf)
    m = C.last_wins(C.missing_entries(fx.source_entries_dup(spark, sf), fx.target_entries_dup(spark, sf),
                                      ["ja"]).select("catalog", "lang", "key", "value", "ord"))
    queries = m.select(F.col("key").alias("query_id"), "lang", F.col("value").alias("text"))
    return J.search(memory, queries, k=3).select("query_id", "rank", "hit_id", "similarity", "percent",
                                                  "source_text", "translation")


@register("job_tm_cycle", with_(src=SRC_DUP, tgt=TGT_DUP, tl=TGT_LAST) + f"""
, {_MISSING_LAST}
, sl as (select catalog, key, arg_max(value, ord) as value from src group by catalog, key)
, od as (select distinct s.catalog, s.key from src s join tl t on t.catalog = s.catalog and t.key = s.key
         where s.value is distinct from t.value)
, lo as (select s.catalog, s.key, arg_max(s.value, s.ord) as value from src s join tl t on t.catalog = s.catalog and t.key = s.key
         where s.value is distinct from t.value group by s.catalog, s.key)
, rv as (select lo.value from lo join tl t on t.catalog = lo.catalog and t.key = lo.key
         where coalesce(nullif(upper(t.value), ''), t.value) <> t.value)
select concat('ja_', to_base64(encode(value))) as id, value as source_text, 'ja' as lang, 'unknown' as context, 64 as n_dims
from (select value from ml union select value from rv)""")
def job_tm_cycle(spark, sf):
    """Translate and review write their results to one TM table, vectors and all; the table is read back."""
    src, tgt = fx.source_entries_dup(spark, sf), fx.target_entries_dup(spark, sf)
    path = new_work_path(spark, "tm-cycle")
    memory_store.write_memory(J.translate(src, tgt, ["ja"]).memory_rows, path)
    memory_store.write_memory(J.review(src, tgt, ["ja"], _rule_review_provider()).memory_rows, path)
    tm = memory_store.read_memory(spark, path, ["ja"])
    return tm.select("id", "source_text", "lang", "context", F.size("embedding").alias("n_dims"))


@register("job_import_translate", with_(src=SRC_DUP, tgt=TGT_DUP, inc=INCOMING) + """
, acc as (select * from inc where coalesce(key, '') <> '' and coalesce(value, '') <> '')
, imp as (select coalesce(o.catalog, i.catalog) as catalog, coalesce(o.key, i.key) as key, coalesce(i.v, o.v) as value,
                 case when o.key is null then 1 else 0 end as side, case when o.key is null then i.f else o.p end as ord
          from (select catalog, key, arg_max(value, ord) as v, min(ord) as p from tgt group by catalog, key) o
          full join (select catalog, key, arg_max(value, seq) as v, min(seq) as f from acc group by catalog, key) i
          on o.catalog = i.catalog and o.key = i.key)
, ml as (select catalog, key, arg_max(value, ord) as value, min(ord) as ord from src s
         where not exists (select 1 from imp t where t.catalog = s.catalog and t.key = s.key) group by catalog, key)
, done as (select catalog, key, value, side, ord from imp
           union all select catalog, key, concat('[ja] ', value), 2, ord from ml)
select catalog, 'ja' as lang, key, value,
       row_number() over (partition by catalog order by cast(string_split(key, '.')[2] as bigint), side, ord) as pos
from done""")
def job_import_translate(spark, sf):
    """Import, translate what is still missing, write the catalog files, read them: keys keep their order all the way."""
    imported = cut_lineage(J.import_translations(fx.target_entries_dup(spark, sf), fx.incoming_translations(spark, sf)).entries, "imported")
    done = cut_lineage(J.translate(fx.source_entries_dup(spark, sf), imported, ["ja"]).entries, "translated")
    root = new_work_path(spark, "catalogs")
    files.write_catalogs(done, root)
    back = files.read_catalogs(spark, root, required=True).entries
    return positions(back, ["catalog", "lang"]).select("catalog", "lang", "key", "value", "pos")


_IMPORT_LINES = """select 'all' as catalog, 'ja' as lang, key, value, seq from (
  select p_partkey * 2 as seq,
    regexp_replace(string_split(line, ',')[1], '^\\s+|\\s+$', '', 'g') as key,
    regexp_replace(string_split(line, ',')[2], '^\\s+|\\s+$', '', 'g') as value, line
  from (select p_partkey, concat(case when p_partkey % 13 = 0 then concat('part.', cast(p_partkey as varchar), '.name')
              when p_partkey % 4 = 0 then concat('part.', cast(p_partkey as varchar), '.name', ',', chr(9), p_name, chr(9))
              else concat('part.', cast(p_partkey as varchar), '.name', ',', p_name, ',extra') end,
         case when p_partkey % 3 = 0 then chr(13) else '' end) as line from part))"""


@register("job_import", with_(tgt=TGT_DUP, inc=_IMPORT_LINES) + """
, ex as (select 'all' as catalog, lang, key, value, ord from tgt)
, acc as (select * from inc where coalesce(key, '') <> '' and coalesce(value, '') <> '')
, il as (select catalog, lang, key, arg_max(value, seq) as v from acc group by catalog, lang, key)
, ol as (select catalog, lang, key, arg_max(value, ord) as v from ex group by catalog, lang, key)
select coalesce(ol.catalog, il.catalog) as catalog, coalesce(ol.lang, il.lang) as lang,
       coalesce(ol.key, il.key) as key, coalesce(il.v, ol.v) as value, ol.key is null as is_new
from ol full join il on ol.catalog = il.catalog and ol.lang = il.lang and ol.key = il.key""")
def job_import(spark, sf):
    existing = fx.target_entries_dup(spark, sf).withColumn("catalog", F.lit("all"))
    records = parse_delimited(translation_csv_lines(spark, sf), TRANSLATION_FIELDS)
    res = J.import_translations(existing, records, catalog="all", lang="ja")
    return res.entries.select("catalog", "lang", "key", "value", "is_new")


@register("job_import_counts", with_(tgt=TGT_DUP, inc=_IMPORT_LINES) + """
, k as (select distinct key from tgt)
select 'all' as catalog, 'ja' as lang,
       count(*) filter (where coalesce(i.key, '') <> '' and coalesce(i.value, '') <> '' and k.key is null) as n_added,
       count(*) filter (where coalesce(i.key, '') <> '' and coalesce(i.value, '') <> '' and k.key is not null)
         as n_updated,
       count(*) filter (where coalesce(i.key, '') = '' or coalesce(i.value, '') = '') as n_skipped
from inc i left join k on k.key = i.key""")
def job_import_counts(spark, sf):
    existing = fx.target_entries_dup(spark, sf).withColumn("catalog", F.lit("all"))
    records = parse_delimited(translation_csv_lines(spark, sf), TRANSLATION_FIELDS)
    return J.import_translations(existing, records, catalog="all", lang="ja").counts

