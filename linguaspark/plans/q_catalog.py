"""Registered catalog queries: diff, merges, import, flatten/nest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.order import positions
from ..operators import catalog as C
from ..operators import inference as I
from . import fixtures as fx
from .registry import register
from .sql_fixtures import INCOMING, NATION_ROWS, SRC_DUP, TGT_DUP, TGT_LAST, with_

LANGS = ["ja"]

# --- step 1: diff core ---------------------------------------------------------

_NOT_IN_TGT = "not exists (select 1 from tgt t where t.catalog = s.catalog and t.key = s.key)"


@register("catalog_missing", with_(src=SRC_DUP, tgt=TGT_DUP) + f"""
select s.catalog, 'ja' as lang, s.key, s.value, s.ord from src s where {_NOT_IN_TGT}""")
def catalog_missing(spark, sf):
    return C.missing_entries(fx.source_entries_dup(spark, sf), fx.target_entries_dup(spark, sf), LANGS)


@register("catalog_outdated", with_(src=SRC_DUP, tgt=TGT_DUP, tl=TGT_LAST) + """
select s.catalog, 'ja' as lang, s.key, s.value as source_value, s.ord as source_ord,
       t.value as target_value, t.ord as target_ord
from src s join tl t on t.catalog = s.catalog and t.key = s.key
where s.value is distinct from t.value""")
def catalog_outdated(spark, sf):
    return C.outdated_pairs(fx.source_entries_dup(spark, sf), fx.target_entries_dup(spark, sf), LANGS)


@register("catalog_reviewable", with_(src=SRC_DUP, tgt=TGT_DUP) + f"""
select s.catalog, 'ja' as lang, s.key, s.value, s.ord from src s where not ({_NOT_IN_TGT})""")
def catalog_reviewable(spark, sf):
    return C.reviewable_entries(fx.source_entries_dup(spark, sf), fx.target_entries_dup(spark, sf), LANGS)


_COVERAGE_SQL = with_(src=SRC_DUP, tgt=TGT_DUP, tl=TGT_LAST) + """
, cls as (
  select s.catalog, 'ja' as lang,
         case when t.key is null then 'missing' when s.value is not distinct from t.value then 'same'
              else 'outdated' end as status
  from src s left join tl t on t.catalog = s.catalog and t.key = s.key
), a as (
  select catalog, lang, count(*) as n_source,
         count(*) filter (where status = 'missing') as n_missing,
         count(*) filter (where status = 'outdated') as n_outdated,
         count(*) filter (where status = 'same') as n_same
  from cls group by catalog, lang
), b as (select catalog, lang, count(*) as n_target from tgt group by catalog, lang
), c as (
  select t.catalog, t.lang, count(*) as n_extra from tl t
  where not exists (select 1 from src s where s.catalog = t.catalog and s.key = t.key)
  group by t.catalog, t.lang
)
select coalesce(a.catalog, b.catalog, c.catalog) as catalog, coalesce(a.lang, b.lang, c.lang) as lang,
       coalesce(a.n_source, 0) as n_source, coalesce(b.n_target, 0) as n_target,
       coalesce(a.n_missing, 0) as n_missing, coalesce(a.n_outdated, 0) as n_outdated,
       coalesce(a.n_same, 0) as n_same, coalesce(c.n_extra, 0) as n_extra
from a full join b on a.catalog = b.catalog and a.lang = b.lang
       full join c on coalesce(a.catalog, b.catalog) = c.catalog and coalesce(a.lang, b.lang) = c.lang"""


@register("catalog_coverage", _COVERAGE_SQL)
def catalog_coverage(spark, sf):
    return C.coverage(fx.source_entries_dup(spark, sf), fx.target_entries_dup(spark, sf), LANGS)


@register("catalog_last_wins", with_(tgt=TGT_DUP) + """
select catalog, lang, key, arg_max(value, ord) as value, max(ord) as ord from tgt group by catalog, lang, key""")
def catalog_last_wins(spark, sf):
    return C.last_wins(fx.target_entries_dup(spark, sf))


# --- step 2: merges --------------------------------------------------------------


def _numbered(entries):
    """``pos``, the place by ``ord`` in each catalog, instead of ``ord``."""
    return positions(entries, ["catalog", "lang"]).drop("ord")


def translate_results(missing, lang_col="lang"):
    """Mock-translate the last value of every missing key."""
    last = C.last_wins(missing.select("catalog", "lang", "key", "value", "ord"))
    prov = I.expression_provider(lambda df: I.mock_translate(df["value"], df[lang_col]))
    return I.call_provider(last, prov, out_col="translated")


@register("translate_merge", with_(src=SRC_DUP, tgt=TGT_DUP) + f"""
, miss as (select s.catalog, 'ja' as lang, s.key, s.value, s.ord from src s where {_NOT_IN_TGT})
, ml as (select catalog, lang, key, arg_max(value, ord) as value, min(ord) as ord from miss group by catalog, lang, key)
, m as (select catalog, lang, key, value, ord, false as is_new from tgt
        union all
        select catalog, lang, key, concat('[', lang, '] ', value) as value, ord, true as is_new from ml)
select catalog, lang, key, value, is_new,
       row_number() over (partition by catalog, lang order by is_new, ord) as pos from m""")
def translate_merge(spark, sf):
    src, tgt = fx.source_entries_dup(spark, sf), fx.target_entries_dup(spark, sf)
    missing = C.missing_entries(src, tgt, LANGS)
    return _numbered(C.merge_translations(tgt, missing, translate_results(missing)))


def review_results(outdated):
    """Review outdated keys with a rule provider: it upper-cases the current translation."""
    per_key = C.last_wins(outdated.select("catalog", "lang", "key", "source_value", "target_value",
                                          F.col("source_ord").alias("ord")))
    prompted = per_key.withColumn("prompt", I.review_prompt("source_value", "target_value", "lang"))
    prov = I.expression_provider(lambda df: F.concat(
        F.lit("IMPROVED: "), F.upper(df["target_value"]), F.lit("\nCHANGES: "),
        F.when(df["target_value"] == F.upper(df["target_value"]), F.lit(I.NO_CHANGES))
        .otherwise(F.lit("upper-cased"))))
    replied = I.call_provider(prompted, prov)
    improved, changes = I.parse_review_reply("reply", "target_value")
    return replied.withColumn("translated", improved).withColumn("changes", changes)


@register("review_merge", with_(src=SRC_DUP, tgt=TGT_DUP, tl=TGT_LAST) + """
, od as (select s.catalog, 'ja' as lang, s.key, t.value as cur
         from src s join tl t on t.catalog = s.catalog and t.key = s.key
         where s.value is distinct from t.value)
, rv as (select distinct catalog, lang, key, cur from od)
select t.catalog, t.lang, t.key,
       case when rv.key is null then t.value else coalesce(nullif(trim(upper(rv.cur)), ''), rv.cur) end as value,
       t.ord
from tgt t left join rv on rv.catalog = t.catalog and rv.lang = t.lang and rv.key = t.key""")
def review_merge(spark, sf):
    src, tgt = fx.source_entries_dup(spark, sf), fx.target_entries_dup(spark, sf)
    res = review_results(C.outdated_pairs(src, tgt, LANGS))
    return C.merge_reviews(tgt, res)


_ACC = "select * from inc where coalesce(key, '') <> '' and coalesce(value, '') <> ''"


@register("import_upsert", with_(tgt=TGT_DUP, inc=INCOMING) + f"""
, acc as ({_ACC})
, il as (select catalog, lang, key, arg_max(value, seq) as v, min(seq) as f from acc group by catalog, lang, key)
, ol as (select catalog, lang, key, arg_max(value, ord) as v, min(ord) as p from tgt group by catalog, lang, key)
, m as (select coalesce(ol.catalog, il.catalog) as catalog, coalesce(ol.lang, il.lang) as lang,
               coalesce(ol.key, il.key) as key, coalesce(il.v, ol.v) as value, ol.key is null as is_new,
               case when ol.key is null then il.f else ol.p end as ord
        from ol full join il on ol.catalog = il.catalog and ol.lang = il.lang and ol.key = il.key)
select catalog, lang, key, value, is_new,
       row_number() over (partition by catalog, lang order by is_new, ord) as pos from m""")
def import_upsert(spark, sf):
    return _numbered(C.upsert_entries(fx.target_entries_dup(spark, sf), fx.incoming_translations(spark, sf)))


@register("import_counts", with_(tgt=TGT_DUP, inc=INCOMING) + """
, k as (select distinct catalog, lang, key from tgt)
, j as (select i.*, k.key is not null as ex, coalesce(i.key, '') <> '' and coalesce(i.value, '') <> '' as ok
        from inc i left join k on k.catalog = i.catalog and k.lang = i.lang and k.key = i.key)
select catalog, lang, count(*) filter (where ok and not ex) as n_added,
       count(*) filter (where ok and ex) as n_updated, count(*) filter (where not ok) as n_skipped
from j group by catalog, lang""")
def import_counts(spark, sf):
    return C.import_counts(fx.target_entries_dup(spark, sf), fx.incoming_translations(spark, sf))


@register("import_rejects", with_(inc=INCOMING) + """
select catalog, lang, key, value, seq from inc where coalesce(key, '') = '' or coalesce(value, '') = ''""")
def import_rejects(spark, sf):
    _, rej = C.split_valid_records(fx.incoming_translations(spark, sf))
    return rej


# --- step 3: nested JSON ---------------------------------------------------------


@register("catalog_flatten", with_(n=NATION_ROWS) + "select catalog, lang, key, value from n")
def catalog_flatten(spark, sf):
    files = fx.nation_catalog_files(spark, sf).unionByName(fx.event_prop_files(spark, sf))
    return C.flatten_catalogs(files).entries.select("catalog", "lang", "key", "value")


@register("catalog_nest_roundtrip", with_(tgt=TGT_DUP) + """
select catalog, lang, key, arg_max(value, ord) as value from tgt group by catalog, lang, key""")
def catalog_nest_roundtrip(spark, sf):
    nested = C.nest_catalogs(fx.target_entries_dup(spark, sf))
    return C.flatten_catalogs(nested).entries.select("catalog", "lang", "key", "value")


@register("catalog_nest_lines", with_(tgt=TGT_DUP) + """
, k as (select catalog, lang, cast(string_split(key, '.')[2] as bigint) as id, arg_max(value, ord) as value
        from tgt group by catalog, lang, key)
, r as (select *, row_number() over w as n, count(*) over (partition by catalog, lang) as total
        from k window w as (partition by catalog, lang order by id))
select catalog, lang, n,
       concat(case when n = 1 then '{\n  "part": {\n' else '' end,
              '    "', cast(id as varchar), '": {\n      "name": ', to_json(value), '\n    }',
              case when n = total then '\n  }\n}' else ',' end) as text from r""")
def catalog_nest_lines(spark, sf):
    """The nested documents of all target catalogs, piece by piece."""
    return C.nest_lines(fx.target_entries_dup(spark, sf))


_CONFLICT_KEYS = TGT_DUP + """
union all
select p_brand, 'ja', concat('part.', cast(p_partkey as varchar)), p_name, p_partkey + 3000000000
from part where p_partkey % 6 = 0
union all
select distinct p_brand, 'ja', 'part', 'all parts', 0 from part"""


@register("catalog_path_conflicts", with_(e=_CONFLICT_KEYS) + """
, k as (select distinct catalog, lang, key from e)
, p as (select catalog, lang, key as deeper_key, string_split(key, '.') as parts from k)
, x as (select catalog, lang, deeper_key, array_to_string(parts[1:i], '.') as leaf_key
        from p, unnest(generate_series(1, len(parts) - 1)) as g(i) where len(parts) > 1)
select x.catalog, x.lang, x.leaf_key, x.deeper_key
from x join k on k.catalog = x.catalog and k.lang = x.lang and k.key = x.leaf_key""")
def catalog_path_conflicts(spark, sf):
    p = fx.table(spark, sf, "part")
    extra = p.where(F.col("p_partkey") % 6 == 0).select(
        F.col("p_brand").alias("catalog"), F.lit("ja").alias("lang"),
        F.concat(F.lit("part."), F.col("p_partkey").cast("string")).alias("key"),
        F.col("p_name").alias("value"), (F.col("p_partkey") + F.lit(3000000000)).alias("ord"))
    root = p.select(F.col("p_brand").alias("catalog")).distinct().select(
        "catalog", F.lit("ja").alias("lang"), F.lit("part").alias("key"),
        F.lit("all parts").alias("value"), F.lit(0).cast("bigint").alias("ord"))
    return C.path_conflicts(fx.target_entries_dup(spark, sf).unionByName(extra).unionByName(root))


# --- key set operations and the rolled-up coverage -------------------------------


def _src_as_ja(spark, sf):
    return C.with_target_langs(fx.source_entries_dup(spark, sf), langs=LANGS)


@register("catalog_key_difference", with_(src=SRC_DUP, tgt=TGT_DUP) + """
select distinct catalog, 'ja' as lang, key from src
except
select catalog, lang, key from tgt""")
def catalog_key_difference(spark, sf):
    return C.key_difference(_src_as_ja(spark, sf), fx.target_entries_dup(spark, sf))


@register("catalog_key_intersection", with_(src=SRC_DUP, tgt=TGT_DUP) + """
select distinct catalog, 'ja' as lang, key from src
intersect
select catalog, lang, key from tgt""")
def catalog_key_intersection(spark, sf):
    return C.key_intersection(_src_as_ja(spark, sf), fx.target_entries_dup(spark, sf))


@register("catalog_coverage_rollup", with_(src=SRC_DUP, tgt=TGT_DUP, tl=TGT_LAST) + """
, cls as (
  select s.catalog, 'ja' as lang,
         case when t.key is null then 'missing' when s.value is not distinct from t.value then 'same'
              else 'outdated' end as status
  from src s left join tl t on t.catalog = s.catalog and t.key = s.key)
select lang, catalog, count(*) as n_source,
       count(*) filter (where status = 'missing') as n_missing,
       count(*) filter (where status = 'outdated') as n_outdated,
       count(*) filter (where status = 'same') as n_same
from cls group by rollup (lang, catalog)""")
def catalog_coverage_rollup(spark, sf):
    return C.coverage_rollup(fx.source_entries_dup(spark, sf), fx.target_entries_dup(spark, sf), LANGS)
