"""Registered inference queries: prompts, reply parsing, providers, batch stats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import glossary as G
from ..operators import inference as I
from ..operators.windows import batch_numbers
from ..session import new_work_path
from . import fixtures as fx
from .registry import register
from .sql_fixtures import SRC_DUP, TGT, TGT_DUP, TGT_LAST, with_


SIMILAR_T = "array<struct<source:string,translation:string,similarity:double>>"


def sqlstr(s: str) -> str:
    """A Python string as a DuckDB expression (newlines via chr(10))."""
    parts = [("'" + p.replace("'", "''") + "'") for p in s.split("\n")]
    return "concat(" + ", chr(10), ".join(parts) + ")" if len(parts) > 1 else parts[0]


def ja_glossary(spark, sf):
    """A 'ja' glossary of the words of part names, in first-seen order."""
    p = fx.table(spark, sf, "part")
    w = p.select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "term"))
    g = w.groupBy("term").agg(F.min(F.col("p_partkey") * 10 + F.col("pos")).alias("seq"))
    return g.select("term", F.create_map(F.lit("ja"), F.concat(F.lit("ja-"), F.col("term"))).alias("translations"),
                    F.lit(None).cast("string").alias("context"), F.lit(None).cast("string").alias("notes"),
                    F.col("seq").cast("bigint").alias("seq"))


GLOSS_JA = """select w as term, concat('ja-', w) as translation, min(p_partkey * 10 + i - 1) as seq from (
  select p_partkey, unnest(string_split(p_name, ' ')) as w,
         unnest(generate_series(1, len(string_split(p_name, ' ')))) as i from part) group by w"""

GPART = f"""(select concat({sqlstr(I.GLOSSARY_HEAD)},
        string_agg(concat('- "', term, '" should be translated as "', translation, '"', chr(10)), '' order by seq),
        chr(10)) from gl)"""

MISS_LAST = """select catalog, lang, key, arg_max(value, ord) as value, max(ord) as ord from (
  select s.catalog, 'ja' as lang, s.key, s.value, s.ord from src s
  where not exists (select 1 from tgt t where t.catalog = s.catalog and t.key = s.key))
group by catalog, lang, key"""


def _missing_last(spark, sf):
    m = C.missing_entries(fx.source_entries_dup(spark, sf), fx.target_entries_dup(spark, sf), ["ja"])
    return C.last_wins(m.select("catalog", "lang", "key", "value", "ord"))


@register("prompt_translate", with_(src=SRC_DUP, tgt=TGT_DUP, gl=GLOSS_JA, ml=MISS_LAST) + f"""
select catalog, lang, key,
       concat({sqlstr(I.TRANSLATE_HEAD)}, lang, ':', chr(10), chr(10), value, chr(10), chr(10),
              concat({sqlstr(I.CONTEXT_HEAD)}, catalog, {sqlstr(I.CONTEXT_TAIL)}),
              {GPART}, {sqlstr(I.TRANSLATE_FOOT)}) as prompt
from ml""")
def prompt_translate(spark, sf):
    lists = G.prompt_lists(ja_glossary(spark, sf))
    m = _missing_last(spark, sf).join(lists, "lang", "left")
    return m.select("catalog", "lang", "key",
                    I.translation_prompt("value", "lang", context="catalog", similar=F.array().cast(SIMILAR_T),
                                         glossary="glossary").alias("prompt"))


@register("prompt_review", with_(src=SRC_DUP, tgt=TGT_DUP, tl=TGT_LAST, gl=GLOSS_JA) + f"""
, od as (select s.catalog, 'ja' as lang, s.key, arg_max(s.value, s.ord) as sv, any_value(t.value) as tv
         from src s join tl t on t.catalog = s.catalog and t.key = s.key
         where s.value is distinct from t.value group by s.catalog, s.key)
select catalog, lang, key,
       concat({sqlstr(I.REVIEW_HEAD)}, lang, ':', chr(10), chr(10), 'Original (English): ', sv, chr(10),
              'Current translation (', lang, '): ', tv, chr(10), chr(10), {GPART}, {sqlstr(I.REVIEW_FOOT)}) as prompt
from od""")
def prompt_review(spark, sf):
    od = C.outdated_pairs(fx.source_entries_dup(spark, sf), fx.target_entries_dup(spark, sf), ["ja"])
    per_key = C.last_wins(od.select("catalog", "lang", "key", "source_value", "target_value",
                                    F.col("source_ord").alias("ord")))
    lists = G.prompt_lists(ja_glossary(spark, sf))
    return per_key.join(lists, "lang", "left").select(
        "catalog", "lang", "key",
        I.review_prompt("source_value", "target_value", "lang", glossary="glossary").alias("prompt"))


def _replies(spark, sf):
    t = fx.target_entries(spark, sf)
    k, v = F.col("ord"), F.col("value")
    body = (F.when(k % 4 == 0, F.concat(F.lit("Sure: "), v))
            .when(k % 3 == 0, F.concat(F.lit("IMPROVED: "), F.upper(v), F.lit(" ")))
            .otherwise(F.concat(F.lit("IMPROVED: "), F.upper(v), F.lit("\nCHANGES: "),
                                F.when(k % 2 == 0, F.lit("No changes needed")).otherwise(F.lit("upper-cased")))))
    reply = F.when(k % 7 == 0, F.concat(F.lit("\t"), body, F.lit("\r"))).otherwise(body)
    return t.withColumn("reply", reply)


@register("review_parse", with_(t=TGT) + """
select catalog, lang, key,
       case when ord % 4 = 0 then value else coalesce(nullif(upper(value), ''), value) end as improved,
       case when ord % 4 = 0 or ord % 3 = 0 then 'No changes provided'
            when ord % 2 = 0 then 'No changes needed' else 'upper-cased' end as changes,
       not (ord % 4 <> 0 and ord % 3 <> 0 and ord % 2 = 0) as is_improved
from t""")
def review_parse(spark, sf):
    r = _replies(spark, sf)
    improved, changes = I.parse_review_reply("reply", "value")
    out = r.select("catalog", "lang", "key", improved.alias("improved"), changes.alias("changes"))
    return out.withColumn("is_improved", I.is_improvement("changes"))


_MOCK_SQL = with_(src=SRC_DUP, tgt=TGT_DUP, ml=MISS_LAST) + """
select catalog, lang, key, value as original, concat('[', lang, '] ', value) as translated, true as is_new from ml"""


@register("mock_translate", _MOCK_SQL)
def mock_translate(spark, sf):
    ml = _missing_last(spark, sf)
    prov = I.expression_provider(lambda df: I.mock_translate(df["value"], df["lang"]))
    res = I.call_provider(ml, prov, out_col="translated")
    return I.result_rows(res.select("catalog", "lang", "key", "value", "translated"), "value", "translated", True)


@register("provider_translate", _MOCK_SQL)
def provider_translate(spark, sf):
    """The same job with a Python batch provider run in mapInPandas (M1)."""
    ml = _missing_last(spark, sf)
    res = I.call_provider(ml, I.MockTranslator("ja"), prompt_col="value", out_col="translated", max_parallel=5)
    return I.result_rows(res.select("catalog", "lang", "key", "value", "translated"), "value", "translated", True)


@register("provider_ledger", with_(src=SRC_DUP, tgt=TGT_DUP, ml=MISS_LAST) + """
select catalog, lang, key, value as original, concat('[ja] ', value) as translated,
       (select count(distinct value) from ml) as n_calls from ml""")
def provider_ledger(spark, sf):
    """The job run twice over one ledger: the second run sends nothing, each distinct prompt was sent once."""
    ml = _missing_last(spark, sf)
    ledger = new_work_path(spark, "ledger")
    I.call_durably(ml, I.MockTranslator("ja"), ledger, "value", "translated", slices=4)
    res = I.call_durably(ml, I.MockTranslator("ja"), ledger, "value", "translated", slices=4)
    n = spark.read.parquet(ledger).count()
    return res.select("catalog", "lang", "key", F.col("value").alias("original"), "translated", F.lit(n).cast("bigint").alias("n_calls"))


@register("batch_stats", with_(src=SRC_DUP, tgt=TGT_DUP) + """
, m as (select s.catalog, 'ja' as lang, s.key, s.value, s.ord from src s
        where not exists (select 1 from tgt t where t.catalog = s.catalog and t.key = s.key))
, b as (select *, cast(floor((row_number() over (partition by catalog, lang order by ord) - 1) / 5) + 1 as bigint)
                  as batch_id from m)
select catalog, lang, batch_id, count(*) filter (where length(value) % 7 <> 0) as n_ok,
       count(*) filter (where length(value) % 7 = 0) as n_error
from b group by catalog, lang, batch_id""")
def batch_stats(spark, sf):
    m = C.missing_entries(fx.source_entries_dup(spark, sf), fx.target_entries_dup(spark, sf), ["ja"])
    b = batch_numbers(m, ["catalog", "lang"], "ord", 5)
    prov = I.expression_provider(
        lambda df: I.mock_translate(df["value"], df["lang"]),
        error=lambda df: F.when(F.length(df["value"]) % 7 == 0, F.lit("provider failed")))
    return I.batch_stats(I.call_provider(b, prov, out_col="translated"))


@register("review_stats", with_(src=SRC_DUP, tgt=TGT_DUP, tl=TGT_LAST) + """
, od as (select distinct s.catalog, 'ja' as lang, s.key, t.value as tv
         from src s join tl t on t.catalog = s.catalog and t.key = s.key where s.value is distinct from t.value)
select catalog, lang, count(*) as n_reviewed, count(*) filter (where tv <> upper(tv)) as n_improved
from od group by catalog, lang""")
def review_stats(spark, sf):
    from .q_catalog import review_results
    od = C.outdated_pairs(fx.source_entries_dup(spark, sf), fx.target_entries_dup(spark, sf), ["ja"])
    return I.review_change_counts(review_results(od))


@register("batch_numbers_lineitem", """
select l_returnflag, l_orderkey, l_linenumber,
       cast(floor((row_number() over (partition by l_returnflag order by l_orderkey, l_linenumber) - 1) / 50) + 1 as bigint)
           as batch_id
from lineitem""")
def batch_numbers_lineitem(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_returnflag", "l_orderkey", "l_linenumber")
    li = li.withColumn("o", F.struct("l_orderkey", "l_linenumber"))
    return batch_numbers(li, ["l_returnflag"], "o", 50).drop("o")
