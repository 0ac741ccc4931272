"""Registered import-parsing queries: delimited lines and JSON translation documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.imports import GLOSSARY_FIELDS, TRANSLATION_FIELDS, json_translation_records, parse_delimited
from . import fixtures as fx
from .registry import register
from .sql_fixtures import NATION_ROWS, with_


def translation_csv_lines(spark, sf):
    """Delimited import lines from the source catalogs: extra fields, blank lines, tabs, CRs, missing values."""
    p = fx.table(spark, sf, "part")
    k = F.col("p_partkey")
    key = F.concat(F.lit("part."), k.cast("string"), F.lit(".name"))
    body = (F.when(k % 13 == 0, key)
            .when(k % 4 == 0, F.concat(key, F.lit(",\t"), F.col("p_name"), F.lit("\t")))
            .otherwise(F.concat(key, F.lit(","), F.col("p_name"), F.lit(",extra"))))
    line = F.when(k % 3 == 0, F.concat(body, F.lit("\r"))).otherwise(body)
    rows = p.select((k * 2).alias("seq"), line.alias("line"))
    blanks = p.where(k % 10 == 0).select((k * 2 + 1).alias("seq"),
                                         F.when(k % 20 == 0, F.lit("")).otherwise(F.lit(" \t ")).alias("line"))
    return rows.unionByName(blanks)


_TR_LINES = """select p_partkey * 2 as seq,
  concat(case when p_partkey % 13 = 0 then concat('part.', cast(p_partkey as varchar), '.name')
              when p_partkey % 4 = 0 then concat('part.', cast(p_partkey as varchar), '.name', ',', chr(9), p_name, chr(9))
              else concat('part.', cast(p_partkey as varchar), '.name', ',', p_name, ',extra') end,
         case when p_partkey % 3 = 0 then chr(13) else '' end) as line
from part
union all
select p_partkey * 2 + 1, case when p_partkey % 20 = 0 then '' else concat(' ', chr(9), ' ') end
from part where p_partkey % 10 = 0"""

_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@register("import_csv_translations", with_(l=_TR_LINES) + f"""
select seq, {_TRIM.format("string_split(line, ',')[1]")} as key,
       {_TRIM.format("string_split(line, ',')[2]")} as value
from l where {_TRIM.format("line")} <> ''""")
def import_csv_translations(spark, sf):
    return parse_delimited(translation_csv_lines(spark, sf), TRANSLATION_FIELDS)


def glossary_csv_lines(spark, sf):
    n = fx.table(spark, sf, "nation")
    k = F.col("n_nationkey")
    line = (F.when(k % 5 == 0, F.concat(F.col("n_name"), F.lit(",,x")))
            .when(k % 3 == 0, F.concat(F.col("n_name"), F.lit(", g:"), F.lower("n_name")))
            .otherwise(F.concat(F.col("n_name"), F.lit(",g:"), F.lower("n_name"), F.lit(",ctx"), k.cast("string"),
                                F.lit(", note ,surplus"))))
    return n.select(k.cast("bigint").alias("seq"), line.alias("line"))


@register("import_csv_glossary", f"""
with l as (select cast(n_nationkey as bigint) as seq,
  case when n_nationkey % 5 = 0 then concat(n_name, ',,x')
       when n_nationkey % 3 = 0 then concat(n_name, ', g:', lower(n_name))
       else concat(n_name, ',g:', lower(n_name), ',ctx', cast(n_nationkey as varchar), ', note ,surplus') end as line
  from nation)
select seq, {_TRIM.format("string_split(line, ',')[1]")} as term,
       {_TRIM.format("string_split(line, ',')[2]")} as translation,
       {_TRIM.format("string_split(line, ',')[3]")} as context,
       {_TRIM.format("string_split(line, ',')[4]")} as notes
from l""")
def import_csv_glossary(spark, sf):
    return parse_delimited(glossary_csv_lines(spark, sf), GLOSSARY_FIELDS)


@register("import_json_flat", """
select concat('event.', cast(event_id as varchar)) as catalog, 'k' as key,
       cast(json_extract(props, '$.k') as varchar) as value, 0 as pos from events
union all
select r_name, 'nation', '[object Object]', 0 from region""")
def import_json_flat(spark, sf):
    docs = (fx.event_prop_files(spark, sf).unionByName(fx.nation_catalog_files(spark, sf))
            .select("catalog", "json"))
    return json_translation_records(docs).select("catalog", "key", "value", "pos")


@register("import_json_nested", with_(n=NATION_ROWS) + "select catalog, key, value from n")
def import_json_nested(spark, sf):
    docs = fx.nation_catalog_files(spark, sf).select("catalog", "json")
    return json_translation_records(docs, strict_compat=False).select("catalog", "key", "value")
