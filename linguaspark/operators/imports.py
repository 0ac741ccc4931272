"""Import record parsing: minimal delimited lines and JSON translation documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, js_trim, json_string_literal

# Field order of the two delimited import formats.
TRANSLATION_FIELDS = ["key", "value"]
GLOSSARY_FIELDS = ["term", "translation", "context", "notes"]


def parse_delimited(lines: DataFrame, fields: list[str], line_col: str = "line",
                    sep: str = ",") -> DataFrame:
    """S7/S9 + F2: drop blank lines, split on ``sep`` (no quoting), trim every field, keep the first fields.

    Short rows give nulls (``get`` is null-safe under ANSI mode); surplus
    fields are dropped, so a value containing the separator is cut there.
    """
    parts = F.split(F.col(line_col), sep, -1)
    kept = lines.where(~is_blank(line_col))
    out = kept.select(*[c for c in kept.columns if c != line_col],
                      *[js_trim(F.get(parts, i)).alias(f) for i, f in enumerate(fields)])
    return out


def json_value_string(raw, vtype):
    """P19 ``String(value)`` for a JSON member: text, number text, true/false, 'null', '[object Object]'."""
    return (F.when(vtype == "STRING", raw)
            .when(vtype == "VOID", F.lit("null"))
            .when(vtype.startswith("OBJECT"), F.lit("[object Object]"))
            .when(vtype.startswith("ARRAY"), F.concat_ws(",", F.from_json(raw, "array<string>")))
            .otherwise(raw))


def json_translation_records(docs: DataFrame, json_col: str = "json", strict_compat: bool = True) -> DataFrame:
    """Records ``(key, value, pos)`` from a JSON document per row.

    An object gives one record per top-level member with its value as a
    string (P19); an array is taken as ``[{key, value}]`` records. With
    ``strict_compat=False`` nested objects are flattened into dotted keys
    instead of becoming '[object Object]'.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    rest = [c for c in docs.columns if c != json_col]
    rt = F.schema_of_variant(F.try_parse_json(F.col(json_col)))
    d = docs.withColumn("_rt", rt)
    sm = F.map_from_entries(F.map_entries(F.from_json(json_col, "map<string,string>")))
    vm = F.map_from_entries(F.map_entries(F.from_json(json_col, "map<string,variant>")))
    objs = (d.where(F.col("_rt").startswith("OBJECT"))
            .select(*rest, F.posexplode(F.arrays_zip(F.map_keys(sm).alias("k"), F.map_values(sm).alias("raw"),
                                                     F.map_values(vm).alias("v"))).alias("pos", "m"))
            .select(*rest, "pos", F.col("m.k").alias("key"), F.col("m.raw").alias("raw"),
                    F.schema_of_variant(F.col("m.v")).alias("vt")))
    if strict_compat:
        obj_rows = objs.select(*rest, "key", json_value_string(F.col("raw"), F.col("vt")).alias("value"), "pos")
    else:
        from .catalog import flatten_catalogs
        flat_rows = objs.where(~F.col("vt").startswith("OBJECT")).select(
            *rest, "key", json_value_string(F.col("raw"), F.col("vt")).alias("value"), "pos")
        nested = objs.where(F.col("vt").startswith("OBJECT")).select(
            *rest, F.col("pos").alias("_mpos"),
            F.concat(F.lit("{"), json_string_literal(F.col("key")), F.lit(":"), F.col("raw"), F.lit("}")).alias("_j"))
        fl = flatten_catalogs(nested, ids=rest + ["_mpos"], text_col="_j").entries
        obj_rows = flat_rows.unionByName(fl.select(*rest, "key", "value", F.col("_mpos").alias("pos")))
    arr = (d.where(F.col("_rt").startswith("ARRAY"))
           .select(*rest, F.posexplode(F.from_json(json_col, "array<struct<key:string,value:string>>"))
                   .alias("pos", "r"))
           .select(*rest, F.col("r.key").alias("key"), F.col("r.value").alias("value"), "pos"))
    return obj_rows.unionByName(arr)
