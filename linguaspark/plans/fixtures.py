"""Catalogs, code trees, glossaries and TM inputs derived from the test tables.

Every derived relation reads a whole table, so its size grows with the
scale factor. The SQL in ``plans/registry.py`` builds the same relations
for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _part_key(col: str = "p_partkey") -> Column:
    return F.concat(F.lit("part."), F.col(col).cast("string"), F.lit(".name"))


# R1 -------------------------------------------------------------------------

def source_entries(spark, sf_dir) -> DataFrame:
    """English source catalogs: one catalog per brand, one key per part."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("catalog"), F.lit("en").alias("lang"),
                    _part_key().alias("key"), F.col("p_name").alias("value"),
                    F.col("p_partkey").alias("ord"))


def source_entries_dup(spark, sf_dir) -> DataFrame:
    """Source with repeated keys (later rows win): parts divisible by 13 appear twice."""
    p = table(spark, sf_dir, "part")
    again = p.where(F.col("p_partkey") % 13 == 0).select(
        F.col("p_brand").alias("catalog"), F.lit("en").alias("lang"), _part_key().alias("key"),
        F.concat(F.col("p_name"), F.lit(" v2")).alias("value"),
        (F.col("p_partkey") + F.lit(1000000000)).alias("ord"))
    return source_entries(spark, sf_dir).unionByName(again)


def target_entries(spark, sf_dir) -> DataFrame:
    """Japanese target catalogs: some keys missing, some equal, some empty, the rest differ."""
    p = table(spark, sf_dir, "part").where(F.col("p_partkey") % 5 != 0)
    k = F.col("p_partkey")
    value = (F.when(k % 3 == 0, F.col("p_name"))
             .when(k % 7 == 0, F.lit(""))
             .otherwise(F.upper(F.col("p_name"))))
    return p.select(F.col("p_brand").alias("catalog"), F.lit("ja").alias("lang"),
                    _part_key().alias("key"), value.alias("value"), k.alias("ord"))


def target_entries_dup(spark, sf_dir) -> DataFrame:
    """Target with a second, later copy of every key divisible by 11."""
    p = table(spark, sf_dir, "part").where(F.col("p_partkey") % 11 == 0)
    again = p.select(F.col("p_brand").alias("catalog"), F.lit("ja").alias("lang"),
                     _part_key().alias("key"),
                     F.concat(F.lit("new "), F.col("p_name")).alias("value"),
                     (F.col("p_partkey") + F.lit(1000000000)).alias("ord"))
    return target_entries(spark, sf_dir).unionByName(again)


# R2 -------------------------------------------------------------------------

def nation_catalog_files(spark, sf_dir) -> DataFrame:
    """One nested JSON document per region: {"nation": {<name>: {"key": "<id>"}}}."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    j = n.join(r, n.n_regionkey == r.r_regionkey)
    return (j.groupBy(F.col("r_name").alias("catalog"))
            .agg(F.to_json(F.create_map(F.lit("nation"), F.map_from_entries(F.collect_list(
                F.struct("n_name", F.create_map(F.lit("key"), F.col("n_nationkey").cast("string")))))))
                 .alias("json"))
            .select("catalog", F.lit("en").alias("lang"), "json"))


def event_prop_files(spark, sf_dir) -> DataFrame:
    """Each event's props document; its only leaves are numbers, so it flattens to nothing."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("event."), F.col("event_id").cast("string")).alias("catalog"),
                    F.lit("en").alias("lang"), F.col("props").alias("json"))


# Import records (R1-derived) -------------------------------------------------

def incoming_translations(spark, sf_dir) -> DataFrame:
    """Import records for the ja catalogs: updates, new keys, repeats and invalid rows."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    upd = p.where(k % 4 == 0).select(
        F.col("p_brand").alias("catalog"), F.lit("ja").alias("lang"), _part_key().alias("key"),
        F.when(k % 17 == 0, F.lit("")).otherwise(F.concat(F.lit("imp "), F.col("p_name"))).alias("value"),
        k.alias("seq"))
    new = p.where(k % 9 == 0).select(
        F.col("p_brand").alias("catalog"), F.lit("ja").alias("lang"),
        F.concat(F.lit("part."), k.cast("string"), F.lit(".desc")).alias("key"),
        F.concat(F.lit("desc "), F.col("p_type")).alias("value"),
        (k + F.lit(1000000000)).alias("seq"))
    rep = p.where(k % 18 == 0).select(
        F.col("p_brand").alias("catalog"), F.lit("ja").alias("lang"),
        F.concat(F.lit("part."), k.cast("string"), F.lit(".desc")).alias("key"),
        F.concat(F.lit("desc2 "), F.col("p_type")).alias("value"),
        (k + F.lit(2000000000)).alias("seq"))
    return upd.unionByName(new).unionByName(rep)


# R3 code files --------------------------------------------------------------

def code_files_from_parts(spark, sf_dir) -> DataFrame:
    """JSX-like files of at most 100 parts each (per brand and block of 100 keys).

    Each part gives a ``t('part.<k>.name')`` call line and an alert line.
    """
    p = table(spark, sf_dir, "part")
    line = F.concat(F.lit("const a = t('part."), F.col("p_partkey").cast("string"),
                    F.lit(".name');\nalert(\""), F.col("p_name"), F.lit("\")"))
    block = F.floor(F.col("p_partkey") / 100)
    files = (p.groupBy("p_brand", block.alias("blk"))
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("l")))),
                                           lambda x: x["l"]), "\n").alias("content")))
    return files.select(F.concat(F.lit("src/"), F.lower(F.regexp_replace("p_brand", "#", "_")),
                                 F.lit("/b"), F.col("blk").cast("string"), F.lit(".jsx")).alias("file"),
                        "content")


def document_files(spark, sf_dir) -> DataFrame:
    """Each document as a text file named ``<source>/<doc_id>``."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("file"),
                    F.col("text").alias("content"))


def part_word_keys(spark, sf_dir) -> DataFrame:
    """Search keys: the distinct words of part names."""
    p = table(spark, sf_dir, "part")
    return p.select(F.explode(F.split("p_name", " ")).alias("key")).distinct()


# R4 translation-memory pairs -------------------------------------------------

def conversation_pairs(spark, sf_dir) -> DataFrame:
    """Consecutive (user, assistant) turns as (source_text, translation) pairs in 4 languages."""
    c = table(spark, sf_dir, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("source_text"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("translation"))
    return (u.join(a, ["conv_id", "turn"])
            .select("conv_id", "turn",
                    F.concat(F.lit("l"), (F.col("conv_id") % 4).cast("string")).alias("lang"),
                    "source_text", "translation"))


# R5 glossary ----------------------------------------------------------------

def glossary_existing(spark, sf_dir) -> DataFrame:
    """Glossary rows: term = nation name, one translation per region name as the language."""
    n = table(spark, sf_dir, "nation").where(F.col("n_nationkey") < 20)
    r = table(spark, sf_dir, "region")
    j = n.join(r, n.n_regionkey == r.r_regionkey)
    return j.select(F.col("n_name").alias("term"),
                    F.create_map(F.lower("r_name"), F.concat(F.lit("g:"), F.col("n_name"))).alias("translations"),
                    F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("context"),
                    F.lit(None).cast("string").alias("notes"),
                    F.col("n_nationkey").cast("bigint").alias("seq"))


def glossary_incoming(spark, sf_dir) -> DataFrame:
    """Import records: lower-cased terms for nations 15 and up (15-19 collide with existing terms)."""
    n = table(spark, sf_dir, "nation").where(F.col("n_nationkey") >= 15)
    return n.select(F.lower("n_name").alias("term"),
                    F.concat(F.lit("i:"), F.lower("n_name")).alias("translation"),
                    F.when(F.col("n_nationkey") % 2 == 0, F.lit("imported")).alias("context"),
                    F.when(F.col("n_nationkey") % 3 == 0, F.lit("note")).alias("notes"),
                    (F.col("n_nationkey") + F.lit(100)).cast("bigint").alias("seq"))
