"""File sources and sinks: catalog trees, code trees, glossary files, import files.

All readers are lazy DataFrame scans; a missing optional input is an empty
DataFrame with the declared schema.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.catalog import Flattened, flatten_catalogs, nest_lines, path_conflicts
from ..operators.imports import GLOSSARY_FIELDS, TRANSLATION_FIELDS, json_translation_records, parse_delimited
from ..operators.usage import CONTEXT_EXCLUDES, CONTEXT_EXTENSIONS, path_filter
from ..session import path_exists
from .tree import Scan, can_list, scan, write_files

GLOSSARY_JSON = T.StructType([
    T.StructField("term", T.StringType()),
    T.StructField("translations", T.MapType(T.StringType(), T.StringType())),
    T.StructField("context", T.StringType()),
    T.StructField("notes", T.StringType()),
])


def _empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def _rel_path(root: str):
    base = root.rstrip("/") + "/"
    p = F.col("_metadata.file_path")
    # file paths come back as URIs (file:/...); strip everything up to the root folder
    return F.regexp_replace(p, "^.*?" + _re_escape(base.split("://")[-1].lstrip("/").replace("file:", "")), "")


def _re_escape(s: str) -> str:
    import re
    return re.escape(s)


def read_whole_files(spark: SparkSession, root: str, required: bool = False, suffixes: tuple[str, ...] = ()) -> Scan:
    """Every file under ``root`` (recursive, one row per file) with the unreadable ones apart; a missing root is empty.

    Files of any name are read (``sources.tree``). In a store that only
    Spark's readers can open they are Spark's: names that begin with '_' or
    '.' are then not seen, and an unreadable file fails the query.
    """
    if not path_exists(spark, root):
        if required:
            raise FileNotFoundError(root)
        string = lambda *names: T.StructType([T.StructField(n, T.StringType()) for n in names])
        return Scan(_empty(spark, string("path", "content")), _empty(spark, string("path", "reason")))
    if can_list(root):
        return scan(spark, root, suffixes)
    df = (spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "false")
          .option("ignoreMissingFiles", "false").text(root, wholetext=True))
    df = df.select(_rel_path(root).alias("path"), F.col("value").alias("content"))
    if suffixes:
        df = df.where(reduce(or_, [F.col("path").endswith(x) for x in suffixes]))
    return Scan(df, df.where(F.lit(False)).select("path", F.lit("").alias("reason")))


def _readable(found: Scan) -> DataFrame:
    """The files of a scan; an unreadable one fails the query."""
    bad = found.rejects.select("path", F.raise_error(F.concat_ws(": ", "path", "reason")).cast("string").alias("content"))
    return found.files.unionByName(bad)


def read_catalog_files(spark: SparkSession, root: str, required: bool = False) -> DataFrame:
    """``<root>/<catalog dirs>/<lang>.json`` -> ``(catalog, lang, json)``.

    A missing root is an empty relation unless ``required``.
    """
    return _catalog_documents(_readable(read_whole_files(spark, root, required, (".json",))))


def _catalog_documents(files: DataFrame) -> DataFrame:
    lang = F.regexp_extract("path", "([^/]+)\\.json$", 1)
    catalog = F.regexp_replace(F.regexp_extract("path", "(?s)^(.*)/[^/]+$", 1), "^$", ".")
    return files.select(catalog.alias("catalog"), lang.alias("lang"), F.col("content").alias("json"))


def read_catalogs(spark: SparkSession, root: str, required: bool = False, max_depth: int = 64) -> Flattened:
    """S1 + P1: catalog files flattened to entries; unparseable and unreadable files are in ``rejects``."""
    found = read_whole_files(spark, root, required, (".json",))
    flat = flatten_catalogs(_catalog_documents(found.files), max_depth=max_depth)
    bad = _catalog_documents(found.rejects.select("path", F.col("reason").alias("content")))
    return Flattened(flat.entries, flat.rejects.unionByName(bad.withColumnRenamed("json", "reason")))


def write_catalogs(entries: DataFrame, root: str, indent: int = 2, check_conflicts: bool = True) -> int:
    """One pretty-printed nested JSON document per catalog and language, at ``<root>/<catalog>/<lang>.json``.

    That is where ``read_catalogs`` finds it ('.' is the root itself). All
    documents are written before the first old file is replaced, so a failed
    job changes nothing and ``entries`` may come from the same root; other
    catalogs and languages stay. Refuses catalogs with path conflicts (P3):
    one bounded action. Returns the number of files.
    """
    if check_conflicts and path_conflicts(entries).limit(1).count() > 0:
        raise ValueError("catalog has path conflicts (a key is also a prefix of another key)")
    place = F.concat(F.when(F.col("catalog") == ".", "").otherwise(F.concat("catalog", F.lit("/"))), "lang", F.lit(".json"))
    return write_files(nest_lines(entries, indent=indent).select(place.alias("path"), "n", F.col("text").alias("content")), root, "n")


def write_entries(entries: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Flat Parquet catalog table, partitioned by language (the primary table format)."""
    (entries.write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy("lang").parquet(path))


def scan_code(spark: SparkSession, root: str, extensions=None, excludes=None) -> Scan:
    """Code files under ``root`` by extension and excluded folders, and those that could not be read."""
    found = read_whole_files(spark, root)
    keep = path_filter("path", extensions or CONTEXT_EXTENSIONS, excludes or CONTEXT_EXCLUDES)
    return Scan(found.files.where(keep), found.rejects.where(keep))


def read_code_files(spark: SparkSession, root: str, extensions=None, excludes=None) -> DataFrame:
    """``(file, content)`` of ``scan_code``; unreadable files are left out."""
    return scan_code(spark, root, extensions, excludes).files.select(F.col("path").alias("file"), "content")


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of entries -> ``(term, translations, context, notes, seq)``; missing file = empty."""
    if not path_exists(spark, path):
        return _empty(spark, T.StructType(GLOSSARY_JSON.fields + [T.StructField("seq", T.LongType())]))
    g = spark.read.schema(GLOSSARY_JSON).option("multiLine", "true").json(path)
    return g.withColumn("seq", F.monotonically_increasing_id())


def write_glossary(glossary: DataFrame, path: str) -> None:
    """The glossary as JSON lines in position order."""
    glossary.orderBy("seq").drop("seq").write.mode("overwrite").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines ``(file, seq, line)`` in file order (line mode, splittable)."""
    df = spark.read.text(path)
    return df.select(F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("_blk"),
                     F.monotonically_increasing_id().alias("_mid"), F.col("value").alias("line")).select(
        "file", F.struct("_blk", "_mid").alias("seq"), "line")


def read_translation_import(spark: SparkSession, path: str, fmt: str = "json",
                            dialect: str = "minimal") -> DataFrame:
    """Translation import records ``(key, value, seq)``."""
    if fmt == "csv":
        if dialect == "csv":
            return (spark.read.schema("key string, value string").csv(path)
                    .withColumn("seq", F.monotonically_increasing_id()))
        return parse_delimited(read_lines(spark, path), TRANSLATION_FIELDS).drop("file")
    docs = _readable(read_whole_files(spark, path, required=True)).select(F.col("content").alias("json"))
    return json_translation_records(docs).withColumnRenamed("pos", "seq")


def read_glossary_import(spark: SparkSession, path: str, fmt: str = "json",
                         dialect: str = "minimal") -> DataFrame:
    """Glossary import records ``(term, translation, context, notes, seq)``."""
    if fmt == "csv":
        if dialect == "csv":
            return (spark.read.schema("term string, translation string, context string, notes string").csv(path)
                    .withColumn("seq", F.monotonically_increasing_id()))
        return parse_delimited(read_lines(spark, path), GLOSSARY_FIELDS).drop("file")
    g = spark.read.schema("term string, translation string, context string, notes string").option(
        "multiLine", "true").json(path)
    return g.withColumn("seq", F.monotonically_increasing_id())
