"""Declared schemas of the library's tables."""

from __future__ import annotations

from pyspark.sql import types as T

# One flat catalog entry. ``ord`` is the entry's position in its catalog
# (any orderable type); it stands in for array order everywhere.
ENTRY = T.StructType([
    T.StructField("catalog", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("ord", T.LongType()),
])

# One catalog document (a nested JSON text) per (catalog, lang).
CATALOG_FILE = T.StructType([
    T.StructField("catalog", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("json", T.StringType()),
])

GLOSSARY = T.StructType([
    T.StructField("term", T.StringType()),
    T.StructField("translations", T.MapType(T.StringType(), T.StringType())),
    T.StructField("context", T.StringType()),
    T.StructField("notes", T.StringType()),
])

GLOSSARY_IMPORT = T.StructType([
    T.StructField("term", T.StringType()),
    T.StructField("translation", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("notes", T.StringType()),
])

TRANSLATION_IMPORT = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
])

# Translation memory row; stored partitioned by ``lang``.
TM = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("source_text", T.StringType()),
    T.StructField("translation", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("seq", T.LongType()),
])

CODE_FILE = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("content", T.StringType()),
])

ENTRY_KEYS = ["catalog", "lang", "key"]
