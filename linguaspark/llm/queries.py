"""The registered queries of the llm operators, and SQL for those that SQL can express.

Each query applies its operator to its whole table and derives the digest
columns from what the operator returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linguaspark.llm import ann, decontaminate, dialogue, html, langid, ngram_join, pieces, quality, runs, secrets, sharding, suffixes, toxicity


# Handed to Python at once; texts may be long, and the defaults (10,000 rows, 64 MB) are meant for short rows.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def small_batches(spark: SparkSession) -> None:
    """From here on the session hands at most ``BATCH`` rows and bytes (or one row) to Python at once."""
    for key, value in BATCH.items():
        spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; also sets ``small_batches``."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file, the default of the operators' path parameters here."""
    import public_tokenizers
    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shuffle_shards(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", sharding.record_size(F.col("text")).alias("size"),
                      F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
                      F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), split_pattern())
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(table(spark, sf_dir, "documents")).drop("kept")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"),
                         with_ids=False, with_text=False)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.join(table(spark, sf_dir, "documents"), k=3, num=90, den=100)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    planted = docs.select("doc_id", runs.plant(F.col("text"), F.col("doc_id")).alias("text"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return runs.find(planted).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair(dialogue.damage(table(spark, sf_dir, "conversations")), copies="copies")[0]


QUERIES = {f.__name__: f for f in (op1_sharding, op2_secrets, op3_decontamination, op4_html, op5_suffix_dedup, op6_pieces,
                                   op7_ngram_join, op8_quality, op9_neighbours, op10_langid, op11_runs,
                                   op12_toxicity, op13_dialogue)}

_SHINGLES = """
words AS (
    SELECT {id} AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}),
shingles AS (
    SELECT DISTINCT id, list_aggregate(w[i:i + {k} - 1], 'string_agg', ' ') AS s
    FROM (SELECT id, w, unnest(range(1, greatest(1, len(w) - {k} + 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id)"""

ORACLE = {
    "op7_ngram_join": "WITH RECURSIVE " + _SHINGLES.format(id="doc_id", table="documents", k=3) + """,
common AS (
    SELECT a.id AS a, b.id AS b, count(*) AS o FROM shingles a JOIN shingles b ON a.s = b.s AND a.id <> b.id
    GROUP BY a.id, b.id),
links AS (
    SELECT a, b FROM common JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b
    WHERE 100 * o >= 90 * (x.n + y.n - o)),
reach(id, other) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN sizes z ON z.id = d.doc_id
JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) m ON m.id = d.doc_id""",

    "op3_decontamination": "WITH " + _SHINGLES.format(id="doc_id", table="documents", k=5) + ", " +
    _SHINGLES.format(id="item_id", table="benchmark", k=5)
    .replace("words", "item_words").replace("shingles", "item_shingles").replace("sizes", "item_sizes") + """
SELECT d.id AS doc_id, i.id AS item_id, z.n AS n_shingles, count(*) AS n_shared, count(*) / z.n AS containment
FROM shingles d JOIN item_shingles i ON d.s = i.s JOIN item_sizes z ON z.id = i.id
GROUP BY d.id, i.id, z.n HAVING count(*) >= 0.8 * z.n""",
}
