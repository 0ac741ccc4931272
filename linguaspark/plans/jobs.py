"""The user-level jobs: translate, review, import, build the memory, search.

Each job takes DataFrames and returns lazy DataFrames; writing is left to
the caller (``sources.files`` / ``sources.memory_store``). With one catalog
and one language the results equal a single-file run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import falsy
from ..operators import catalog as C
from ..operators import glossary as G
from ..operators import inference as I
from ..operators import memory as M
from ..operators import usage as U
from ..operators.windows import batch_numbers
from ..schemas import ENTRY_KEYS
from ..session import cut_lineage

SIMILAR_T = "array<struct<source:string,translation:string,similarity:double>>"


def mock_translation_provider():
    return I.expression_provider(lambda df: I.mock_translate(df["value"], df["lang"]))


def mock_review_provider():
    return I.expression_provider(lambda df: I.mock_review_reply(df["target_value"]))


def _entry_id(df: DataFrame) -> F.Column:
    return F.concat_ws("\u0001", "catalog", "lang", "key")


def _called(todo: DataFrame, provider, out_col: str, max_parallel: int | None, ledger: str | None) -> DataFrame:
    if ledger:
        return I.call_durably(todo, provider, ledger, out_col=out_col, max_parallel=max_parallel)
    return I.call_provider(todo, provider, out_col=out_col, max_parallel=max_parallel)


@dataclass
class TranslateResult:
    entries: DataFrame       # the catalog after the merge (target rows, then new rows)
    results: DataFrame       # one row per worked key, with prompt, translated, error, batch_id
    memory_rows: DataFrame   # TM rows for the new translations, with vectors


def translate(source: DataFrame, target: DataFrame, langs: list[str] | None = None, provider=None, *,
              glossary: DataFrame | None = None, memory: DataFrame | None = None, embedder=None,
              code_files: DataFrame | None = None, context: str | None = None, k_similar: int = 3,
              batch_size: int = 5, max_parallel: int | None = None, rounds: int = 1,
              glossary_scope: str = "all", ledger: str | None = None) -> TranslateResult:
    """Translate the keys missing from the target catalogs.

    Context per key: ``context`` if given (even empty), else the entry's own;
    with ``code_files`` the key's usage description is appended (per key,
    not per run). Similar translations come from ``memory`` (k-NN in the
    same language), the glossary list of the language goes into every prompt.

    ``glossary_scope="relevant"`` puts into each prompt only the terms its
    text contains (bounded per row) instead of the language's whole glossary.

    ``rounds`` > 1 feeds the memory between rounds (H2): batches are split
    into ``rounds`` contiguous groups per catalog, and each round's lookups
    see the translations of the earlier rounds. Lineage is cut per round.

    With a ``ledger`` folder every answered prompt is kept there, and a run
    that is repeated, after a failure say, sends only what is missing.
    """
    provider = provider or mock_translation_provider()
    missing = cut_lineage(C.missing_entries(source, target, langs), "missing")  # worked on, and merged in the end
    cols = ["value", "ord"] + (["context"] if "context" in missing.columns else [])
    # The work list is materialised once: it feeds several lookups and the
    # (expensive) provider calls must never be recomputed.
    todo = cut_lineage(C.last_wins(missing.select(*ENTRY_KEYS, *cols)))
    if context is not None:
        todo = todo.withColumn("context", F.lit(context))
    elif "context" not in todo.columns:
        todo = todo.withColumn("context", F.lit(None).cast("string"))
    if code_files is not None:
        keys = todo.select("key").distinct()
        texts = U.context_text(keys, U.key_contexts(keys, code_files))
        todo = (todo.join(texts, "key", "left")
                .withColumn("context", U.combine_context(F.col("context"), F.col("text"))).drop("text"))
    todo = todo.withColumn("_qid", _entry_id(todo))
    if glossary is not None and glossary_scope == "relevant":
        todo = todo.join(G.relevant_lists(todo.select("_qid", "lang", "value"), glossary), "_qid", "left")
    elif glossary is not None:
        todo = todo.join(G.prompt_lists(glossary, langs), "lang", "left")
    else:
        todo = todo.withColumn("glossary", F.lit(None).cast("array<struct<term:string,translation:string>>"))
    todo = batch_numbers(todo, ["catalog", "lang"], "ord", batch_size)
    if rounds > 1:
        nb = todo.groupBy("catalog", "lang").agg(F.max("batch_id").alias("_nb"))
        todo = cut_lineage(todo.join(nb, ["catalog", "lang"]).withColumn(
            "_round", F.floor((F.col("batch_id") - 1) * rounds / F.col("_nb")).cast("int")).drop("_nb"), "todo")
    else:
        todo = todo.withColumn("_round", F.lit(0))
    parts = []
    for r in range(rounds):
        part = todo.where(F.col("_round") == r)
        if memory is not None:
            q = M.embed(part.select("_qid", "lang", "value"), "value", embedder)
            hits = M.knn(q, memory, k_similar, part_col="lang", query_id="_qid", memory_id="id")
            part = M.attach_similar(part, hits, memory, entry_id="_qid")
        else:
            part = part.withColumn("similar", F.array().cast(SIMILAR_T))
        part = part.withColumn("prompt", I.translation_prompt("value", "lang", "context", "similar", "glossary"))
        res = cut_lineage(_called(part, provider, "translated", max_parallel, ledger), "results")
        parts.append(res)
        if memory is not None and r < rounds - 1:
            fresh = _memory_rows(res, F.lit(r), embedder)
            memory = cut_lineage(M.upsert_latest(memory.unionByName(fresh, allowMissingColumns=True)
                                                 .select(*memory.columns)), "memory")
    results = parts[0]
    for p_ in parts[1:]:
        results = results.unionByName(p_)
    merged = C.merge_translations(target, missing, results.select(*ENTRY_KEYS, "translated", "error"))
    return TranslateResult(merged, results.drop("_qid", "_round"), _memory_rows(results, F.col("_round"), embedder))


def _memory_rows(results: DataFrame, round_no: Column, embedder=None) -> DataFrame:
    """TM rows, with vectors, for successful results; ``seq`` = job time (us) + round, so they win over older writes."""
    ok = results.where(F.col("error").isNull())
    seq = F.unix_micros(F.current_timestamp()) + round_no
    rows = M.tm_rows(ok.select("lang", F.col("value").alias("source_text"),
                               F.col("translated").alias("translation"), "context",
                               seq.cast("bigint").alias("seq")), seq="seq")
    return M.embed(rows.drop("embedding"), "source_text", embedder)


@dataclass
class ReviewResult:
    entries: DataFrame
    results: DataFrame
    counts: DataFrame
    memory_rows: DataFrame


def review(source: DataFrame, target: DataFrame, langs: list[str] | None = None, provider=None, *,
           glossary: DataFrame | None = None, context: str | None = None, all_keys: bool = False,
           max_parallel: int | None = None, glossary_scope: str = "all", embedder=None,
           ledger: str | None = None) -> ReviewResult:
    """Review outdated keys (or every key present in both with ``all_keys``) and merge improvements.

    Context per key: ``context`` if given (even empty), else the source entry's own, else the target entry's.
    ``ledger`` as in ``translate``.
    """
    provider = provider or mock_review_provider()
    pairs = (C.reviewed_pairs if all_keys else C.outdated_pairs)(source, target, langs)
    own = ["context"] if "context" in pairs.columns else []
    todo = C.last_wins(pairs.select(*ENTRY_KEYS, "source_value", "target_value", *own,
                                    F.col("source_ord").alias("ord")))
    if context is not None or not own:
        todo = todo.withColumn("context", F.lit(context).cast("string"))
    if glossary is not None and glossary_scope == "relevant":
        todo = todo.withColumn("_qid", _entry_id(todo))
        todo = todo.join(G.relevant_lists(todo.select("_qid", "lang", "source_value"), glossary,
                                          text_col="source_value"), "_qid", "left").drop("_qid")
    elif glossary is not None:
        todo = todo.join(G.prompt_lists(glossary, langs), "lang", "left")
    else:
        todo = todo.withColumn("glossary", F.lit(None).cast("array<struct<term:string,translation:string>>"))
    todo = todo.withColumn("prompt", I.review_prompt("source_value", "target_value", "lang", "context", "glossary"))
    replied = cut_lineage(_called(todo, provider, "reply", max_parallel, ledger))
    improved, changes = I.parse_review_reply("reply", "target_value")
    results = replied.withColumn("translated", improved).withColumn("changes", changes)
    merged = C.merge_reviews(target, results.select(*ENTRY_KEYS, "translated", "error"))
    changed = results.where(F.col("error").isNull() & (F.col("translated") != F.col("target_value")))
    mem_rows = M.embed(M.tm_rows(changed.select("lang", F.col("source_value").alias("source_text"),
                                                F.col("translated").alias("translation"), "context",
                                                F.unix_micros(F.current_timestamp()).alias("seq")), seq="seq")
                       .drop("embedding"), "source_text", embedder)
    return ReviewResult(merged, results, I.review_change_counts(results), mem_rows)


@dataclass
class ImportResult:
    entries: DataFrame
    counts: DataFrame
    rejects: DataFrame


def import_translations(existing: DataFrame, records: DataFrame, catalog: str | None = None,
                        lang: str | None = None) -> ImportResult:
    """Upsert import records ``(key, value, seq)`` into catalogs; count added/updated/skipped."""
    rec = records
    if catalog is not None:
        rec = rec.withColumn("catalog", F.lit(catalog))
    if lang is not None:
        rec = rec.withColumn("lang", F.lit(lang))
    _, rejects = C.split_valid_records(rec)
    return ImportResult(C.upsert_entries(existing, rec), C.import_counts(existing, rec), rejects)


def import_glossary(glossary: DataFrame, records: DataFrame, lang: str) -> tuple[DataFrame, DataFrame]:
    """Upsert glossary import records under ``lang``; returns (glossary, counts)."""
    entries = G.import_records_to_entries(records, lang)
    counts = records.agg(F.count_if(~(falsy("term") | falsy("translation"))).alias("n_imported"),
                         F.count_if(falsy("term") | falsy("translation")).alias("n_skipped"))
    return G.upsert(glossary, entries), counts


def build_memory(source: DataFrame, target: DataFrame, langs: list[str] | None = None, *,
                 context: str | None = None, embedder=None, batch_size: int = 50) -> tuple[DataFrame, DataFrame]:
    """Pairs of keys present in both -> embedded TM rows keyed by id (later writes win);
    plus per-batch success counts."""
    pairs = M.paired_entries(source, target, langs)
    pairs = batch_numbers(pairs, ["catalog", "lang"], "ord", batch_size)
    # the last pair of a text wins here; against other writes the time of this job counts
    last = pairs.groupBy("lang", "source_text").agg(F.max_by("translation", F.struct("ord", "catalog", "key")).alias("translation"))
    rows = M.tm_rows(last.select("*", F.unix_micros(F.current_timestamp()).alias("seq"),
                                 *([F.lit(context).alias("context")] if context else [])), seq="seq")
    rows = M.embed(rows.drop("embedding"), "source_text", embedder)
    stats = pairs.withColumn("error", F.lit(None).cast("string"))
    return rows, I.batch_stats(stats)


def search(memory: DataFrame, queries: DataFrame, embedder=None, k: int = 5) -> DataFrame:
    """Queries ``(query_id, lang, text)`` -> best k TM hits in the same language with percent scores."""
    q = M.embed(queries, "text", embedder)
    hits = M.search_top(q, memory, k, part_col="lang", query_id="query_id", memory_id="id")
    return hits.join(memory.select(F.col("id").alias("hit_id"), "source_text", "translation"), "hit_id")
