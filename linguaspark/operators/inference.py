"""Model calls as batch-inference jobs: prompts, providers, reply parsing, batch stats.

Prompts are built with Spark expressions. A provider is either

* an *expression provider*: a function of columns returning a reply column
  (deterministic, runs JVM-side; the mock providers are of this kind), or
* a *Python provider*: a picklable callable ``f(list[str]) -> list[str]``
  called inside ``mapInPandas`` with per-row failure isolation. Its module
  must be importable on the executors (or registered with
  ``cloudpickle.register_pickle_by_value``), as for any Spark Python code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import col_, falsy, js_trim
from ..session import cut_lineage, path_exists

# ---------------------------------------------------------------------------
# Prompt texts and reply markers that must match the reference's.
# ---------------------------------------------------------------------------
TRANSLATE_HEAD = "Translate the following text from English to "
CONTEXT_HEAD = "Context: This text is used as a "
CONTEXT_TAIL = " in the application.\n\n"
SIMILAR_HEAD = "Here are some similar translations for reference:\n"
GLOSSARY_HEAD = "Please use the following glossary for consistent terminology:\n"
TRANSLATE_FOOT = "Provide only the translation without any additional text or explanations."
REVIEW_HEAD = "Review and improve the following translation from English to "
REVIEW_FOOT = ("If the translation is already good, return it unchanged. Otherwise, provide an improved version.\n"
               "Format your response as follows:\n"
               "IMPROVED: [your improved translation]\n"
               "CHANGES: [brief explanation of changes made, or \"No changes needed\" if unchanged]")
SYSTEM_MESSAGE = "You are a professional translator with expertise in localization."
TEMPERATURE = 0.2
IMPROVED_RE = "(?s)IMPROVED: (.*?)(?=\\nCHANGES:|\\z)"
CHANGES_RE = "(?s)CHANGES: (.*?)\\z"
NO_CHANGES = "No changes needed"
NO_CHANGES_PROVIDED = "No changes provided"
MOCK_REVIEW_CHANGES = "[MOCK] No changes needed"


def _context_part(context) -> Column:
    c = col_(context)
    return F.when(falsy(c), F.lit("")).otherwise(
        F.concat(F.lit(CONTEXT_HEAD), c, F.lit(CONTEXT_TAIL)))


def _glossary_part(glossary) -> Column:
    """``glossary``: array<struct<term, translation>> in prompt order (may be null)."""
    g = F.coalesce(col_(glossary), F.array().cast("array<struct<term:string,translation:string>>"))
    lines = F.transform(g, lambda x: F.concat(F.lit('- "'), x["term"], F.lit('" should be translated as "'),
                                              x["translation"], F.lit('"\n')))
    return F.when(F.size(g) > 0, F.concat(F.lit(GLOSSARY_HEAD), F.array_join(lines, ""), F.lit("\n"))
                  ).otherwise(F.lit(""))


def translation_prompt(text, lang, context=None, similar=None, glossary=None) -> Column:
    """The translation prompt.

    ``similar``: array<struct<source, translation, ...>> in rank order;
    ``glossary``: array<struct<term, translation>>.
    """
    parts = [F.lit(TRANSLATE_HEAD), col_(lang), F.lit(":\n\n"), col_(text), F.lit("\n\n")]
    if context is not None:
        parts.append(_context_part(context))
    if similar is not None:
        s = col_(similar)
        lines = F.transform(s, lambda x: F.concat(F.lit('- "'), x["source"], F.lit('" was translated as "'),
                                                  x["translation"], F.lit('"\n')))
        parts.append(F.when(F.size(s) > 0, F.concat(F.lit(SIMILAR_HEAD), F.array_join(lines, ""), F.lit("\n")))
                     .otherwise(F.lit("")))
    if glossary is not None:
        parts.append(_glossary_part(glossary))
    parts.append(F.lit(TRANSLATE_FOOT))
    return F.concat(*parts)


def review_prompt(source_text, current, lang, context=None, glossary=None) -> Column:
    """The review prompt."""
    parts = [F.lit(REVIEW_HEAD), col_(lang), F.lit(":\n\n"),
             F.lit("Original (English): "), col_(source_text), F.lit("\n"),
             F.lit("Current translation ("), col_(lang), F.lit("): "), col_(current), F.lit("\n\n")]
    if context is not None:
        parts.append(_context_part(context))
    if glossary is not None:
        parts.append(_glossary_part(glossary))
    parts.append(F.lit(REVIEW_FOOT))
    return F.concat(*parts)


def parse_review_reply(reply, existing) -> tuple[Column, Column]:
    """(improved, changes) from a review reply; empty parts fall back."""
    content = js_trim(F.coalesce(col_(reply), F.lit("")))
    improved = js_trim(F.regexp_extract(content, IMPROVED_RE, 1))
    changes = js_trim(F.regexp_extract(content, CHANGES_RE, 1))
    return (F.when(improved == "", col_(existing)).otherwise(improved),
            F.when(changes == "", F.lit(NO_CHANGES_PROVIDED)).otherwise(changes))


def is_improvement(changes) -> Column:
    """counted as improved unless the changes text is empty or exactly 'No changes needed'."""
    c = col_(changes)
    return c.isNotNull() & (c != "") & (c != NO_CHANGES)


# ---------------------------------------------------------------------------
# M4 mock providers (pure expressions)
# ---------------------------------------------------------------------------


def mock_translate(text, lang) -> Column:
    return F.concat(F.lit("["), col_(lang), F.lit("] "), col_(text))


def mock_review_reply(current) -> Column:
    """A reply the parser turns into (current, '[MOCK] No changes needed')."""
    return F.concat(F.lit("IMPROVED: "), col_(current), F.lit("\nCHANGES: " + MOCK_REVIEW_CHANGES))


# ---------------------------------------------------------------------------
# M1/M2/M5 calling a provider over a table of prompts
# ---------------------------------------------------------------------------


def _python_call(df: DataFrame, fn: Callable[[list[str]], list[str]], prompt_col: str,
                 out_col: str, max_parallel: int | None, at_once: int) -> DataFrame:
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out_col, T.StringType()),
                                                    T.StructField("error", T.StringType())])
    if max_parallel:
        df = df.repartition(max_parallel)

    def run(batches):
        for pdf in batches:
            prompts = pdf[prompt_col].tolist()
            replies, errors = [None] * len(prompts), [None] * len(prompts)
            todo = [(i, min(i + at_once, len(prompts))) for i in range(0, len(prompts), at_once)][::-1]
            while todo:
                lo, hi = todo.pop()
                try:
                    got = list(fn(prompts[lo:hi]))
                    if len(got) != hi - lo:
                        raise ValueError("provider returned a different number of replies")
                    replies[lo:hi] = [None if r is None else str(r).strip() for r in got]
                except Exception as e:  # noqa: BLE001  halve until the failing row stands alone: its failure is data
                    if hi - lo == 1:
                        errors[lo] = f"{type(e).__name__}: {e}"
                    else:
                        mid = (lo + hi) // 2
                        todo += [(mid, hi), (lo, mid)]
            yield pdf.assign(**{out_col: replies, "error": errors})

    return df.mapInPandas(run, schema)


def call_provider(df: DataFrame, provider, prompt_col: str = "prompt", out_col: str = "reply",
                  max_parallel: int | None = None, at_once: int = 256) -> DataFrame:
    """Add ``out_col`` (the reply) and ``error`` (null when the call succeeded).

    ``provider`` is a function of the frame's columns returning a reply
    column (expression provider: tag it with ``provider.expression = True``),
    or a Python batch callable run in ``mapInPandas``. ``max_parallel``
    caps concurrent provider calls (one task per slot), ``at_once`` the
    prompts of one call; a call that fails is repeated in halves.
    """
    if getattr(provider, "expression", False):
        err = provider.error(df) if provider.error else F.lit(None).cast("string")
        return (df.withColumn("error", err)
                .withColumn(out_col, F.when(F.col("error").isNull(), provider(df))))
    return _python_call(df, provider, prompt_col, out_col, max_parallel, at_once)


def call_durably(df: DataFrame, provider, ledger: str, prompt_col: str = "prompt", out_col: str = "reply",
                 slices: int = 16, attempts: int = 3, **options) -> DataFrame:
    """``call_provider`` through a ledger: a prompt that was answered once is never sent again.

    The ledger is a table of (prompt_hash, reply, error) in the folder
    ``ledger``, which outlives the run. Distinct prompts without an answer
    there are cut into ``slices`` by hash; each slice is called and written
    before the next, so a run that is broken off loses one slice at most and
    the next run goes on from there. A slice whose job fails is tried
    ``attempts`` times by itself. Failed prompts are kept with their error and
    sent again by the next run. Equal prompts share one call. The hash is
    SHA-256 of the prompt: use one ledger for one provider. A null prompt is
    never sent; its error is 'no prompt'.
    """
    if getattr(provider, "expression", False):  # computed, not called
        return call_provider(df, provider, prompt_col, out_col, **options)
    spark = df.sparkSession
    schema = "prompt_hash string, reply string, error string, at long"

    def read() -> DataFrame:
        return spark.read.schema(schema).parquet(ledger) if path_exists(spark, ledger) else spark.createDataFrame([], schema)

    answered = read().where("error is null").select("prompt_hash").distinct()
    prompts = (with_prompt_hash(df.select(F.col(prompt_col).alias("prompt")).where("prompt is not null").distinct())
               .join(answered, "prompt_hash", "left_anti")
               .withColumn("slice", F.pmod(F.xxhash64("prompt_hash"), F.lit(slices)).cast("int")))
    todo = cut_lineage(prompts, "prompts")
    for row in todo.select("slice").distinct().orderBy("slice").collect():  # at most ``slices`` rows
        part = todo.where(F.col("slice") == row["slice"])
        for attempt in range(attempts):
            try:
                called = call_provider(part, provider, "prompt", "reply", **options)
                (called.select("prompt_hash", "reply", "error", F.unix_micros(F.current_timestamp()).alias("at"))
                 .write.mode("append").parquet(ledger))
                break
            except Exception:  # the job of this slice: nothing of it was written
                if attempt == attempts - 1:
                    raise
    best = read().groupBy("prompt_hash").agg(F.max_by(F.struct("reply", "error"), F.struct(F.col("error").isNull(), "at")).alias("_r"))
    out = with_prompt_hash(df, prompt_col).join(best, "prompt_hash", "left")
    error = F.when(F.col(prompt_col).isNull(), "no prompt").otherwise(F.col("_r.error"))
    return out.select(*df.columns, F.col("_r.reply").alias(out_col), error.alias("error"))


def expression_provider(fn: Callable[[DataFrame], Column],
                        error: Callable[[DataFrame], Column] | None = None):
    """Tag ``fn`` as an expression provider; ``error`` gives a per-row failure message (null = ok)."""
    fn.expression = True
    fn.error = error
    return fn


class MockTranslator:
    """M4 as a Python batch provider: ``[lang] text`` for every input text."""

    def __init__(self, lang: str, fail_if=None):
        self.lang, self.fail_if = lang, fail_if

    def __call__(self, texts: list[str]) -> list[str]:
        out = []
        for t in texts:
            if self.fail_if is not None and self.fail_if(t):
                raise RuntimeError("provider failed")
            out.append(f"[{self.lang}] {t}")
        return out


def skip_done(todo: DataFrame, done: DataFrame | None, keys: list[str]) -> DataFrame:
    """H8: leave out rows whose result is already stored, so a rerun only does missing work."""
    if done is None:
        return todo
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def with_prompt_hash(df: DataFrame, prompt_col: str = "prompt") -> DataFrame:
    return df.withColumn("prompt_hash", F.sha2(F.col(prompt_col), 256))


# ---------------------------------------------------------------------------
# A4 / A5 counts
# ---------------------------------------------------------------------------


def batch_stats(results: DataFrame, group_cols=("catalog", "lang", "batch_id")) -> DataFrame:
    """A5: successes and errors per batch."""
    return results.groupBy(*group_cols).agg(
        F.count_if(F.col("error").isNull()).alias("n_ok"),
        F.count_if(F.col("error").isNotNull()).alias("n_error"))


def review_change_counts(reviews: DataFrame, group_cols=("catalog", "lang")) -> DataFrame:
    """A4: reviewed and improved counts."""
    ok = reviews.where(F.col("error").isNull())
    return ok.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_reviewed"),
        F.count_if(is_improvement("changes")).alias("n_improved"))


def result_rows(df: DataFrame, original: str, translated: str, is_new: bool,
                changes: str | None = None) -> DataFrame:
    """Result rows (original, translated, is_new[, changes])."""
    cols = [F.col(original).alias("original"), F.col(translated).alias("translated"),
            F.lit(is_new).alias("is_new")]
    if changes:
        cols.append(F.col(changes).alias("changes"))
    return df.select(*[c for c in df.columns if c not in (original, translated, changes)], *cols)
