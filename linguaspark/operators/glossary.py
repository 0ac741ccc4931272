"""Glossary operators: upsert, remove, per-language view, search, prompt lists, apply.

A glossary is rows ``(term, translations map<lang,string>, context, notes,
seq)``; ``seq`` is the entry's position, of any type ``functions.order``
takes (merges give its own). The long form
``(term, lang, translation, seq)`` is what joins use.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import on_side
from ..functions.text import falsy, integer_like
from .usage import spread, substring_join


def to_long(glossary: DataFrame) -> DataFrame:
    """``(term, lang, translation, seq, lpos)``: one row per translation; lpos = position in the map."""
    return glossary.select("term", "seq", F.posexplode(F.map_entries("translations")).alias("lpos", "e")).select(
        "term", F.col("e.key").alias("lang"), F.col("e.value").alias("translation"), "seq", "lpos")


def import_records_to_entries(records: DataFrame, lang: str) -> DataFrame:
    """Glossary import records -> entries for one language; invalid rows dropped.

    context/notes are kept only when supplied (non-empty).
    """
    ok = records.where(~(falsy("term") | falsy("translation")))
    return ok.select("term", F.create_map(F.lit(lang), F.col("translation")).alias("translations"),
                     F.when(~falsy("context"), F.col("context")).alias("context"),
                     F.when(~falsy("notes"), F.col("notes")).alias("notes"), "seq")


def upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge entries case-insensitively on the term, incoming always wins.

    The term takes the latest spelling, translations merge per language with
    the latest winning, context and notes change only when supplied, and the
    merged entry keeps the position of its first occurrence; new terms come
    last. ``seq`` orders rows within its own side only, so the two sides may
    number alike or with different types.
    """
    def side(df: DataFrame, no: int) -> DataFrame:
        return df.select("term", "translations", "context", "notes", on_side(df, "seq", no).alias("seq"))

    both = side(existing, 0).unionByName(side(incoming, 1))
    both = both.withColumn("lterm", F.lower("term"))
    attrs = both.groupBy("lterm").agg(
        F.max_by("term", "seq").alias("term"),
        F.max_by("context", F.when(F.col("context").isNotNull(), F.col("seq"))).alias("context"),
        F.max_by("notes", F.when(F.col("notes").isNotNull(), F.col("seq"))).alias("notes"),
        F.min("seq").alias("seq"))
    tr = (to_long(both.drop("lterm")).withColumn("lterm", F.lower("term"))
          .groupBy("lterm", "lang").agg(F.max_by("translation", "seq").alias("translation"),
                                        F.min(F.struct("seq", "lpos")).alias("first")))
    maps = tr.groupBy("lterm").agg(F.map_from_entries(F.transform(
        F.array_sort(F.collect_list(F.struct("first", "lang", "translation"))),
        lambda x: F.struct(x["lang"], x["translation"]))).alias("translations"))
    return attrs.join(maps, "lterm").select("term", "translations", "context", "notes", "seq")


def remove(glossary: DataFrame, terms: DataFrame, term_col: str = "term") -> DataFrame:
    """Drop entries whose term equals one of ``terms`` ignoring case (left anti)."""
    gone = terms.select(F.lower(F.col(term_col)).alias("_lt")).distinct()
    return glossary.withColumn("_lt", F.lower("term")).join(gone, "_lt", "left_anti").drop("_lt")


def for_language(glossary: DataFrame, langs: list[str] | None = None) -> DataFrame:
    """``(lang, term, translation, seq)`` for non-empty translations; a repeated term keeps the last."""
    lg = to_long(glossary).where(~falsy("translation"))
    if langs is not None:
        lg = lg.where(F.col("lang").isin(langs))
    return (lg.groupBy("lang", "term").agg(F.max_by("translation", "seq").alias("translation"),
                                           F.min("seq").alias("seq")))


def prompt_lists(glossary: DataFrame, langs: list[str] | None = None) -> DataFrame:
    """One row per language, ``glossary`` = array<struct<term, translation>> in prompt order.

    Prompt order is object member order: index-like terms ascending, then
    first insertion. The list is the whole language's glossary, as every
    prompt carries it; it is joined to prompts on ``lang``.
    """
    fl = for_language(glossary, langs)
    order = F.struct((~integer_like("term")).alias("a"),
                     F.when(integer_like("term"), F.col("term").cast("bigint")).alias("b"), F.col("seq").alias("c"))
    return fl.groupBy("lang").agg(F.transform(
        F.array_sort(F.collect_list(F.struct(order.alias("o"), "term", "translation"))),
        lambda x: F.struct(x["term"].alias("term"), x["translation"].alias("translation"))).alias("glossary"))


def search(glossary: DataFrame, query: str) -> DataFrame:
    """entries whose term or any translation contains ``query`` ignoring case; '' matches all."""
    q = F.lit(query.lower())
    hit = F.lower("term").contains(q) | F.exists(F.map_values("translations"), lambda x: F.lower(x).contains(q))
    return glossary.where(hit)


def search_many(glossary: DataFrame, queries: DataFrame, query_col: str = "query") -> DataFrame:
    """F6 for a table of queries: ``(query, entry...)`` pairs, by the exact substring join.

    Term and translations are lower-cased texts; a query matches an entry
    when any of them contains it. An empty query matches every entry: its
    rows (one per distinct empty query, so one) are the glossary itself.
    """
    texts = (glossary.select("term", F.lower("term").alias("text"))
             .unionByName(to_long(glossary).select("term", F.lower("translation").alias("text"))))
    qs = queries.select(F.lower(F.col(query_col)).alias("needle"), F.col(query_col).alias("query"))
    hits = substring_join(qs, spread(texts), needle_col="needle", hay_col="text").select("query", "term").distinct()
    empty = qs.where(F.col("query") == "").select("query").distinct().withColumn("all", F.lit(1))
    every = glossary.withColumn("all", F.lit(1)).join(F.broadcast(empty), "all").select("query", *glossary.columns)  # one row at most
    return hits.join(glossary, "term").select("query", *glossary.columns).unionByName(every)


def find_term(glossary: DataFrame, lookups: DataFrame, col: str = "query") -> DataFrame:
    """Exact, case-insensitive term lookup (equi-join on lower(term))."""
    return (lookups.select(F.col(col).alias("query"), F.lower(F.col(col)).alias("_lt"))
            .join(glossary.withColumn("_lt", F.lower("term")), "_lt").drop("_lt"))


def _fold(s: str) -> str:
    """Lower case, character by character, so that places in the folded text are places in the text."""
    low = s.lower()
    return low if len(low) == len(s) else "".join(x if len(x := c.lower()) == 1 else c for c in s)


def _wordy(c: str) -> bool:
    return c.isalnum() or c == "_"


def replace_terms(text: str, folded: str, matches: list[tuple[int, int]], translation: dict[str, str]) -> str:
    """``text`` with the leftmost, then longest of the word-bounded ``matches`` (start, end) replaced, in one pass."""
    out, at = [], 0
    for start, end in sorted(matches, key=lambda m: (m[0], -m[1])):
        if start < at or start and _wordy(text[start - 1]) and _wordy(text[start]) or \
                end < len(text) and _wordy(text[end - 1]) and _wordy(text[end]):
            continue
        new = translation.get(folded[start:end])
        if new is not None:
            out += [text[at:start], new]
            at = end
    return "".join([*out, text[at:]])


def apply_terms(texts: DataFrame, glossary_long: DataFrame, text_col: str = "text", id_col: str = "id",
                lang_col: str | None = None) -> DataFrame:
    """Replace glossary terms in a text column: whole words, ignoring case, leftmost then longest first.

    ``glossary_long``: ``(term, translation[, seq][, lang])``; of translations
    of one term the one of the last ``seq`` counts (without ``seq``, the
    greatest). With ``lang_col`` a text meets the terms of its own language.

    Which terms a text contains comes from the exact substring join, so no
    task ever needs a whole glossary. The terms of one Arrow batch then make
    one Aho-Corasick automaton, each text is read once, and what was put in
    is never read again. A match is whole words if no word character touches
    a word character at its edges. Null texts stay null.
    """
    langs = ["lang"] if lang_col else []
    last = F.struct(*(["seq"] if "seq" in glossary_long.columns else []), "translation")
    g = (glossary_long.where(~falsy("term")).groupBy(F.lower("term").alias("needle"), *langs)
         .agg(F.max_by(F.struct("term", "translation"), last).alias("t")).select("needle", *langs, "t.term", "t.translation"))
    lt = texts.select(id_col, *([F.col(lang_col).alias("_tlang")] if lang_col else []), F.lower(F.col(text_col)).alias("_low"))
    cands = substring_join(g, spread(lt), needle_col="needle", hay_col="_low")
    if lang_col:
        cands = cands.where(F.col("lang") == F.col("_tlang"))
    per = cands.groupBy(id_col).agg(F.collect_set(F.struct("term", "translation")).alias("_c"))  # bounded by one text

    @F.pandas_udf("string")
    def applied(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import ahocorasick
        for text, cands_ in batches:
            own = [{} if c is None else {_fold(x["term"]): x["translation"] for x in c} for c in cands_]
            finder = ahocorasick.Automaton()
            for term in {t for o in own for t in o}:
                finder.add_word(term, len(term))
            if len(finder):
                finder.make_automaton()
            out = []
            for t, o in zip(text, own, strict=True):
                if o:
                    folded = _fold(t)
                    t = replace_terms(t, folded, [(e + 1 - n, e + 1) for e, n in finder.iter(folded)], o)
                out.append(t)
            yield pd.Series(out, dtype=object)

    j = texts.join(per, id_col, "left")
    return j.select(id_col, text_col, applied(F.col(text_col), F.col("_c")).alias("applied"))


def relevant_lists(texts: DataFrame, glossary: DataFrame, id_col: str = "_qid", text_col: str = "value") -> DataFrame:
    """J12 option: per text, only the glossary terms of its language that occur in it (case-insensitive).

    ``texts``: ``(id, lang, text)``. Found by the exact substring join (no
    cross join); each list is bounded by what one text contains. Prompt
    order as in ``prompt_lists``. Texts without a term get no row.
    """
    fl = for_language(glossary).select("lang", "term", "translation", "seq",
                                       F.lower("term").alias("needle"))
    t = texts.select(id_col, F.col("lang").alias("_tlang"), F.lower(text_col).alias("_low"))
    hits = (substring_join(fl, spread(t), needle_col="needle", hay_col="_low")
            .where(F.col("lang") == F.col("_tlang")))
    order = F.struct((~integer_like("term")).alias("a"),
                     F.when(integer_like("term"), F.col("term").cast("bigint")).alias("b"), F.col("seq").alias("c"))
    return hits.groupBy(id_col).agg(F.transform(
        F.array_sort(F.collect_list(F.struct(order.alias("o"), "term", "translation"))),
        lambda x: F.struct(x["term"].alias("term"), x["translation"].alias("translation"))).alias("glossary"))
