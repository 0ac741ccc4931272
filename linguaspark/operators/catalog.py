"""Catalog operators: dedupe, diff, merges, upsert, flatten and nest.

Entries are rows ``(catalog, lang, key, value, ord)``; ``ord`` carries the
entry order a list would have: readers and merges give ``functions.order``'s
type, inputs may have any that it takes. A ``context`` column, where there is
one, stays with its row. Every function takes and returns DataFrames.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.order import on_side, step
from ..functions.text import falsy, integer_like, json_string_literal
from ..schemas import ENTRY_KEYS
from ..session import cut_lineage
from .windows import row_numbers

# ---------------------------------------------------------------------------
# A7 last-wins dedupe
# ---------------------------------------------------------------------------


def last_wins(entries: DataFrame, keys=ENTRY_KEYS, order: str = "ord",
              first_position: str | None = None) -> DataFrame:
    """Keep, per key, the row with the greatest ``order`` (later writes win).

    ``max_by`` is a partial aggregate, so duplicates of a hot key are combined
    map-side before the shuffle. With ``first_position`` the smallest order of
    the key is kept too (where the key was first created).
    """
    keys = list(keys)
    rest = [c for c in entries.columns if c not in keys]
    aggs = [F.max_by(F.struct(*rest), F.col(order)).alias("_last")]
    if first_position:
        aggs.append(F.min(order).alias(first_position))
    out = entries.groupBy(*keys).agg(*aggs)
    tail = [first_position] if first_position else []
    return out.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest], *tail)


# ---------------------------------------------------------------------------
# Diff: J1 missing, J2 outdated, J3 reviewable, A1 coverage
# ---------------------------------------------------------------------------


def with_target_langs(source: DataFrame, target: DataFrame | None = None,
                      langs: list[str] | None = None) -> DataFrame:
    """Pair every source entry with each target language of its catalog.

    With an explicit ``langs`` list this is a column-level ``explode`` (no
    join). Otherwise the languages come from the target's (catalog, lang)
    pairs, a small aggregate joined on ``catalog``.
    """
    src = source.drop("lang") if "lang" in source.columns else source
    rest = [c for c in src.columns if c not in ("catalog", "key")]
    if langs is not None:
        src = src.withColumn("lang", F.explode(F.array(*[F.lit(x) for x in langs])))
    else:
        src = src.join(target.select("catalog", "lang").distinct(), "catalog")
    return src.select("catalog", "lang", "key", *rest)


def _target_keys(target: DataFrame) -> DataFrame:
    return target.select(*ENTRY_KEYS).distinct()


def missing_entries(source: DataFrame, target: DataFrame,
                    langs: list[str] | None = None) -> DataFrame:
    """Source entries whose key is absent from the target (left anti)."""
    src = with_target_langs(source, target, langs)
    return src.join(_target_keys(target), ENTRY_KEYS, "left_anti")


def reviewable_entries(source: DataFrame, target: DataFrame,
                       langs: list[str] | None = None) -> DataFrame:
    """Source entries that have a target entry (left semi)."""
    src = with_target_langs(source, target, langs)
    return src.join(_target_keys(target), ENTRY_KEYS, "left_semi")


def outdated_pairs(source: DataFrame, target: DataFrame,
                   langs: list[str] | None = None) -> DataFrame:
    """J2 + F1: (source, last target) pairs whose texts differ.

    If either side has a ``context`` column, the pair's is the source's, or if that is empty the target's (P11).
    """
    return reviewed_pairs(source, target, langs).where(~F.col("source_value").eqNullSafe(F.col("target_value")))


def reviewed_pairs(source: DataFrame, target: DataFrame, langs: list[str] | None = None) -> DataFrame:
    """J3 as pairs: every source row of a key that has a target, with the key's last target row; see ``outdated_pairs``."""
    def rows(df: DataFrame, side: str) -> DataFrame:
        ctx = [F.col("context").alias(f"_{side}")] if "context" in df.columns else []
        return df.select(*ENTRY_KEYS, F.col("value").alias(f"{side}_value"), F.col("ord").alias(f"{side}_ord"), *ctx)

    ctx = ["context"] if "context" in target.columns else []
    j = rows(with_target_langs(source, target, langs), "source").join(
        rows(last_wins(target.select(*ENTRY_KEYS, "value", "ord", *ctx)), "target"), ENTRY_KEYS, "inner")
    found = [F.when(~falsy(c), F.col(c)) for c in ("_source", "_target") if c in j.columns]
    return j.select(*ENTRY_KEYS, "source_value", "source_ord", "target_value", "target_ord",
                    *([F.coalesce(*found).alias("context")] if found else []))


def classify_entries(source: DataFrame, target: DataFrame,
                     langs: list[str] | None = None) -> DataFrame:
    """Every source entry with ``status`` in missing / outdated / same."""
    src = with_target_langs(source, target, langs)
    tgt = last_wins(target.select(*ENTRY_KEYS, "value", "ord")).select(
        *ENTRY_KEYS, F.col("value").alias("target_value"), F.lit(True).alias("_hit"))
    j = src.join(tgt, ENTRY_KEYS, "left")
    status = (F.when(F.col("_hit").isNull(), "missing")
              .when(F.col("value").eqNullSafe(F.col("target_value")), "same")
              .otherwise("outdated"))
    return j.withColumn("status", status).drop("_hit")


def coverage(source: DataFrame, target: DataFrame,
             langs: list[str] | None = None) -> DataFrame:
    """A1: per (catalog, lang) counts of source, target, missing, outdated, same and extra keys.

    The target is aggregated once per key (row count and last value), the
    source once per (key, value) with its row count; one full outer join
    classifies the source rows and finds the extra target keys; one group-by
    counts. The per-key target aggregate is reused for ``n_target``.
    """
    # Duplicates of a key are counted map-side first: the full outer join (which
    # AQE cannot split when skewed) then sees one row per distinct (key, value).
    src = (with_target_langs(source, target, langs)
           .groupBy(*ENTRY_KEYS, "value").agg(F.count(F.lit(1)).alias("_c")))
    tk = target.groupBy(*ENTRY_KEYS).agg(F.count(F.lit(1)).alias("_n"),
                                        F.max_by("value", "ord").alias("_tv"))
    j = src.join(tk, ENTRY_KEYS, "full_outer")
    has_s, has_t = F.col("_c").isNotNull(), F.col("_n").isNotNull()
    same = F.col("value").eqNullSafe(F.col("_tv"))
    rows_if = lambda cond: F.sum(F.when(cond, F.col("_c")))
    per = j.groupBy("catalog", "lang").agg(
        rows_if(has_s).alias("n_source"),
        rows_if(has_s & ~has_t).alias("n_missing"),
        rows_if(has_s & has_t & ~same).alias("n_outdated"),
        rows_if(has_s & has_t & same).alias("n_same"),
        F.count_if(~has_s).alias("n_extra"))
    per_tgt = tk.groupBy("catalog", "lang").agg(F.sum("_n").alias("n_target"))
    out = per.join(per_tgt, ["catalog", "lang"], "full_outer")
    counts = ["n_source", "n_target", "n_missing", "n_outdated", "n_same", "n_extra"]
    return out.select("catalog", "lang",
                      *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in counts])


def coverage_rollup(source: DataFrame, target: DataFrame,
                    langs: list[str] | None = None) -> DataFrame:
    """A1 at scale: the missing/outdated/same counts rolled up over (catalog, lang)."""
    cls = classify_entries(source, target, langs)
    return cls.rollup("lang", "catalog").agg(
        F.count(F.lit(1)).alias("n_source"),
        F.count_if(F.col("status") == "missing").alias("n_missing"),
        F.count_if(F.col("status") == "outdated").alias("n_outdated"),
        F.count_if(F.col("status") == "same").alias("n_same"))


# ---------------------------------------------------------------------------
# Merges: J5/U1 translate merge, J6 review merge, J7/A2/F3 import upsert
# ---------------------------------------------------------------------------


def merge_translations(target: DataFrame, missing: DataFrame, results: DataFrame) -> DataFrame:
    """J5 + U1: target rows unchanged and first, then one translated row per missing key, in source order.

    ``missing`` are the missing source entries (with ``lang``), ``results``
    rows ``(catalog, lang, key, translated, error)``; failed rows (``error``
    set) are left out, as are keys without a result. ``is_new`` tells the
    appended rows, ``ord`` puts them after the existing ones; they keep the
    source entry's ``context``.
    """
    ok = results.where(F.col("error").isNull()).select(*ENTRY_KEYS, "translated")
    ctx = ["context"] if "context" in missing.columns or "context" in target.columns else []
    carried = [c for c in ctx if c in missing.columns]
    new = last_wins(missing.select(*ENTRY_KEYS, "ord", *carried), first_position="first_ord").join(ok, ENTRY_KEYS, "inner")

    def rows(df: DataFrame, value: str, order: str, is_new: bool) -> DataFrame:
        context = [(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in ctx]
        return df.select(*ENTRY_KEYS, F.col(value).alias("value"), on_side(df, order, int(is_new)).alias("ord"),
                         *context, F.lit(is_new).alias("is_new"))

    return rows(target, "value", "ord", False).unionByName(rows(new, "translated", "first_ord", True))


def merge_reviews(target: DataFrame, results: DataFrame) -> DataFrame:
    """Every target row of a reviewed key takes the improved text (left outer + coalesce)."""
    ok = results.where(F.col("error").isNull()).select(
        *ENTRY_KEYS, F.col("translated").alias("_improved"))
    return (target.join(ok, ENTRY_KEYS, "left")
            .withColumn("value", F.coalesce(F.col("_improved"), F.col("value")))
            .drop("_improved"))


def split_valid_records(records: DataFrame, required=("key", "value")) -> tuple[DataFrame, DataFrame]:
    """accepted rows and rejected rows (a required field null or empty)."""
    bad = None
    for c in required:
        b = falsy(c)
        bad = b if bad is None else (bad | b)
    return records.where(~bad), records.where(bad)


def upsert_entries(existing: DataFrame, incoming: DataFrame, seq: str = "seq") -> DataFrame:
    """The catalog after an import, one row per key.

    Existing keys take the last incoming value and keep their place (and
    ``context``); new keys are appended (``is_new``). Invalid incoming rows are
    ignored. Orders of the two sides are never compared with each other.
    """
    acc, _ = split_valid_records(incoming)
    inc = last_wins(acc.select(*ENTRY_KEYS, "value", F.col(seq).alias("_seq")),
                    order="_seq", first_position="_first")
    inc = inc.select(*ENTRY_KEYS, F.col("value").alias("_new"), on_side(inc, "_first", 1).alias("_first"))
    ctx = [c for c in ("context",) if c in existing.columns]
    old = last_wins(existing.select(*ENTRY_KEYS, "value", "ord", *ctx), first_position="_pos")
    old = old.select(*ENTRY_KEYS, F.col("value").alias("_old"), on_side(old, "_pos", 0).alias("_pos"), *ctx)
    j = old.join(inc, ENTRY_KEYS, "full_outer")  # an order is never null, so it tells the sides
    return j.select(*ENTRY_KEYS, F.coalesce(F.col("_new"), F.col("_old")).alias("value"), *ctx,
                    F.col("_pos").isNull().alias("is_new"), F.coalesce("_pos", "_first").alias("ord"))


def import_counts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """A2: per (catalog, lang) rows added, updated and skipped by an import.

    Counted per incoming row, so a new key repeated in the import counts as
    added each time.
    """
    keys = _target_keys(existing).withColumn("_exists", F.lit(True))
    valid = ~(falsy("key") | falsy("value"))
    j = incoming.join(keys, ENTRY_KEYS, "left")
    return j.groupBy("catalog", "lang").agg(
        F.count_if(valid & F.col("_exists").isNull()).alias("n_added"),
        F.count_if(valid & F.col("_exists").isNotNull()).alias("n_updated"),
        F.count_if(~valid).alias("n_skipped"))


# ---------------------------------------------------------------------------
# U2 / U3 key set operations
# ---------------------------------------------------------------------------


def key_difference(a: DataFrame, b: DataFrame, keys=ENTRY_KEYS) -> DataFrame:
    """Keys of ``a`` not in ``b`` (EXCEPT DISTINCT, planned as an anti join)."""
    return a.select(*keys).subtract(b.select(*keys))


def key_intersection(a: DataFrame, b: DataFrame, keys=ENTRY_KEYS) -> DataFrame:
    """Keys in both (INTERSECT DISTINCT, planned as a semi join)."""
    return a.select(*keys).intersect(b.select(*keys))


# ---------------------------------------------------------------------------
# P1 flatten nested catalogs (each document parsed once, where it lies)
# ---------------------------------------------------------------------------


@dataclass
class Flattened:
    entries: DataFrame
    rejects: DataFrame


_INDEX = re.compile(r"0|[1-9][0-9]{0,9}")
FLAT_ROWS = 20_000  # rows handed on at once


def _index(name: str) -> int | None:
    """The number of an array-index-like member name (see ``integer_like``), else None."""
    return int(name) if _INDEX.fullmatch(name) and int(name) < 4294967295 else None


def _members(node) -> list[tuple[str, object]]:
    """Members in object order: index-like names ascending, then the others as they first came; array items by index."""
    if isinstance(node, list):
        return [(str(i), v) for i, v in enumerate(node)]
    numbered = sorted((i, k) for k in node if (i := _index(k)) is not None)
    return [(k, node[k]) for _, k in numbered] + [(k, v) for k, v in node.items() if _index(k) is None] if numbered else list(node.items())


def _constant(name: str):
    raise ValueError(f"{name} is no JSON")


def _flat(text: str | None, max_depth: int) -> tuple[list[tuple[str, str]], str | None]:
    """(key, value) of all string leaves in document order, or why the document is rejected."""
    try:
        root = json.loads(text or "", parse_int=lambda s: 0, parse_float=lambda s: 0, parse_constant=_constant)
    except RecursionError:
        return [], f"nested deeper than {max_depth}"
    except ValueError:
        root = None
    if not isinstance(root, dict | list):
        return [], "unparseable or not an object"
    out, todo = [], [("", iter(_members(root)))]
    while todo:
        prefix, rest = todo[-1]
        for name, value in rest:
            key = f"{prefix}.{name}" if prefix else name
            if isinstance(value, str):
                out.append((key, value))
            elif value is None:
                return [], "null value"
            elif isinstance(value, dict | list):
                if len(todo) == max_depth:
                    return [], f"nested deeper than {max_depth}"
                todo.append((key, iter(_members(value))))
                break
        else:
            todo.pop()
    if "\\u" in text:  # escaped half characters, which no text can hold
        out = [tuple(x.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for x in kv) for kv in out]
    return out, None


def flatten_catalogs(files: DataFrame, ids=("catalog", "lang"), text_col: str = "json",
                     max_depth: int = 64) -> Flattened:
    """Nested JSON documents -> flat entries ``(ids..., key, value, ord)``.

    Depth-first key paths joined with '.'; string leaves become entries,
    numbers and booleans vanish, arrays give index keys; a ``null`` anywhere,
    unparseable text or nesting beyond ``max_depth`` sends the whole document
    to ``rejects``. ``ord`` is the document order (index-like names first), in
    the library's order type. A document is one row, so it is parsed and walked
    once in the task that holds it; nothing is shuffled or written, and what
    is asked for alone (entries or rejects) is what the scan gives.
    """
    ids = list(ids)
    flat = files.select(*ids, F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([*flat.schema.fields[:-1], *(T.StructField(n, T.StringType()) for n in ("key", "value", "reason")),
                           T.StructField("n", T.LongType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)

        def made(batch, rows):
            at = pa.array([r[0] for r in rows], pa.int64())
            cols = [batch.column(i).take(at).cast(arrow.field(i).type) for i in range(len(ids))]
            cols += [pa.array([r[j] for r in rows], arrow.field(len(ids) + j - 1).type) for j in range(1, 5)]
            return pa.RecordBatch.from_arrays(cols, schema=arrow)

        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column(len(ids))):
                leaves, reason = _flat(text.as_py(), max_depth)
                rows += [(i, None, None, reason, 0)] if reason else [(i, k, v, None, n) for n, (k, v) in enumerate(leaves)]
                if len(rows) >= FLAT_ROWS:
                    yield made(batch, rows)
                    rows = []
            if rows:
                yield made(batch, rows)

    out = flat.mapInArrow(walk, schema)
    return Flattened(out.where("reason is null").select(*ids, "key", "value", F.array(step(minor=F.col("n"))).alias("ord")),
                     out.where("reason is not null").select(*ids, "reason"))


# ---------------------------------------------------------------------------
# P2 nest (build the JSON text per catalog) and P3 path conflicts
# ---------------------------------------------------------------------------


def _member(name: Column, pos: Column) -> Column:
    """What orders the members of one object: index-like names by number, then the others by their place."""
    return F.struct((~integer_like(name)).alias("o1"), F.when(integer_like(name), name.cast("bigint")).alias("o2"),
                    pos.alias("pos"), name.alias("name"))


def _same(a: DataFrame, b: DataFrame, cols: list[str]) -> Column:
    return reduce(and_, [a[c].eqNullSafe(b[f"_r_{c}"]) for c in cols])


def _renamed(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"_r_{c}" for c in cols})


def nest_lines(entries: DataFrame, ids=("catalog", "lang"), indent: int = 2) -> DataFrame:
    """Flat entries -> the pretty-printed nested JSON of each catalog, in pieces: ``(ids, n, text)``.

    Piece n (from 1) is the line of the n-th key, with the lines that open the
    objects beginning there before it and those that close the objects ending
    there after it; the document is the pieces joined by line ends. Last
    value per key wins, a key keeps the place of its first assignment, an
    object that of its first key, index-like member names come first.

    No object is ever gathered: an object's place is a minimum over its keys,
    a key's path with these places is its pre-order position, the keys are
    numbered by it over range partitions, and what a key opens and closes
    follows from its two neighbours. Tasks stay bounded however many keys one
    catalog or object has.

    Path conflicts (``a`` and ``a.b``) must be removed first (see
    ``path_conflicts``); they give a member twice.
    """
    ids = list(ids)
    e = (last_wins(entries.select(*ids, "key", "value", "ord"), keys=ids + ["key"], first_position="pos")
         .withColumn("parts", F.split(F.col("key"), "\\.", -1)))
    e = cut_lineage(e.withColumn("depth", F.size("parts")), "nest-input")
    inner = e.where("depth > 1").select(*ids, "key", "pos", "parts", F.explode(F.sequence(F.lit(1), F.col("depth") - 1)).alias("d"))
    inner = inner.withColumn("node", F.slice("parts", 1, F.col("d")))
    places = _renamed(inner.groupBy(*ids, "node").agg(F.min("pos").alias("node_pos")), [*ids, "node"])
    above = (inner.join(places, _same(inner, places, [*ids, "node"]))
             .groupBy(*ids, "key")
             .agg(F.array_sort(F.collect_list(F.struct(  # one row a level of one key
                 "d", _member(F.element_at("node", -1), F.col("node_pos")).alias("m")))).alias("above")))
    above = _renamed(above, [*ids, "key"])
    own = F.array(_member(F.element_at("parts", -1), F.col("pos")))
    placed = e.join(above, _same(e, above, [*ids, "key"]), "left").select(
        *ids, "parts", "value", F.concat(F.coalesce(F.transform("above", lambda x: x["m"]), F.array().cast(
            T.ArrayType(e.select(own.alias("m")).schema["m"].dataType.elementType))), own).alias("path"))
    k = cut_lineage(row_numbers(placed, ids, "path", out="n").select(*ids, "n", "parts", "value"), "nest-numbered")

    def beside(step: int, name: str) -> DataFrame:
        return k.select(*[F.col(c).alias(f"_r_{c}") for c in ids], (F.col("n") - step).alias("_r_n"), F.col("parts").alias(name))

    def shared(other: str) -> Column:
        """How many objects a key and its neighbour are both in."""
        both = F.least(F.size("parts"), F.size(other)) - 1
        return F.coalesce(F.size(F.filter(F.sequence(F.lit(0), both), lambda i: (i > 0) & (
            F.slice("parts", 1, i) == F.slice(other, 1, i)))), F.lit(0))

    for step, name in ((-1, "before"), (1, "after")):
        other = beside(step, name)
        k = k.join(other, _same(k, other, [*ids, "n"]), "left").drop(*[f"_r_{c}" for c in [*ids, "n"]])
    k = k.withColumn("opened", F.when(F.col("before").isNull(), 0).otherwise(shared("before"))).withColumn(
        "kept", F.when(F.col("after").isNull(), 0).otherwise(shared("after")))
    depth = F.size("parts")
    space = lambda d: F.repeat(F.lit(" " * indent), d)
    levels = lambda shared_, f: F.transform(F.filter(F.sequence(F.lit(0), depth - 1), lambda d: d > shared_), f)
    name_at = lambda d: json_string_literal(F.element_at("parts", d))
    opens = levels(F.col("opened"), lambda d: F.concat(space(d), name_at(d), F.lit(": {")))
    closes = F.reverse(levels(F.col("kept"), lambda d: F.concat(space(d), F.lit("}"))))
    line = F.concat(space(depth), name_at(depth), F.lit(": "), json_string_literal("value"))
    body = F.array_join(F.concat(opens, F.array(line), closes), "\n")
    return k.select(*ids, "n", F.concat(F.when(F.col("before").isNull(), "{\n").otherwise(""), body,
                                        F.when(F.col("after").isNull(), "\n}").otherwise(",")).alias("text"))


def nest_catalogs(entries: DataFrame, ids=("catalog", "lang"), indent: int = 2) -> DataFrame:
    """Flat entries -> one pretty-printed nested JSON text per catalog, the pieces of ``nest_lines`` put together.

    A document is one value here; to write files use ``write_catalogs``, which takes the pieces as they are.
    """
    return (nest_lines(entries, ids, indent).groupBy(*ids)
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))),
                                          lambda x: x["text"]), "\n").alias("json")))


def path_conflicts(entries: DataFrame, ids=("catalog", "lang")) -> DataFrame:
    """Pairs (leaf_key, deeper_key) where a key is also a proper path prefix of another key."""
    ids = list(ids)
    k = entries.select(*ids, "key").distinct()
    parts = F.split(F.col("key"), "\\.", -1)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1),
                           lambda i: F.array_join(F.slice(parts, 1, i), "."))
    deeper = (k.where(F.size(parts) > 1)
              .select(*ids, F.col("key").alias("deeper_key"), F.explode(prefixes).alias("key")))
    return deeper.join(k, ids + ["key"], "inner").select(
        *ids, F.col("key").alias("leaf_key"), "deeper_key")
