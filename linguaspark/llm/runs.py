"""Periodic runs of words: stretches that repeat a short phrase.

A run is a stretch of consecutive words with smallest period q (words q
apart are identical) that holds at least ``exponent`` periods and
``min_words`` words, and that no neighbouring word extends with period q.

Method: maximal pairs from the LCP-interval tree of the text's words. The
suffixes are sorted by prefix doubling, the rank tables give the common
prefixes of neighbours, and a bottom-up walk of the interval tree joins the
children's position lists, the smaller into the larger; the word left of a
position is its class. Two positions of different children have exactly the
interval's depth in common, so if their left classes differ they are a
maximal pair, and with a distance q of at most depth / (exponent - 1) the
pair spans a whole run [first, first + depth + q): nothing is extended word
by word. Occurrences that near to each other lie at multiples of one period,
so only neighbours in the position list need to be compared. Pairs at a
multiple of the period give the same stretch; the smallest distance of a
stretch stays. Intervals shallower than ``min_words * (exponent - 1) /
exponent`` words hold no run and are not built; a text without a repeated
window of that many words (rounded down to a power of two) is done after one
sort of window hashes.

Bounds: everything lies inside one text; memory is some 100 bytes a word of
the text at hand. Nothing is shuffled, collected or broadcast.

Defined cases: null and empty texts have no words and no runs (collapsed
text empty); texts of fewer than ``min_words`` words have no runs; repeated
rows are handled row by row; an empty table gives an empty result; of other
columns only the ``keep`` ones are read, clashing names are resolved as in
``pick``.
"""

from __future__ import annotations

from bisect import bisect, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linguaspark.llm.common import U64, mix, pick, returning

Run = tuple[int, int, int]  # first word, words, period


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+``: bytes.split() parts at just these six bytes."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers, counted from 0 by first occurrence."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    return np.fromiter(map(number.__getitem__, words), np.int32, len(words))


def repeats_a_window(ids: np.ndarray, depth: int) -> bool:
    """Whether some window of 2^k <= ``depth`` words may stand twice (False is certain)."""
    h = mix(ids.astype(U64) + U64(1))
    step = 1
    while 2 * step <= depth:
        if len(h) <= step:
            return False
        h = mix(h[:-step] * U64(0x9FB21C651E98DF25) + h[step:])
        step *= 2
    h.sort()
    return bool((h[1:] == h[:-1]).any())


def suffix_ranks(ids: np.ndarray) -> list[np.ndarray]:
    """Rank tables of the prefixes of 1, 2, 4, ... words of all suffixes, until every rank is unique.

    A rank is the number of suffixes whose prefix is smaller; a shorter
    suffix is smaller than its extensions. Each table ends with -1, for the
    empty suffix. Only suffixes that are not yet unique are sorted again.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    at = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = ids[order][1:] != ids[order][:-1]
    rank = np.full(n + 1, -1, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))
    tables, size = [rank], 1
    while True:
        alone = new & np.append(new[1:], True)
        order = order[~alone]
        if not len(order):
            return tables
        first, second = rank[order], rank[np.minimum(order + size, n)]
        turn = np.lexsort((second, first))
        order, first, second = order[turn], first[turn], second[turn]
        at = np.arange(len(order))
        group = np.ones(len(order), bool)
        group[1:] = first[1:] != first[:-1]
        new = group.copy()
        new[1:] |= second[1:] != second[:-1]
        rank = rank.copy()
        rank[order] = first + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        tables.append(rank)
        size *= 2


def neighbour_prefixes(tables: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, words that each suffix shares with the one before; 0 where these are surely fewer than ``depth``)."""
    n = len(tables[0]) - 1
    sa = np.empty(n, np.int64)
    sa[tables[-1][:n]] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    level = depth.bit_length() - 1
    if level >= len(tables):
        return sa, lcp
    low = tables[level]
    hit = np.flatnonzero(low[sa[1:]] == low[sa[:-1]]) + 1
    a, b = sa[hit - 1].copy(), sa[hit].copy()
    shared = np.zeros(len(hit), np.int64)
    for k in range(len(tables) - 1, -1, -1):
        same = (tables[k][a] == tables[k][b]).astype(np.int64) << k  # never both empty: the suffixes differ
        shared += same
        a += same
        b += same
    lcp[hit] = shared
    return sa, lcp


def runs_of(ids: np.ndarray, min_words: int = 24, exponent: int = 3) -> list[Run]:
    """All runs of a text given as word numbers, by first word, then period."""
    n, depth = len(ids), -(-min_words * (exponent - 1) // exponent)
    if n < min_words or not repeats_a_window(ids, depth):
        return []
    sa, lcp = neighbour_prefixes(suffix_ranks(ids), depth)
    left = [-1, *ids.tolist()]  # the class of position i is the word before it
    found: dict[tuple[int, int], int] = {}

    def join(a: list[int], b: list[int], shared: int) -> list[int]:
        """One position list of two children of an interval of depth ``shared``; notes their runs."""
        if len(a) < len(b):
            a, b = b, a
        for x in b:
            k = bisect(a, x)
            for y in a[max(0, k - 1):k + 1]:
                i, q = (x, y - x) if x < y else (y, x - y)
                if q * (exponent - 1) <= shared and q + shared >= min_words and left[i] != left[i + q]:
                    stretch = (i, shared + q)
                    found[stretch] = min(q, found.get(stretch, q))
        if len(b) < 16:
            for x in b:
                insort(a, x)
        else:
            a += b
            a.sort()
        return a

    stack: list[tuple[int, list[int]]] = []
    last: list[int] = []
    where = np.flatnonzero(lcp >= depth)  # suffixes that share at least so much with the one before
    if not len(where):
        return []
    fresh = np.ones(len(where), bool)
    fresh[1:] = where[1:] != where[:-1] + 1
    for i, new, pos, prev, shared in zip(where.tolist(), fresh.tolist(), sa[where].tolist(), sa[where - 1].tolist(), lcp[where].tolist()):
        if new:
            while stack:
                d, kids = stack.pop()
                last = join(kids, last, d)
            last = [prev]
        while stack and stack[-1][0] > shared:
            d, kids = stack.pop()
            last = join(kids, last, d)
        if stack and stack[-1][0] == shared:
            stack[-1] = (shared, join(stack[-1][1], last, shared))
        else:
            stack.append((shared, last))
        last = [pos]
    while stack:
        d, kids = stack.pop()
        last = join(kids, last, d)
    return sorted((s, m, q) for (s, m), q in found.items())


def best_run(runs: list[Run]) -> Run | None:
    """The run of greatest exact length / period; ties: smallest start, then period."""
    best = None
    for s, m, q in runs:  # already by start, then period
        if best is None or m * best[2] > best[1] * q:
            best = (s, m, q)
    return best


def collapse(words: list[bytes], runs: list[Run]) -> str:
    """The words but those that some run contains after its first period, joined by one space."""
    if runs:
        edge = np.zeros(len(words) + 1, np.int64)
        for s, m, q in runs:
            edge[s + q] += 1
            edge[s + m] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def find(df: DataFrame, text: str | Column = "text", keep: dict[str, str] | None = None, min_words: int = 24, exponent: int = 3) -> DataFrame:
    """The ``keep`` columns (default doc_id) and, of every whole text, its runs and the text with runs collapsed.

    n_words, n_runs, runs array<struct<start, length, period>> by start then
    period, best (the run of greatest length / period; null without runs),
    collapsed.
    """
    keep = keep if keep is not None else {"doc_id": "doc_id"}

    @F.pandas_udf("n_words long, starts array<long>, lengths array<long>, periods array<long>, best array<long>, collapsed string")
    @returning
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for t in texts:
                words = words_of(t)
                runs = runs_of(word_numbers(words), min_words, exponent) if len(words) >= min_words else []
                best = best_run(runs)
                out.append((len(words), [r[0] for r in runs], [r[1] for r in runs], [r[2] for r in runs],
                            list(best) if best else None, collapse(words, runs)))
            yield pd.DataFrame(out, columns=["n_words", "starts", "lengths", "periods", "best", "collapsed"])

    run = "struct<start: bigint, length: bigint, period: bigint>"
    d = pick(df, **{f"k_{c}": src for c, src in keep.items()}, text=text).withColumn("r", found("text"))
    return d.select(*[F.col(f"k_{c}").alias(c) for c in keep], F.col("r.n_words"), F.size("r.starts").cast("long").alias("n_runs"),
                    F.arrays_zip("r.starts", "r.lengths", "r.periods").cast(f"array<{run}>").alias("runs"),
                    F.when(F.col("r.best").isNotNull(), F.struct(*[F.col("r.best")[i].alias(c) for i, c in enumerate(("start", "length", "period"))]))
                    .alias("best"), F.col("r.collapsed"))


def plant(text: Column, key: Column) -> Column:
    """The text with a run planted where ``key`` says so: h = crc32 of the key as text; nothing unless h % 10 = 0.

    From word a = g % n (g = h / 10, n words) on, the words repeat those of
    the first 1 + (n - a) / (3 + g % 8) of them. A null key plants nothing.
    """
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size(words)
    a = (g % n).cast("int")
    times = (F.lit(3) + g % 8).cast("int")
    period = (F.lit(1) + F.floor((n - a) / times)).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, period), times)), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(text)
