"""Suffix-array dedup: repeated byte strings of a length found exactly, within and across documents.

A position is repeated if the ``length`` bytes from it occur anywhere else.
Every byte covered by a repeated string is removed.

Candidates. Each window of ``length`` bytes has an anchor: the least hash
among its runs of ``ANCHOR`` bytes. Equal windows have equal anchors, so only
windows of one anchor need comparing, and neighbouring windows mostly share
it: a run of them (``PIECE`` at most) is a segment. An anchor seen once is no
candidate. Hashes choose what is brought together; a suffix array of the
bytes decides what repeats.

Comparison. Byte strings are brought together in blocks, and a suffix array
of each block is built by two-stage sorting: only suffixes smaller than their
successors are sorted directly, the others follow from one scan over the
buckets of first bytes. Common prefixes of neighbours in the array tell which
positions repeat. Two kinds of strings are compared:

* segments that seem to occur more than once: two copies of each, neighbouring
  segments whose copies are neighbours as one string;
* the distinct segments of an anchor with each other, anchor by anchor.

An anchor whose distinct segments exceed ``BLOCK_BYTES`` (the edge of a
passage that a large share of the documents has) is split: its windows by the
place of the anchor in them, in classes of ``WIDTHS`` places, and by the bytes
that all windows of a class have around the anchor. Equal windows stay
together, parts are compared as above, and those still too large are split by
narrower classes; in a class of one place all windows are equal. So no block
grows with the data.

Defined cases: null or empty texts have no bytes (the digest is that of
nothing); texts shorter than ``length`` keep all; repeated rows remove each
other whole if long enough; the same string twice in one document counts,
overlapping too; equal texts have equal results; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linguaspark.llm.common import U64, Spans, cut_lineage, may_be, mix, pick, returning, text_bytes, with_text_hash

ANCHOR = 48
BLOCK_BYTES = 2 << 20
PIECE = 4096  # most windows of a segment (only an anchor that recurs has so many)
CHAIN = 1 << 16  # neighbouring copies are compared as one string within stretches of so many bytes
WIDTHS = (32, 4, 1)  # places of the anchor in one class, for anchors that exceed a block


def _sliding(x: np.ndarray, size: int, op) -> np.ndarray:
    """op (minimum or maximum) over every ``size`` neighbours, by doubling."""
    have = 1
    while have * 2 <= size:
        x = op(x[:-have], x[have:])
        have *= 2
    return op(x[:len(x) - (size - have)], x[size - have:]) if size > have else x


def segments(buf: np.ndarray, length: int) -> tuple[np.ndarray, ...] | None:
    """(anchor, start, windows, content hash, anchor occurs twice) of every segment; None if the text is too short."""
    n = len(buf) - length + 1
    if n <= 0:
        return None
    spans = Spans(buf)
    g = spans.windows(ANCHOR)
    width = length - ANCHOR + 1
    v = _sliding(g, width, np.minimum)
    start = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
    count = np.diff(np.append(start, n))
    if count.max() > PIECE:
        pieces = -(-count // PIECE)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(start, pieces) + nth * PIECE
        count = np.diff(np.append(start, n))
    anchor = v[start]
    # anchors that are chosen at two places of this text
    edge = np.zeros(width - 1, U64)
    chosen = g == _sliding(np.concatenate((edge, v, edge)), width, np.maximum)
    places, times = np.unique(g[chosen], return_counts=True)
    twice = np.isin(anchor, places[times > 1]) if (times > 1).any() else np.zeros(len(anchor), bool)
    return anchor, start, count, spans.hash(start, start + count + length - 1), twice


def two_stage_order(t: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``t`` in the order of their suffixes, compared over ``depth`` bytes at least."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    rises = t[1:].astype(np.int16) - t[:-1]
    turn = np.where(rises != 0, np.arange(n - 1), n)  # the next place where the text changes
    turn = np.minimum.accumulate(turn[::-1])[::-1]
    small = np.zeros(n, bool)  # the suffix is smaller than its successor
    ok = turn < n
    small[:-1][ok] = rises[turn[ok]] > 0
    order = np.empty(n, np.int64)
    first = np.concatenate(([0], np.cumsum(np.bincount(t, minlength=256))))
    direct = _sort_direct(t, np.flatnonzero(small), depth)
    # sorted suffixes stand at the ends of their buckets
    n_small = np.bincount(t[direct], minlength=256)
    tail = first[1:] - n_small
    at = 0
    for c in range(256):
        order[tail[c]:first[c + 1]] = direct[at:at + n_small[c]]
        at += n_small[c]
    head = first[:-1].copy()
    # the last suffix is larger than its (empty) successor: it comes first in its bucket
    last = t[n - 1]
    order[head[last]] = n - 1
    head[last] += 1
    for c in range(256):  # each bucket is complete when its turn comes, but for predecessors with the same byte
        done = first[c]
        while done < head[c]:  # those come in waves
            now = order[done:head[c]]
            done = head[c]
            before = now[now > 0] - 1
            _put(order, head, t, before[(t[before] >= c) & ~small[before]])
        now = order[tail[c]:first[c + 1]]
        before = now[now > 0] - 1
        _put(order, head, t, before[(t[before] > c) & ~small[before]])
    return order


def _put(order: np.ndarray, head: np.ndarray, t: np.ndarray, pos: np.ndarray) -> None:
    """Append positions, in their order, to the heads of their buckets."""
    if not len(pos):
        return
    c = t[pos]
    by = np.argsort(c, kind="stable")
    n = np.bincount(c, minlength=256)
    offset = np.arange(len(pos)) - np.repeat(np.cumsum(n) - n, n)
    order[head[c[by]] + offset] = pos[by]
    head += n


def _words(t: np.ndarray, extra: int) -> np.ndarray:
    """The eight bytes from each place as one big-endian number; zeros beyond the end."""
    padded = np.concatenate((t, np.zeros(extra + 8, np.uint8))).astype(U64)
    out = padded[:-7].copy()
    for j in range(1, 8):
        out <<= U64(8)
        out |= padded[j:len(padded) - 7 + j]
    return out


def _sort_direct(t: np.ndarray, pos: np.ndarray, depth: int) -> np.ndarray:
    """Sort suffixes by their first ``depth`` bytes, eight at a time; only groups that differ are sorted again.

    A group with one hash of these bytes has no order to find. (Its members'
    common prefixes are still computed from the bytes.)
    """
    if len(pos) < 2:
        return pos
    w = _words(t, depth)
    whole = Spans(np.concatenate((t, np.zeros(depth, np.uint8)))).windows(depth)
    pos = pos[np.argsort(w[pos], kind="stable")]
    new = np.concatenate(([True], w[pos[1:]] != w[pos[:-1]]))  # starts of groups equal so far
    live = np.arange(len(pos))  # places in ``pos`` whose group is not single
    for o in range(8, depth, 8):
        alone = new[live] & np.concatenate((new[live][1:], [True]))
        live = live[~alone]
        if o in (8, 32, 104) and len(live):
            first, h = np.flatnonzero(new[live]), whole[pos[live]]
            differ = np.append(h[1:] != h[:-1], False) & ~np.append(new[live][1:], True)
            live = live[np.repeat(np.logical_or.reduceat(differ, first), np.diff(np.append(first, len(live))))]
        if not len(live):
            break
        key = w[pos[live] + o]
        fresh = new[live]
        differs = np.concatenate(([False], (key[1:] != key[:-1]))) & ~fresh
        if not differs.any():
            continue
        group = np.cumsum(fresh) - 1
        touched = np.zeros(group[-1] + 1, bool)
        touched[group[differs]] = True
        mine = np.flatnonzero(touched[group])
        by = np.lexsort((key[mine], group[mine]))
        pos[live[mine]] = pos[live[mine]][by]
        k2, g2 = key[mine][by], group[mine]
        new[live[mine]] = np.concatenate(([True], (k2[1:] != k2[:-1]) | (g2[1:] != g2[:-1])))
    return pos


def repeated_in(parts: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For byte strings: which of their positions start a ``length``-byte string that occurs at another position."""
    sizes = np.array([len(p) for p in parts])
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))
    t = np.zeros(begin[-1], np.uint8)
    valid = np.zeros(len(t), bool)
    for p, b in zip(parts, begin, strict=False):
        t[b:b + len(p)] = p
        valid[b:b + max(0, len(p) - length + 1)] = True
    order = two_stage_order(t, length)
    order = order[valid[order]]
    # common prefixes of neighbours, as far as the wanted length
    w = _words(t, length)
    same = np.arange(len(order) - 1)
    for o in (0, 64, 128, length - 8):
        if o <= length - 8:
            same = same[w[order[same] + o] == w[order[same + 1] + o]]
    far = np.zeros(len(t) + 1, np.int64)  # how far from a suffix its neighbour starts
    far[order[same]] = order[same + 1] - order[same]
    x = np.flatnonzero(far)
    hit = np.zeros(len(t), bool)
    if len(x):  # suffixes one after the other in the text, with equally far neighbours, share their bytes: compared once
        start = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1] + 1) | (far[x[1:]] != far[x[:-1]]))))
        size = np.diff(np.append(start, len(x)))
        reach = size - 1 + length - 8
        n = -(-reach // 8) + 1
        begins = np.cumsum(n) - n
        nth = np.arange(n.sum()) - np.repeat(begins, n)
        at = np.repeat(x[start], n) + np.minimum(8 * nth, np.repeat(reach, n))
        equal = np.logical_and.reduceat(w[at] == w[at + np.repeat(far[x[start]], n)], begins)
        equal = np.repeat(equal, size)
        rest = x[~equal]
        for o in [*range(0, length - 7, 8), length - 8]:
            rest = rest[w[rest + o] == w[rest + far[rest] + o]]
        x = np.concatenate((x[equal], rest))
        hit[x] = hit[x + far[x]] = True
    return [hit[b:b + max(0, n - length + 1)] for b, n in zip(begin, sizes, strict=False)]


def _runs(flags: np.ndarray) -> np.ndarray:
    """(start, end) pairs of the true runs, flattened."""
    x = np.concatenate(([False], flags, [False]))
    return np.flatnonzero(x[1:] != x[:-1])


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and ``kept`` (the bytes left) of every row."""
    if length < ANCHOR + 8:
        raise ValueError(f"strings must have at least {ANCHOR + 8} bytes")
    d = with_text_hash(pick(docs, doc_id=id, text=text))
    long_enough = d.where(F.octet_length("text") >= length)

    @returning
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for th, t in zip(b["th"], b["text"], strict=True):
                anchor, start, count, content, twice = segments(text_bytes(t), length)
                out.append((anchor.view(np.int64), content.view(np.int64), np.full(len(start), th, np.int64),
                            start.astype(np.int32), count.astype(np.int32), twice))
            if out:
                yield pd.DataFrame(dict(zip(("v", "sh", "th", "p", "c", "twice"),
                                            (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)))

    found = cut_lineage(long_enough.select("th", "text").mapInPandas(
        cut, "v long, sh long, th long, p int, c int, twice boolean"), "suffix-segments")

    # anchors seen more than once
    shared = found.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice")).where("n > 1 or twice")
    shared = cut_lineage(shared.select("v"), "suffix-anchors")
    at = F.struct("th", "p")
    distinct = cut_lineage(may_be(found, "v", shared, "v").join(shared, "v", "left_semi").groupBy("v", "sh").agg(
        F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice"), F.min("c").alias("c"),
        F.min(at).alias("lo"), F.max(at).alias("hi")), "suffix-distinct")
    groups = distinct.groupBy("v").agg(F.count(F.lit(1)).alias("m"), F.max("twice").alias("any_twice"),
                                       F.sum(F.col("c") + length - 1).alias("size")).where("m > 1 or any_twice")
    units = cut_lineage(distinct.join(groups.select("v", "size"), "v").select(
        "v", "sh", F.col("v").alias("anchor"), "c", F.expr("n = 1").alias("emit"), "lo",
        F.lit(None).cast("struct<th:long,p:int>").alias("hi"), "size"), "suffix-units")
    chains = cut_lineage(neighbouring_copies(distinct.where("n > 1")), "suffix-chains")
    marked = repeated_segments(d, chains, units, length)

    # spans of repeated positions per text: whole segments, and parts of the others
    spans = (may_be(found, "v", marked, "v").join(marked, ["v", "sh"]).select("th", "p", "c", "runs").distinct()
             .groupBy("th").agg(F.collect_list(F.struct("p", "c", "runs")).alias("spans")))
    spans = cut_lineage(spans, "suffix-spans")

    @F.pandas_udf("n_removed long, n_spans long, kept binary")
    def kept(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, sp in zip(texts, spans, strict=True):
            buf = text_bytes(t)
            gone = np.zeros(len(buf) + 1, np.int32)
            for s in sp if sp is not None else ():
                runs = [0, s["c"]] if s["runs"] is None else s["runs"]
                for a, e in zip(runs[::2], runs[1::2], strict=True):
                    gone[s["p"] + a] += 1
                    gone[s["p"] + e - 1 + length] -= 1
            gone = np.cumsum(gone[:-1]) > 0
            out.append((int(gone.sum()), len(_runs(gone)) // 2, buf[~gone].tobytes()))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept"])

    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    clean = F.coalesce("text", F.lit("")).cast("binary")
    quiet = may_be(d, "th", spans, "th", keep=False)
    quiet = quiet.select("doc_id", n_bytes, F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
                         F.sha2(clean, 256).alias("kept_sha256"), clean.alias("kept"))
    touched = (may_be(d, "th", spans, "th").join(spans, "th", "left")
               .select("doc_id", n_bytes, kept("text", "spans").alias("r"))
               .select("doc_id", "n_bytes", "r.n_removed", "r.n_spans", F.sha2("r.kept", 256).alias("kept_sha256"), "r.kept"))
    return quiet.unionByName(touched)


def neighbouring_copies(copies: DataFrame) -> DataFrame:
    """(lo, hi, c, segs): segments that occur at lo and hi; neighbours whose copies are neighbours too are one row."""
    flat = copies.select("v", "sh", "c", "lo.th", "lo.p", F.col("hi.th").alias("th2"), F.col("hi.p").alias("p2"))
    w = Window.partitionBy("th").orderBy("p", "v", "sh")  # one text's segments
    follows = ((F.col("p") == F.lag(F.col("p") + F.col("c")).over(w)) & (F.col("th2") == F.lag("th2").over(w))
               & (F.col("p2") - F.col("p") == F.lag(F.col("p2") - F.col("p")).over(w))
               & (F.floor(F.col("p") / CHAIN) == F.lag(F.floor(F.col("p") / CHAIN)).over(w)))
    flat = flat.withColumn("follows", F.coalesce(follows, F.lit(False)))
    flat = flat.withColumn("chain", F.sum(F.when(F.col("follows"), 0).otherwise(1)).over(w))
    return (flat.groupBy("th", "chain").agg(
        F.min("p").alias("p"), F.min("th2").alias("th2"), F.min("p2").alias("p2"), F.sum("c").cast("int").alias("c"),
        F.sort_array(F.collect_list(F.struct("p", "v", "sh", "c"))).alias("segs"))
        .select(F.struct("th", "p").alias("lo"), F.struct(F.col("th2").alias("th"), F.col("p2").alias("p")).alias("hi"), "c",
                F.transform("segs", lambda x: F.struct(x["v"].alias("v"), x["sh"].alias("sh"), x["c"].alias("c"))).alias("segs")))


def with_texts(d: DataFrame, wanted: DataFrame, *cols: str) -> DataFrame:
    """(lo, hi, at) per text hash: the texts of this hash (the least and the greatest) and the rows that want it."""
    places = wanted.groupBy("th").agg(F.collect_list(F.struct(*cols)).alias("at"))  # bounded by a text
    texts = may_be(d, "th", places, "th").groupBy("th").agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
    return texts.join(places, "th").select("lo", "hi", "at")


def split_units(d: DataFrame, units: DataFrame, length: int, width: int, level: int) -> tuple[DataFrame, DataFrame]:
    """Units cut into runs of windows that have the anchor at places of one class, grouped by the bytes these share.

    Gives the new units and (v, sh, pv, psh, off): the old units that hold each of them.
    """
    @returning
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text, rows in zip(b["lo"], b["at"], strict=True):
                raw, out = text_bytes(text), []
                for x in rows:
                    buf = raw[x["p"]:x["p"] + x["c"] + length - 1]
                    spans = Spans(buf)
                    anchor = np.array([x["anchor"]]).view(U64)
                    places = np.flatnonzero(spans.windows(ANCHOR) == anchor)
                    window = np.arange(x["c"])
                    a = places[np.searchsorted(places, window)]  # the leftmost in each window
                    cls = (a - window) // width
                    start = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (cls[1:] != cls[:-1]))))
                    count = np.diff(np.append(start, x["c"]))
                    a, cls = a[start], cls[start]
                    around = spans.hash(a - cls * width, a - cls * width + length + 1 - width)
                    group = mix(around ^ mix(anchor + cls.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(width)))
                    content = spans.hash(start, start + count + length - 1)
                    out.append(pd.DataFrame({
                        "v": group.view(np.int64), "sh": content.view(np.int64), "anchor": x["anchor"], "c": count, "emit": x["emit"],
                        "th": x["th"], "p": x["p"] + start, "th2": x["th2"], "p2": x["p2"] + start,
                        "pv": x["v"], "psh": x["sh"], "off": start}))
                yield pd.concat(out)

    last = F.coalesce("hi", "lo")
    src = with_texts(d, units.select("*", "lo.*", last["th"].alias("th2"), last["p"].alias("p2")),
                     "v", "sh", "anchor", "c", "emit", "th", "p", "th2", "p2")
    parts = cut_lineage(src.mapInPandas(cut, "v long, sh long, anchor long, c int, emit boolean, th long, p int, th2 long, p2 int, "
                                             "pv long, psh long, off int"), f"suffix-parts{level}")
    new = parts.groupBy("v", "sh").agg(
        F.min("anchor").alias("anchor"), F.min("c").alias("c"), F.max("emit").alias("emit"), F.min(F.struct("th", "p")).alias("lo"),
        F.max(F.struct(F.col("th2").alias("th"), F.col("p2").alias("p"))).alias("hi"))
    new = new.withColumn("hi", F.when(F.col("hi") != F.col("lo"), F.col("hi")))
    sizes = new.groupBy("v").agg(F.sum((F.col("c") + length - 1) * F.when(F.col("hi").isNull(), 1).otherwise(2)).alias("size"),
                                 F.count(F.lit(1)).alias("m"), F.count("hi").alias("again"))
    new = cut_lineage(new.join(sizes.where("m > 1 or again > 0").select("v", "size"), "v"), f"suffix-units{level}")
    return new, parts.where("emit").select("v", "sh", "pv", "psh", "off")


def repeated_segments(d: DataFrame, chains: DataFrame, units: DataFrame, length: int) -> DataFrame:
    """(v, sh, runs): the repeated positions within segments, as flattened (start, end) runs; null: all of them."""
    held, maps = [], []
    for level, width in enumerate(WIDTHS):
        hot = units.where(F.col("size") > BLOCK_BYTES)
        if hot.isEmpty():
            break
        held.append(units.where(F.col("size") <= BLOCK_BYTES))
        units, back = split_units(d, hot, length, width, level)
        maps.append(back)
    for u in held:
        units = units.unionByName(u)

    key = F.array(F.struct("v", "sh", "c"))
    none = F.lit(None).cast("array<struct<v:long,sh:long,c:int>>")
    pairs = chains.select(F.xxhash64("lo.th", "lo.p").alias("b"), "c", "lo", "hi", "segs")
    pairs = pairs.unionByName(units.select(F.xxhash64(F.lit(2), "v").alias("b"), "c", "lo", "hi",
                                           F.when(F.col("emit"), key).otherwise(none).alias("segs")))
    total = pairs.agg(F.sum((F.col("c") + length - 1) * F.when(F.col("hi").isNull(), 1).otherwise(2)).alias("s")).first()["s"] or 0
    block = F.pmod("b", F.lit(max(1, math.ceil(total / BLOCK_BYTES)))).alias("block")
    sides = pairs.select(block, "c", F.explode(F.array(
        F.struct(F.col("lo.th").alias("th"), F.col("lo.p").alias("p"), F.lit(False).alias("second"), F.col("segs")),
        F.struct(F.col("hi.th").alias("th"), F.col("hi.p").alias("p"), F.lit(True).alias("second"), none.alias("segs")))).alias("x"))
    sides = sides.select("block", "c", "x.*").where("th is not null")

    @returning
    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 64):
                rows = []
                for lo, hi, places in zip(*(b[c].iloc[at:at + 64] for c in ("lo", "hi", "at")), strict=True):
                    first = text_bytes(lo).tobytes()
                    other = first if hi == lo else text_bytes(hi).tobytes()
                    rows += [(x["block"], (other if x["second"] else first)[x["p"]:x["p"] + x["c"] + length - 1], x["segs"])
                             for x in places]
                yield pd.DataFrame(rows, columns=["block", "s", "segs"])

    def sort_block(b: pd.DataFrame) -> pd.DataFrame:
        hits = repeated_in([np.frombuffer(s, np.uint8) for s in b["s"]], length)
        out = []
        for segs, hit in zip(b["segs"], hits, strict=True):
            at = 0
            for x in segs if segs is not None else ():
                mine = hit[at:at + x["c"]]
                at += x["c"]
                if mine.any():
                    out.append((x["v"], x["sh"], None if mine.all() else _runs(mine).astype(np.int32), x["c"]))
        return pd.DataFrame(out, columns=["v", "sh", "runs", "c"])

    marks = cut_lineage(with_texts(d, sides, "block", "c", "p", "second", "segs")
                        .mapInPandas(fetch, "block long, s binary, segs array<struct<v:long,sh:long,c:int>>")
                        .groupBy("block").applyInPandas(sort_block, "v long, sh long, runs array<int>, c int"), "suffix-marked")
    out, level_marks = marks.select("v", "sh", "runs"), marks
    for back in reversed(maps):  # marks of parts, as marks of what was split
        whole = F.coalesce("runs", F.array(F.lit(0), F.col("c")))
        level_marks = level_marks.join(back, ["v", "sh"]).select(
            F.col("pv").alias("v"), F.col("psh").alias("sh"), F.transform(whole, lambda x: x + F.col("off")).alias("runs"), "c")
        out = out.unionByName(level_marks.select("v", "sh", "runs"))
        level_marks = level_marks.unionByName(marks)
    return cut_lineage(out, "suffix-partly") if maps else out
