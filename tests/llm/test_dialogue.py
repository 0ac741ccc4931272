"""Conversation repair against an enumeration of all edits and a plain version of the contract; parts; odd rows."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from linguaspark.llm import dialogue, queries

GOOD = re.compile(r"(s?(ua)+)?")
PREFIX = re.compile(r"(s?(ua)*u?)")


def cheapest(symbols):
    """(cost, audit) by trying every series of edits whose roles may still become good."""
    best = (4 * len(symbols) + 1, "")

    def go(i, roles, cost, audit, inserts):
        nonlocal best
        if cost > best[0] or not PREFIX.fullmatch(roles):
            return
        if i == len(symbols) and GOOD.fullmatch(roles):
            best = min(best, (cost, audit))
        if inserts < 3:
            for c in "ua":
                go(i, roles + c, cost + 3, audit + "I", inserts + 1)
        if i < len(symbols):
            s = symbols[i]
            go(i + 1, roles, cost + 4, audit + "D", 0)
            if s != "d":
                more = 3 * s.isupper()
                if s.lower() != "o":
                    go(i + 1, roles + s.lower(), cost + more, audit + "K", 0)
                for c in "ua":
                    go(i + 1, roles + c, cost + 3 + more, audit + "R", 0)
    go(0, "", 0, "", 0)
    return best


def viterbi(symbols):
    """The same for long conversations: per state of the pattern, the least (cost, whole audit)."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "p", ("p", "u"): "u"}
    live = {"": (0, "")}
    for s in [*symbols, None]:
        wide = dict(live)
        for _ in range(3):
            for st, (c, a) in list(wide.items()):
                for r in "ua":
                    if (st, r) in step:
                        t = step[st, r]
                        wide[t] = min(wide.get(t, (10**9, "")), (c + 3, a + "I"))
        if s is None:
            return min(wide[t] for t in ("", "p") if t in wide)
        # an insert before the row and one after the last row are the same place: start from all of them
        new = {}
        for st, (c, a) in wide.items():
            ways = [(st, 4, "D")]
            if s != "d":
                more = 3 * s.isupper()
                ways += [(step[st, s.lower()], more, "K")] if (st, s.lower()) in step else []
                ways += [(step[st, r], 3 + more, "R") for r in "ua" if (st, r) in step]
            for t, cost, letter in ways:
                new[t] = min(new.get(t, (10**9, "")), (c + cost, a + letter))
        live = new


def test_repair_equals_enumeration():
    rng = random.Random(1)
    cases = ["", "s", "u", "a", "ua", "sua", "au", "uu", "aa", "ss", "o", "d", "dd", "U", "A", "SUA"]
    cases += ["".join(rng.choice("suaoSUAOd") for _ in range(rng.randint(1, 5))) for _ in range(250)]
    for c in cases:
        assert dialogue.repair_symbols(c) == cheapest(c), c


def test_repair_equals_viterbi_and_parts_join():
    rng = random.Random(2)
    for n in [0, 1, 7, 40, 40, 40, 300]:
        s = "".join(rng.choice("suauauauaoSUAOd") for _ in range(n))
        want = dialogue.repair_symbols(s)
        assert want == viterbi(s)
        for _ in range(5):
            cuts = sorted(rng.randint(0, n) for _ in range(rng.randint(0, 4)))
            parts = [s[a:b] for a, b in zip([0, *cuts], [*cuts, n])]
            assert dialogue.join_ways(dialogue.ways_through(p) for p in parts) == want
    assert dialogue.repair_symbols("uaSu" * 20000)[1].count("K") > 0


def plain(rows):
    """The contract, conversation by conversation: conv_id -> the query's other columns."""
    said = lambda x: " " if x is None else str(x)
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if kind == 4:
            role = "user"
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, rs in convs.items():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [r[0] for r in rs if r[0] is not None]
        counts, seen, symbols = [0, 0, 0], set(), ""
        for _, role, text in rs:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            s = role[0] if role[:1] in ("s", "u", "a") else "o"
            fault = 0 if not solid else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            symbols += "d" if fault in (0, 1) else s.upper() if fault == 2 else s
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:]))
        cost, audit = viterbi(symbols)
        lines, it, roles = [], iter(rs), ""
        for e in audit:
            role, text = ("", "") if e == "I" else next(it)[1:]
            if e in "IR":
                role = "assistant" if roles.endswith("u") else "user"
            if e != "D":
                roles += role[0]
                lines.append(f"{role}:{text}")
        assert GOOD.fullmatch(roles)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


def odd_rows():
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None, "", "usher"]),
             rng.choice(["Yes.", "No", "", " \t", None, "Maybe?\n", "é!", "end. ", "Hm. " * 50]))
            for c in range(400) for t in rng.sample(range(12), rng.randint(1, 9))]
    rows += [(1000, t, "user" if t % 2 == 0 else "assistant", rng.choice(["Same.", f"No {t}."])) for t in range(3000)]  # a third of all rows
    rows += [(1001, 5, "user", "Again.")] * 700 + [(1002, None, "user", f"x{i}.") for i in range(30)] + [(1002, 3, "assistant", "y.")] * 2
    rows += [(None, 0, "user", "A."), (None, 1, "assistant", "B."), (None, None, None, None), (-5, 2**40, "user", "q.")]
    return rows


@pytest.mark.parametrize("partitions", ["1", "40"])
def test_repair_of_damage_equals_the_plain_version(spark, partitions):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "conv_id long, turn long, role string, text string, Text string, cost int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = result(dialogue.repair(dialogue.damage(df), copies="copies")[0])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = plain(rows)
    assert got.keys() == want.keys()
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(queries.op13_dialogue(spark, sf)) == plain(rows)


def test_edited_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "user", ""), (2, 0, "user", "Q.")],
                               "conv_id long, turn long, role string, text string")
    summary, rows = dialogue.repair(df)
    got = dialogue.edited_rows(rows, summary.select(F.col("conv_id").alias("conv"), "audit")).orderBy("conv", "pos").collect()
    assert [(r.conv, r.edit, r.role, r.text) for r in got] == [
        (1, "K", "system", "S."), (1, "I", "user", ""), (1, "K", "assistant", "A."), (1, "D", "user", ""),
        (2, "K", "user", "Q."), (2, "I", "assistant", "")]
    assert dialogue.repair(df.limit(0))[0].count() == 0
