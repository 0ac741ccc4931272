"""Repair of conversation structure by generalised LR parsing.

Rows of a conversation are symbols (the first letter of the role); a good
conversation has the role grammar ``RULES``: an optional system turn, then
user and assistant in turns, or nothing at all. Repairing edits are Keep (0),
Rerole to user or assistant (3), Delete (4; the only edit of a blank or
duplicate row) and Insert of an empty user or assistant turn anywhere (3);
a truncated row that is not deleted adds 3.

Method: the grammar's LR automaton is built from ``RULES``. All its parses
under all edits go on side by side in a graph-structured stack: a node is
an LR state and the node below it, equal nodes are one object, so stacks
share what is below. Equal stack tops (over the same stack) merge to the one
of minimum (cost, audit), the audit being the initials of the edits so far.
Before a row any shifts of inserted turns are tried, then the row's own
edits. Of audits only their order counts: those of the live tops have all
read the same rows and end in a row's edit, so none begins another, and the
order of two grown audits is that of the tops they grew from, or else of the
letters added. A set of live tops with relative costs and order is therefore
one of few, and what a row makes of it is worked out once and remembered; a
row leaves one reference behind, and the audit is read backwards from these.

Spark's part: equal rows of a conversation and turn are counted before the
shuffle, the first turn of each (role, text) tells duplicates, and the rows
are range-partitioned by conversation and turn, so a conversation may lie in
many tasks. One inside a single task is done there. A part of one that
touches a partition's edge gives, for each stack it may start on, the cheapest
way to each stack it may end on; these ways are joined in order (no texts),
and the texts of only these conversations are read once more.

Bounds: a task holds the rows of one partition's conversation at a time;
ways carry one letter a row and pair of stacks. Contracts of one value for a
conversation set the rest: its audit is one string, and its digest is
streamed through one task, batch by batch.

Defined cases: a null role or text counts as one space; rows of equal turn
(null turns are one turn, and come first) stand by role, then text; ``copies`` of 0
keep a conversation alive that has no rows; a null id is a conversation of
its own; a conversation without rows has zeros, an empty audit and the digest
of the empty text; roles whose first letter is not s, u or a fit nowhere
(Delete or Rerole), an empty role likewise; an empty table gives no rows;
other columns are not read, clashing names are resolved as in ``pick``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from linguaspark.llm.common import cut_lineage, pick, returning

#: The role grammar. Left-recursive, so a stack stays short however long the conversation.
RULES = (("talk", ()), ("talk", ("pairs",)), ("talk", ("s", "pairs")), ("pairs", ("u", "a")), ("pairs", ("pairs", "u", "a")))
COST = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED = 3
ROLE = {"u": "user", "a": "assistant"}
MOST_INSERTS = 3  # in a row: two reach any stack from any other, with one to spare

Node = tuple  # (LR state, node below or None); equal nodes are equal values
EMPTY: Node = (0, None)


@lru_cache(maxsize=1)
def automaton() -> tuple[dict, dict]:
    """(goto, reductions) of the LR(0) automaton: (state, symbol) -> state, state -> rules to reduce by."""
    heads = {h for h, _ in RULES}
    rules = (("goal", ("talk",)), *RULES)

    def closure(items):
        todo, out = list(items), set(items)
        while todo:
            r, dot = todo.pop()
            body = rules[r][1]
            if dot < len(body) and body[dot] in heads:
                for k, (h, _) in enumerate(rules):
                    if h == body[dot] and (k, 0) not in out:
                        out.add((k, 0))
                        todo.append((k, 0))
        return frozenset(out)

    states = [closure({(0, 0)})]
    goto, reductions = {}, {}
    for i, state in enumerate(states):  # grows as states are found
        reductions[i] = [rules[r] for r, dot in sorted(state) if dot == len(rules[r][1])]
        for symbol in sorted({rules[r][1][dot] for r, dot in state if dot < len(rules[r][1])}):
            to = closure({(r, dot + 1) for r, dot in state if dot < len(rules[r][1]) and rules[r][1][dot] == symbol})
            if to not in states:
                states.append(to)
            goto[i, symbol] = states.index(to)
    return goto, reductions


def reduced(top: Node) -> set[Node]:
    """All tops that reductions reach from ``top``, itself included."""
    goto, reductions = automaton()
    out, todo = {top}, [top]
    while todo:
        node = todo.pop()
        for head, body in reductions[node[0]]:
            below = node
            for _ in body:
                below = below[1]
            if (below[0], head) in goto:
                new = (goto[below[0], head], below)
                if new not in out:
                    out.add(new)
                    todo.append(new)
    return out


def settled(top: Node) -> Node:
    """``top`` reduced as long as a reduction is all that its state allows, so that like stacks become equal."""
    goto, reductions = automaton()
    while len(reductions[top[0]]) == 1 and not any(state == top[0] for state, _ in goto):
        head, body = reductions[top[0]][0]
        below = top
        for _ in body:
            below = below[1]
        if (below[0], head) not in goto:
            break
        top = (goto[below[0], head], below)
    return top


@lru_cache(maxsize=None)
def shifted(top: Node, symbol: str) -> tuple[Node, ...]:
    """The tops after reading ``symbol`` on ``top``, reductions tried before it."""
    goto, _ = automaton()
    return tuple(sorted({settled((goto[t[0], symbol], t)) for t in reduced(top) if (t[0], symbol) in goto}, key=repr))


@lru_cache(maxsize=None)
def accepts(top: Node) -> bool:
    goto, _ = automaton()
    return any(t == (goto[0, "talk"], EMPTY) for t in reduced(top))


@lru_cache(maxsize=None)
def inserted(top: Node) -> tuple[tuple[int, Node], ...]:
    """(how many, top after) for every series of inserted turns on ``top``."""
    out, tops = {(0, top)}, {top}
    for n in range(1, MOST_INSERTS + 1):
        tops = {t for b in tops for c in ROLE for t in shifted(b, c)}
        out |= {(n, t) for t in tops}
    return tuple(sorted(out, key=repr))


@lru_cache(maxsize=None)
def edits(symbol: str) -> tuple[tuple[str, int, str | None], ...]:
    """(letter, cost, symbol read) of the edits of a row: s, u, a, o(ther), capital if truncated; d: can only be deleted."""
    if symbol == "d":
        return (("D", COST["D"], None),)
    own, extra = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    return (("D", COST["D"], None), *((("K", extra, own),) if own != "o" else ()), *(("R", COST["R"] + extra, c) for c in ROLE))


#: The live tops, each with its cost above the least and its place in the order of audits.
Front = tuple[tuple[Node, int, int], ...]
START: Front = ((EMPTY, 0, 0),)
_STEPS: dict[tuple[Front, str], tuple] = {}


def step(front: Front, symbol: str) -> tuple[Front, int, tuple[tuple[int, str], ...]]:
    """What a row makes of the live tops: (new tops, growth of the least cost, (former top, letters added) of each)."""
    known = _STEPS.get((front, symbol))
    if known:
        return known
    best: dict[Node, tuple] = {}
    for i, (top, cost, place) in enumerate(front):
        for n, mid in inserted(top):
            for letter, price, read in edits(symbol):
                for to in (mid,) if read is None else shifted(mid, read):
                    way = (cost + n * COST["I"] + price, place, "I" * n + letter, i)
                    if to not in best or way < best[to]:
                        best[to] = way
    order = sorted(best, key=lambda t: best[t][1:3])
    least = min(w[0] for w in best.values())
    tops = sorted(best, key=repr)
    out = (tuple((t, best[t][0] - least, order.index(t)) for t in tops), least, tuple((best[t][3], best[t][2]) for t in tops))
    if len(_STEPS) < 1 << 16:
        _STEPS[front, symbol] = out
    return out


def read(symbols: Iterable[str], front: Front = START) -> tuple[Front, int, list]:
    """The tops after all symbols, the least cost, and what each row left to read the audits back from."""
    cost, trail = 0, []
    for s in symbols:
        front, more, back = step(front, s)
        cost += more
        trail.append(back)
    return front, cost, trail


def audit_of(trail: list, i: int) -> str:
    """The letters that led to top ``i``."""
    parts = []
    for back in reversed(trail):
        i, letters = back[i]
        parts.append(letters)
    return "".join(reversed(parts))


def finish(front: Front) -> tuple[int, int, str]:
    """(cost, top, letters) of the cheapest way to an accepted conversation."""
    cost, _, letters, i = min((cost + n * COST["I"], place, "I" * n, i) for i, (top, cost, place) in enumerate(front)
                              for n, t in inserted(top) if accepts(t))
    return cost, i, letters


@lru_cache(maxsize=1 << 14)
def repair_symbols(symbols: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair, the ASCII-least of equal ones."""
    front, cost, trail = read(symbols)
    more, i, letters = finish(front)
    return cost + more, audit_of(trail, i) + letters


@lru_cache(maxsize=1)
def stacks() -> tuple[Node, ...]:
    """All stacks that can be live between rows."""
    out, todo = {EMPTY}, [EMPTY]
    while todo:
        top = todo.pop()
        new = {t for c in "sua" for t in shifted(top, c)} - out
        out |= new
        todo += new
    return tuple(sorted(out, key=repr))


def ways_through(symbols: str) -> list[tuple[int, int, int, str]]:
    """(first stack, last stack, cost, audit) of the cheapest way through a part of a conversation, by stack numbers."""
    out = []
    for a, top in enumerate(stacks()):
        front, cost, trail = read(symbols, ((top, 0, 0),))
        out += [(a, stacks().index(t), cost + more, audit_of(trail, i)) for i, (t, more, _) in enumerate(front)]
    return out


def join_ways(parts: Iterable[list[tuple[int, int, int, str]]]) -> tuple[int, str]:
    """(cost, audit) of a conversation from the ways through its parts, in order."""
    live = {stacks().index(EMPTY): (0, 0)}  # stack -> (cost, place in the order of audits)
    trail = []
    for ways in parts:
        best: dict[int, tuple] = {}
        for a, b, cost, audit in ways:
            if a in live:
                way = (live[a][0] + cost, live[a][1], audit, a)
                if b not in best or way < best[b]:
                    best[b] = way
        order = sorted(best, key=lambda t: best[t][1:3])
        trail.append({t: (best[t][3], best[t][2]) for t in best})
        live = {t: (best[t][0], order.index(t)) for t in best}
    tops = sorted(live)
    more, i, letters = finish(tuple((stacks()[t], *live[t]) for t in tops))
    at, out = tops[i], [letters]
    for back in reversed(trail):
        at, audit = back[at]
        out.append(audit)
    return more, "".join(reversed(out))


def repaired(rows: Iterator[tuple[str, str, int]], audit: str) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the edited conversation in order; deleted rows keep their role. Rows are (role, text, copies)."""
    one = ((role, text) for role, text, n in rows for _ in range(n))
    expected = ""  # the last role's letter: it tells what a new or changed turn must be
    for letter in audit:
        role, text = next(one) if letter != "I" else ("", "")
        if letter in "RI":
            role = ROLE["a" if expected == "u" else "u"]
        if letter != "D":
            expected = role[:1]
        yield letter, role, text


class Digest:
    """SHA-256 of ``role:text`` lines joined by newlines, fed one by one."""

    def __init__(self):
        self.sha, self.some = hashlib.sha256(), False

    def add(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.some else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.some = True


SOLID, ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
COUNTS = ("blank", "duplicate", "truncated", "illegal")
LEGAL = {"su", "ua", "au"}


def prepare(conversations: DataFrame, copies: str | None) -> DataFrame:
    """One row per distinct (conv, turn, role, text) with ``n`` copies, ``symbol`` of the first copy, and what it is.

    ``fault`` of the first copy: 0 none, 1 blank, 2 duplicate, 3 truncated; all further copies are duplicates
    (or blank as well). Texts of rows without copies are not carried.
    """
    d = pick(conversations, conv="conv_id", turn="turn", role="role", text="text", **({"n": copies} if copies else {}))
    if not copies:
        d = d.withColumn("n", F.lit(1))
    some = F.coalesce(F.col("n"), F.lit(0)) > 0
    d = d.select("conv", F.when(some, F.col("turn")).alias("turn"), F.when(some, F.coalesce("role", F.lit(" "))).otherwise("").alias("role"),
                 F.when(some, F.coalesce("text", F.lit(" "))).otherwise("").alias("text"), F.when(some, F.col("n")).otherwise(0).cast("long").alias("n"))
    rows = d.groupBy("conv", "turn", "role", "text", (F.col("n") > 0).alias("live")).agg(F.sum("n").alias("n"))
    rows = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text"), "t": F.struct(F.col("turn").isNotNull().alias("later"), "turn")})
    # hot keys (one answer on many turns) are combined to one row before the shuffle; only texts on several turns matter
    first = (rows.where("live").groupBy("conv", "role", "h1", "h2").agg(F.min("t").alias("t1"), F.count(F.lit(1)).alias("turns"))
             .where("turns > 1").drop("turns").toDF("conv1", "role1", "h11", "h21", "t1"))
    rows = rows.join(first, F.col("conv").eqNullSafe(F.col("conv1")) & (F.col("role") == F.col("role1")) & (F.col("h1") == F.col("h11"))
                     & (F.col("h2") == F.col("h21")), "left")
    fault = F.when(~F.col("text").rlike(SOLID), 1).when(F.col("t1") < F.col("t"), 2).when(~F.col("text").rlike(ENDED), 3).otherwise(0)
    rows = rows.select("conv", "turn", "role", "text", "n", fault.alias("fault"))
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    return rows.withColumn("symbol", F.when(F.col("fault").isin(1, 2), "d").when(F.col("fault") == 3, F.upper(initial)).otherwise(initial))


class Tally:
    """What is counted of a conversation's rows (or of a part of them), row by row."""

    def __init__(self):
        self.counts = dict.fromkeys(COUNTS, 0)
        self.symbols: list[str] = []
        self.least = self.most = self.first = self.last = None
        self.turns = 0

    def add(self, turn, role, n, fault, symbol) -> None:
        if not n:
            return
        c = self.counts
        if fault:
            c[COUNTS[fault - 1]] += 1
        c["blank" if fault == 1 else "duplicate"] += n - 1
        initial = role[:1]
        c["illegal"] += n - 1  # copies: equal initials
        if self.last is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            c["illegal"] += 1
        self.last = initial
        if turn is not None:
            if self.least is None:
                self.least = turn
            self.turns += turn != self.most
            self.most = turn
        self.symbols.append(symbol + "d" * (n - 1))


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
PART = ("least: long, most: long, turns: long, first: string, last: string, blank: long, duplicate: long, truncated: long, illegal: long, "
        "ways: array<struct<a: long, b: long, cost: long, audit: string>>")


def _schema(rows: DataFrame, more: str) -> StructType:
    """The type of the conversation's id, and further columns."""
    return StructType([rows.schema["conv"], *StructType.fromDDL(more).fields])


def _gaps(least, most, turns) -> int:
    return 0 if least is None else most - least + 1 - turns


def _rows(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in names), strict=True)


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 500) -> Iterator[pa.RecordBatch]:
    chunk = []
    for r in rows:
        chunk.append(r)
        if len(chunk) == size:
            yield pa.RecordBatch.from_pylist(chunk, schema)
            chunk = []
    if chunk:
        yield pa.RecordBatch.from_pylist(chunk, schema)


def _in_order(rows: DataFrame) -> DataFrame:
    """Conversations summed up where they lie; those at a partition's edge as parts (``part`` counts them, sum is null)."""
    out = _schema(rows, f"closed boolean, part long, {SUMMARY}, sha string, p struct<{PART}>")
    arrow = to_arrow_schema(out)
    names = ("conv", "turn", "role", "text", "n", "fault", "symbol")

    def whole(conv, tally, kept):
        cost, audit = repair_symbols("".join(tally.symbols)) if sum(map(len, tally.symbols)) < 1000 else \
            repair_symbols.__wrapped__("".join(tally.symbols))
        digest = Digest()
        for letter, role, text in repaired(iter(kept), audit):
            if letter != "D":
                digest.add(role, text)
        return {"conv": conv, "closed": True, "gaps": _gaps(tally.least, tally.most, tally.turns), **tally.counts, "cost": cost, "audit": audit,
                "sha": digest.sha.hexdigest()}

    def part(conv, tally, number):
        ways = [dict(zip(("a", "b", "cost", "audit"), w, strict=True)) for w in ways_through("".join(tally.symbols))]
        return {"conv": conv, "closed": False, "part": number, "p": {"least": tally.least, "most": tally.most, "turns": tally.turns,
                                                                     "first": tally.first, "last": tally.last, **tally.counts, "ways": ways}}

    def summed(rows):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId()  # range partitions: numbered in order
        held = None
        for i, (conv, group) in enumerate(groupby(rows, key=lambda r: r[0])):
            if held and i > 1:
                yield whole(*held)  # neither the partition's first nor its last conversation
            tally, kept = Tally(), []
            for _, turn, role, text, n, fault, symbol in group:
                tally.add(turn, role, n, fault, symbol)
                if i and n:
                    kept.append((role, text, n))
            if i == 0:
                yield part(conv, tally, number)
            held = (conv, tally, kept)
        if held and i:
            yield part(held[0], held[1], number)

    @returning
    def run(batches):
        yield from _batches(summed(_rows(batches, names)), arrow)

    keys = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role"]
    return (rows.repartitionByRange(*keys, F.substring("text", 1, 40)).sortWithinPartitions(*keys, "text").mapInArrow(run, out))


def _joined(parts: DataFrame) -> DataFrame:
    """One row for each conversation that lies in several tasks, from its parts in order."""
    schema = _schema(parts, SUMMARY)

    def one(conv, group):
        group = sorted(group, key=lambda r: r[0])
        c = dict.fromkeys(COUNTS, 0)
        least = most = last = None
        turns = 0
        for _, p in group:
            for k in COUNTS:
                c[k] += p[k]
            if p["first"] is not None:
                c["illegal"] += last is not None and last + p["first"] not in LEGAL
                last = p["last"]
            if p["least"] is not None:
                turns += p["turns"] - (p["least"] == most)
                least, most = (p["least"] if least is None else least), p["most"]
        cost, audit = join_ways([(w["a"], w["b"], w["cost"], w["audit"]) for w in p["ways"]] for _, p in group)
        return {"conv": conv, "gaps": _gaps(least, most, turns), **c, "cost": cost, "audit": audit}

    @returning
    def run(batches):
        rows = _rows(batches, ("conv", "part", "p"))
        yield from _batches((one(conv, [r[1:] for r in g]) for conv, g in groupby(rows, key=lambda r: r[0])), to_arrow_schema(schema))

    return parts.select("conv", "part", "p").repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "part").mapInArrow(run, schema)


def edited_rows(rows: DataFrame, audits: DataFrame, digest: bool = False) -> DataFrame:
    """Applies audits to prepared rows: (conv, pos, edit, role, text) of every kept, changed, inserted or deleted row.

    With ``digest`` one row (conv, sha) a conversation instead. The audit leads its
    conversation's rows into the task as their first row; texts are streamed.
    """
    schema = _schema(rows, "sha string" if digest else "pos long, edit string, role string, text string")
    every = rows.where("n > 0").select("conv", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "n").unionByName(
        audits.select("conv", "audit", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"),
                      F.lit("").alias("text"), F.lit(0).cast("long").alias("n")))

    def made(all_rows):
        for conv, group in groupby(all_rows, key=lambda r: r[0]):
            audit = next(group)[1]
            sha = Digest()
            for pos, (letter, role, text) in enumerate(repaired(((r[3], r[4], r[5]) for r in group), audit)):
                if digest and letter != "D":
                    sha.add(role, text)
                elif not digest:
                    yield {"conv": conv, "pos": pos, "edit": letter, "role": role, "text": text}
            if digest:
                yield {"conv": conv, "sha": sha.sha.hexdigest()}

    @returning
    def run(batches):
        yield from _batches(made(_rows(batches, ("conv", "audit", "turn", "role", "text", "n"))), to_arrow_schema(schema))

    nulls_first = [F.col(c).asc_nulls_first() for c in ("conv", "turn")]
    return (every.repartition("conv").sortWithinPartitions(nulls_first[0], F.col("audit").asc_nulls_last(), nulls_first[1], "role", "text")
            .mapInArrow(run, schema))


def repair(conversations: DataFrame, copies: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(summary, rows): one summary row per conversation, and the prepared rows that ``edited_rows`` takes with it.

    summary: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256. ``copies`` names a column with the number of times a row stands
    there, one after the other (0: not at all, but the conversation is reported).
    """
    rows = cut_lineage(prepare(conversations, copies), "dialogue-rows")
    done = cut_lineage(_in_order(rows), "dialogue-sums")
    open_ones = cut_lineage(_joined(done.where("not closed")), "dialogue-open")  # at most two a partition
    theirs = rows.join(F.broadcast(open_ones.select(F.col("conv").alias("open"))), F.col("conv").eqNullSafe(F.col("open")), "left_semi")
    digests = edited_rows(theirs, open_ones, digest=True).toDF("conv2", "sha")
    joined = open_ones.join(digests, F.col("conv").eqNullSafe(F.col("conv2")))
    names = [f.split()[0] for f in SUMMARY.split(", ")]
    out = done.where("closed").select("conv", *names, "sha").unionByName(joined.select("conv", *names, "sha"))
    return out.toDF("conv_id", *names, "repaired_sha256"), rows


def damage(conversations: DataFrame) -> DataFrame:
    """Test damage by crc32 of ``conv_id:turn`` modulo 20, nulls as one space; adds ``copies``.

    0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 doubles it, 4 makes it a user turn.
    """
    d = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text")

    def said(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat_ws(":", said("conv_id"), said("turn")).cast("binary")) % 20
    return d.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(said("role")).alias("role"),
                    F.when(kind == 1, "").when(kind == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text")).alias("text"),
                    F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))
