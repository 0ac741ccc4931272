"""Secret scans: fixed patterns plus a token-efficiency test for random strings.

A subword vocabulary spells ordinary text in few tokens. Random keys share
no longer pieces with it, so their characters-per-token ratio is low. Every
long unbroken run of key characters is cut at the spans of the fixed
patterns, and every piece left is encoded with a tiktoken vocabulary; pieces
below a ratio are reported, after known digests and identifiers are set
aside. Ordinary text joined to a key lifts the ratio of the whole, so of a
piece that is not reported the parts between '/', '_', '=', '+' and '-' are
judged: the neighbouring parts that together lie furthest below the ratio,
however long the piece is. A part of under 20 characters, and a key that no
separator parts from ordinary letters which lift it over the ratio, are not
reported.

Defined cases: null or empty text has no span; a text of any length is
scanned whole; repeated rows are scanned like any other; a result has one
row per input row and reads only the two named columns, whatever else the
table holds.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linguaspark.llm.common import pick, returning

# The patterns and least lengths of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of [0-9a-f] of 24 or more
KINDS = ("assign", "access", "hex", "random")

LEAST = 20
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
UNIT = re.compile(r"[A-Za-z0-9]+|[+/_=-]+")
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
IDENTIFIER = re.compile(
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"  # UUID
    r"|[0-9_+/=-]+"                                                                  # numbers, dates, rules
    r"|(?:[A-Za-z]+[0-9]{0,4}[_/=+-]+)+[A-Za-z]*[0-9]{0,4}")                         # words_joined-like/this
CONSTANT = re.compile(r"[A-Z]+[0-9]{0,4}")  # capitals: the vocabulary knows words in small letters, so these are judged so
# UUIDs and digests between separators: parts on either side are judged without them
SET_ASIDE = re.compile(r"(?<![A-Za-z0-9])(?:[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}"
                       + "".join(f"|[0-9a-f]{{{n}}}|[0-9A-F]{{{n}}}" for n in sorted(DIGEST_LENGTHS)) + ")(?![A-Za-z0-9])")
WINDOW = 512  # longer runs are encoded in windows of this many characters


@lru_cache(maxsize=4)
def _encoder(ranks_file: bytes, pattern: str):
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def n_tokens(run: str, encoder) -> int:
    if CONSTANT.fullmatch(run):
        run = run.lower()
    return sum(len(encoder.encode_ordinary(run[i:i + WINDOW])) for i in range(0, len(run), WINDOW))


def chars_per_token(run: str, encoder) -> float:
    return len(run) / n_tokens(run, encoder)


def is_known(run: str) -> bool:
    """Digests of the usual lengths and identifiers, which are no secrets by themselves."""
    return len(run) in DIGEST_LENGTHS and bool(DIGEST.fullmatch(run)) or bool(IDENTIFIER.fullmatch(run))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def is_random(run: str, encoder, max_ratio: float) -> bool:
    return len(run) >= LEAST and not is_known(run) and chars_per_token(run, encoder) < max_ratio


def best_parts(scores: list[float]) -> list[tuple[int, int]]:
    """All maximal scoring stretches (Ruzzo and Tompa), as index ranges in order; linear time."""
    found: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, first, end, nearest entry of a lesser sum before
    total = 0.0
    for i, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        first = i
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][0] >= before:
                j = found[j][4]
            if j < 0 or found[j][1] >= total:
                break
            before, _, first, _, link = found[j]
            del found[j:]
            j = link
        found.append((before, total, first, i + 1, j))
    return [(first, end) for _, _, first, end, _ in found]


def random_parts(run: str, encoder, max_ratio: float, cut: bool = False) -> list[tuple[int, int]]:
    """(start, end) of what is random in a run: all of it, or else parts between separators.

    A piece that was ``cut`` from a run may be known but for the separators at its ends.
    """
    if is_random(run, encoder, max_ratio) and not (cut and is_known(run.strip("+/_=-"))):
        return [(0, len(run))]
    out, at = [], 0
    for a, b in [*(m.span() for m in SET_ASIDE.finditer(run)), (len(run), len(run))]:
        units = [m.span() for m in UNIT.finditer(run, at, a)] if a - at >= LEAST else []
        at = b
        scores = [max_ratio * n_tokens(run[s:e], encoder) - (e - s) for s, e in units]
        for first, end in best_parts(scores):
            words = [i for i in range(first, end) if run[units[i][0]].isalnum()]
            if not words:
                continue
            s, e = units[words[0]][0], units[words[-1]][1]
            while e < a and run[e] == "=" and e - units[words[-1]][1] < 2:  # padding
                e += 1
            if is_random(run[s:e], encoder, max_ratio):
                out.append((s, e))
            else:  # too short, or known as a whole: a random word in it still counts
                out += [units[i] for i in words if is_random(run[slice(*units[i])], encoder, max_ratio)]
    return out


def random_spans(text: str, encoder, max_ratio: float, base=()) -> list[tuple[int, int, int]]:
    """Runs of key characters, or parts of them, with few characters per token, outside the base spans."""
    out, taken, first = [], sorted((s, e) for s, _, e in base), 0
    for m in RUN.finditer(text):
        at, end = m.span()
        while first < len(taken) and taken[first][1] <= at:
            first += 1
        pieces, i = [], first
        while i < len(taken) and taken[i][0] < end:
            pieces.append((at, taken[i][0]))
            at = max(at, taken[i][1])
            i += 1
        pieces.append((at, end))
        for s, e in pieces:
            if e - s >= LEAST:
                out += [(s + a, 3, s + b) for a, b in random_parts(text[s:e], encoder, max_ratio, (s, e) != m.span())]
    return out


def spell(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCHEMA = "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string, redacted string"


def scan(df: DataFrame, ranks: str, pattern: str, text: str = "text", keep: dict[str, str] | None = None,
         max_ratio: float = 2.0, redact: bool = False, mask: str = "[SECRET]") -> DataFrame:
    """One row per row of ``df``: the ``keep`` columns (output name -> column) and the found spans.

    ``ranks`` is the place of a tiktoken vocabulary (its file, about 1 MB, is
    read once on the driver and broadcast), ``pattern`` its split pattern.
    ``spans`` lists ``kind:start:end`` in code points by start, then kind;
    ``redacted`` is the text with each span replaced by ``mask`` (null unless
    ``redact``).
    """
    keep = keep if keep is not None else {"doc_id": "doc_id"}
    sc = df.sparkSession.sparkContext
    with open(ranks, "rb") as f:
        shared = sc.broadcast(f.read())

    @F.pandas_udf(SCHEMA)
    @returning
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(shared.value, pattern)
        for texts in batches:
            rows = []
            for given in texts:
                t = given or ""
                base = base_spans(t)
                extra = random_spans(t, encoder, max_ratio, base)
                every = sorted(base + extra)
                count = [0, 0, 0, 0]
                for _, k, _ in every:
                    count[k] += 1
                rows.append((*count, hashlib.sha256(spell(base).encode()).hexdigest(), spell(every),
                             cover(t, every, mask) if redact and given is not None else None))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_random",
                                              "base_sha256", "spans", "redacted"])
        _encoder.cache_clear()  # workers are used again by other stages

    d = pick(df, **{f"k_{c}": src for c, src in keep.items()}, text=text)
    d = d.withColumn("r", found("text"))
    return d.select(*[F.col(f"k_{c}").alias(c) for c in keep], "r.*")


def cover(text: str, spans, mask: str) -> str:
    """The text with the union of the spans replaced; overlapping spans become one mask."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    out.append(text[at:])
    return "".join(out)
