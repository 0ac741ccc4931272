"""SentencePiece encoding and decoding of merge-type models, exactly, by backtracking.

Merge-type (BPE) encoding applies the best-scored merge again and again.
A sequence of pieces is that encoding exactly if every two neighbours are
what re-merging their joined text gives. So a text can be encoded from left
to right: take the longest piece that starts here (found for all places by
one Aho-Corasick pass), accept it if re-merging it with the piece before
keeps both apart, otherwise try the next shorter one; where none is left,
mark the place as failed in a bitfield and go back one piece. A failed place
is never entered again, so the work is linear in the text.

Texts are cut first where no piece of the vocabulary spans two neighbouring
characters (so no merge can cross), and the resulting units, words mostly,
are kept in a bounded dictionary per task.

Runs of the space mark are pieces of one equal and least score, so they merge
after everything else; ``_spaces`` merges them plainly.

Defined cases: a null text is encoded like an empty one (begin and end ids
only); characters without a piece become byte pieces; decoding turns byte
pieces back into text, bad UTF-8 into U+FFFD; one row out per row in.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linguaspark.llm.common import pick, returning

SPACE = "▁"
REMEMBERED = 100_000  # units, and piece pairs, in each of the two generations a task keeps (about 20 and 15 MB)


class _Known(dict):
    """Ids of the units met lately: those of this generation, and of the one before, which a unit met again leaves."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.before = pieces, {}

    def __missing__(self, unit: str) -> bytes:
        got = self.before.get(unit)
        if got is None:
            got = self.pieces.ids(unit)
        if len(self) >= REMEMBERED:
            self.before = dict(self)
            self.clear()
        self[unit] = got
        return got


class Pieces:
    """Encoder and decoder for one model (vocabulary, scores and piece types are read from it).

    ``reachable``, one byte a piece, spares the search for the reachable pieces; another instance has it.
    """

    def __init__(self, model: bytes, reachable: bytes | None = None):
        import ahocorasick
        import sentencepiece
        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = lib.get_piece_size()
        self.begin, self.end, self.unknown = lib.bos_id(), lib.eos_id(), lib.unk_id()
        names = [lib.id_to_piece(i) for i in range(n)]
        self.byte_id = {int(names[i][3:-1], 16): i for i in range(n) if lib.is_byte(i)}
        special = {i for i in range(n) if lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i)}
        self.id = {names[i]: i for i in range(n) if i not in special}
        self.score = {p: lib.get_score(i) for p, i in self.id.items()}
        self.bytes_of = [b"" if lib.is_control(i) else " ⁇ ".encode() if i == self.unknown
                         else bytes([int(names[i][3:-1], 16)]) if lib.is_byte(i)
                         else names[i].replace(SPACE, " ").encode() for i in range(n)]
        self.id_bytes = {p: struct.pack("<I", i) for p, i in self.id.items()}
        self.fit: dict[str, dict[str, str]] = {}  # by the piece before; two generations, as of units
        self.fit_before: dict[str, dict[str, str]] = {}
        self.n_fit = 0
        self.known = _Known(self)
        # reachable pieces: those that re-merging their own text gives back
        # (pieces are searched from the right, so one pass tells the longest that starts at each place)
        self.finder = ahocorasick.Automaton()
        if reachable is None:
            reachable = bytes(p in self.id and (len(p) == 1 or self.merge(p) == [p]) for p in names)
        self.reachable = reachable
        reachable = {p for p, i in self.id.items() if reachable[i]}
        for p in reachable:
            self.finder.add_word(p[::-1], len(p))
        self.finder.make_automaton()
        # the next shorter piece that starts alike; single characters always count
        self.shorter: dict[str, str] = {}
        for p in reachable:
            cut = len(p) - 1
            while cut > 1 and p[:cut] not in reachable:
                cut -= 1
            if cut:
                self.shorter[p] = p[:cut]
        within = {p[i:i + 2] for p in self.id for i in range(len(p) - 1)}
        if any(a != SPACE and b == SPACE for a, b in within):
            raise ValueError("pieces with inner space marks are not supported")
        runs = [s for p, s in self.score.items() if set(p) == {SPACE} and len(p) > 1]
        if runs and max(runs) > min(s for p, s in self.score.items() if len(p) > 1 and set(p) != {SPACE}):
            raise ValueError("runs of space marks must have the least scores")
        self.units = _unit_pattern(within)

    def merge(self, text: str) -> list[str]:
        """Plain merging: the best-scored pair first, the leftmost of equals."""
        n = len(text)
        if n <= 64:  # few pairs: their scores in a list, without a heap
            get, none = self.score.get, float("-inf")
            few = list(text)
            pairs = [get(a + b, none) for a, b in zip(few, few[1:])]
            while pairs and (most := max(pairs)) != none:
                i = pairs.index(most)
                few[i] += few.pop(i + 1)
                del pairs[i]
                if i:
                    pairs[i - 1] = get(few[i - 1] + few[i], none)
                if i < len(pairs):
                    pairs[i] = get(few[i] + few[i + 1], none)
            return few
        part: list[str | None] = list(text)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        score, heap = self.score, []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (s := score.get(p := part[i] + part[j])) is not None:
                heapq.heappush(heap, (-s, i, j, p))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, p = heapq.heappop(heap)
            if part[i] is None or part[j] is None or right[i] != j or part[i] + part[j] != p:
                continue
            part[i], part[j] = p, None
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in part if p is not None]

    def fitting(self, last: str, piece: str) -> str:
        """The longest of ``piece`` and the shorter pieces that start alike which re-merging keeps apart from ``last``; "" if none."""
        got = self.fit_before.get(last, {}).get(piece)
        if got is None:
            if self.merge(last + piece) == [last, piece]:
                got = piece
            else:
                shorter = self.shorter.get(piece)
                got = self.fit.get(last, {}).get(shorter) if shorter else ""
                if got is None:
                    got = self.fitting(last, shorter)
        if self.n_fit >= REMEMBERED:
            self.fit_before, self.fit, self.n_fit = self.fit, {}, 0
        self.fit.setdefault(last, {})[piece] = got
        self.n_fit += 1
        return got

    def backtrack(self, unit: str) -> list[str]:
        """The encoding of one unit, see the module text; characters without a piece stand alone."""
        n = len(unit)
        if n == 0:
            return []
        # (place, size) of all pieces, longest first at each place: reversed, so that the longest stays
        longest = dict(list(self.finder.iter(unit[::-1]))[::-1])
        failed = bytearray((n >> 3) + 1)  # the bitfield: one bit for each place
        some_failed = False
        fit, size, shorter = self.fit, longest.get, self.shorter
        done: list[str] = []
        at, last = 0, ""
        piece = unit[:size(n - 1, 1)]
        while True:
            near = fit.get(last) if last else None
            while piece:
                if last:
                    fits = near.get(piece) if near else None
                    piece = self.fitting(last, piece) if fits is None else fits
                    if not piece:
                        break
                to = at + len(piece)
                if not some_failed or not failed[to >> 3] >> (to & 7) & 1:
                    break
                piece = shorter.get(piece)
            if piece:
                done.append(piece)
                if to == n:
                    return done
                last, at = piece, to
                piece = unit[at:at + size(n - 1 - at, 1)]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                some_failed = True
                last = done.pop()
                at -= len(last)
                piece = shorter.get(last)
                last = done[-1] if done else ""
            fit = self.fit

    def _spaces(self, unit: str) -> list[str]:
        """A unit that begins with two or more space marks."""
        word = unit.lstrip(SPACE)
        n = len(unit) - len(word)
        rest = self.backtrack(SPACE + word) if word else []
        if rest and rest[0] != SPACE:
            n -= 1
        else:
            rest = rest[1:]
        return self.merge(SPACE * n) + rest

    def ids(self, unit: str) -> bytes:
        """Ids of a unit as little-endian unsigned 32-bit integers."""
        parts = self._spaces(unit) if unit.startswith(SPACE * 2) else self.backtrack(unit)
        known = self.id_bytes
        try:
            return b"".join([known[p] for p in parts])
        except KeyError:  # characters without a piece
            rest = {p: [self.byte_id[b] for b in p.encode()] if self.byte_id else [self.unknown] for p in parts if p not in known}
            return b"".join([known.get(p) or struct.pack(f"<{len(rest[p])}I", *rest[p]) for p in parts])

    def encode(self, text: str | None) -> bytes:
        """Begin id, ids of the text, end id."""
        body = b""
        if text:
            body = b"".join(map(self.known.__getitem__, self.units.findall(SPACE + text.replace(" ", SPACE))))
        return struct.pack("<I", self.begin) + body + struct.pack("<I", self.end)

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _unit_pattern(within: set[str]) -> re.Pattern:
    """Units: optional space marks, then other characters, then word characters.

    A text is cut where a word character meets a non-word one, unless some
    piece joins the two: word characters that end such a pair do not cut.
    """
    def is_word(c: str) -> bool:
        return bool(re.match(r"\w", c))
    ends = "".join(sorted({a for a, b in within if is_word(a) and not is_word(b) and b != SPACE}))
    other = rf"[^\w{SPACE}]"
    if not ends:
        return re.compile(rf"{SPACE}*{other}*\w*")
    return re.compile(rf"{SPACE}*{other}*\w*(?:(?<=[{re.escape(ends)}]){other}+\w*)*")


@lru_cache(maxsize=2)
def _pieces(model: bytes, reachable: bytes | None = None) -> Pieces:
    return Pieces(model, reachable)


def encode(df: DataFrame, model: str, text: str = "text", keep: dict[str, str] | None = None,
           with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """Encode and decode every text; one row per row of ``df``.

    ``model`` is the place of a model file (about 0.5 MB, read once on the
    driver and broadcast). Columns: the ``keep`` columns, ``n_tokens``,
    ``ids_sha256`` (of the ids as little-endian unsigned 32-bit integers),
    ``decoded_sha256``, and, unless left out, ``ids`` (those bytes) and
    ``decoded``.
    """
    keep = keep if keep is not None else {"doc_id": "doc_id"}
    with open(model, "rb") as f:
        proto = f.read()
    shared = df.sparkSession.sparkContext.broadcast((proto, Pieces(proto).reachable))
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + \
             ", ids binary" * with_ids + ", decoded string" * with_text

    @F.pandas_udf(schema)
    @returning
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces = _pieces(*shared.value)
        for texts in batches:
            rows = []
            for t in texts:
                ids = pieces.encode(t)
                back = pieces.decode(memoryview(ids).cast("I").tolist())
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                             hashlib.sha256(back.encode()).hexdigest(),
                             *([ids] if with_ids else []), *([back] if with_text else [])))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
        _pieces.cache_clear()  # workers are used again by other stages

    d = pick(df, **{f"k_{c}": src for c, src in keep.items()}, text=text).withColumn("r", coded("text"))
    return d.select(*[F.col(f"k_{c}").alias(c) for c in keep], "r.*")
