"""Secret scans: all rules in one pass over the bytes, by one minimal deterministic automaton.

Every rule ends in a run of one class of bytes, so a match is a stretch over which the automaton accepts the rule: its first
byte there ends the shortest match, and the stretch ends where the class does. The scan walks many texts in step: texts are
cut behind bytes that lead the automaton back to its start (line ends and commas among them), the pieces sorted by length, and one
array operation moves all of them by a byte. The start of a match is found by the reversed head of its rule, read backwards.
Matches of a rule are leftmost and do not overlap; those that fail its test of length are dropped, but have used their text.

Rows: null texts are empty. Repeated rows are scanned each. Spans are code points, end exclusive. An empty table gives none.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaneworks.llm.automata import compile_backward, compile_rules
from vaneworks.llm.common import text_batches, whole
from vaneworks.llm.tokens import chunks


@dataclass(frozen=True)
class Rule:
    """``head`` and then one or more bytes of ``tail``. Of a match, ``counts`` ("match" or "tail") has ``least`` characters at least."""

    kind: str
    head: str
    tail: str
    least: int
    counts: str = "match"


#: Fixed patterns. The first three are the base; the others add well-known token formats. Rules may be any number, but those whose
#: tails share characters can be under way together, and each such set of rules is a state of the one automaton: a dozen may be too many.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]", 12, "tail"),
    Rule("access", "AKIA", "[A-Z0-9]", 18),
    Rule("hex", "", "[0-9a-f]", 16),
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", 40),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]", 20),
)
BASE = ("assign", "access", "hex")
LANES = 4096


class Scanner:
    """The automaton of some rules and what it takes to read its matches."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.automaton = compile_rules([f"(?:{r.head})(?:{r.tail})+" for r in rules])
        self.moves = np.ascontiguousarray(self.automaton.moves.reshape(-1) * 256, dtype=np.int32)  # states as row offsets
        sets = len(self.automaton.member)
        self.accepts = self.automaton.accepts.astype(np.uint8 if sets <= 256 else np.uint16 if sets <= 65_536 else np.int32)
        self.member = self.automaton.member
        self.cuts = np.zeros(256, dtype=bool)
        self.cuts[self.automaton.resets()] = True
        self.heads = [compile_backward(r.head) if r.head else None for r in rules]

    def accepted(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For each byte the number of the set of rules that accept after it."""
        out = np.zeros(len(data), dtype=self.accepts.dtype)
        # a piece ends behind a byte after which the state is the start again, or at the end of a text
        cut = self.cuts[data]
        starts = np.zeros(len(data) + 1, dtype=bool)
        starts[bounds] = True
        starts[1:-1] |= cut[:-1]
        begin = np.flatnonzero(starts[:-1])
        size = np.diff(np.append(begin, len(data)))
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        for a in range(0, len(begin), LANES):
            at, left = begin[a : a + LANES].copy(), size[a : a + LANES]
            if not len(left):
                continue
            state = np.zeros(len(at), dtype=np.int32)
            active = np.searchsorted(-left, -np.arange(int(left[0])), side="left")  # pieces longer than each step
            for n in active.tolist():
                state[:n] = self.moves[state[:n] + data[at[:n]]]
                out[at[:n]] = self.accepts[state[:n] >> 8]
                at[:n] += 1
        return out

    def spans(self, data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
        """(rule number, first byte, byte after the last) of all matches in a buffer of texts, in order of rule and place."""
        accepted = self.accepted(data, bounds)
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[bounds] = True
        found = []
        seen = self.member[np.unique(accepted)].any(axis=0)
        for k, rule in enumerate(self.rules):
            if not seen[k]:
                continue
            on = self.member[:, k][accepted]
            before = np.zeros(len(on), dtype=bool)
            before[1:] = on[:-1]
            before[edge[:-1]] = False
            follows = np.zeros(len(on), dtype=bool)
            follows[:-1] = on[1:]
            follows[edge[1:]] = False
            first, last = np.flatnonzero(on & ~before), np.flatnonzero(on & ~follows) + 1
            if not rule.head:
                long = last - first >= rule.least
                found += [(k, a, b) for a, b in zip(first[long].tolist(), last[long].tolist(), strict=True)]
                continue
            text_of = np.searchsorted(bounds, first, side="right") - 1
            used, of = 0, -1
            for a, b, t in zip(first.tolist(), last.tolist(), text_of.tolist(), strict=True):
                if t != of:
                    used, of = int(bounds[t]), t
                head = self._head(data, k, used, a)
                if head is None:  # it starts in text that a match before it has used: a later one in the same stretch?
                    a = self._fresh(data, k, used, b)
                    if a is None:
                        continue
                    head = self._head(data, k, used, a)
                used = b
                if (b - a if rule.counts == "tail" else b - head) >= rule.least:
                    found.append((k, head, b))
        return found

    def _fresh(self, data: np.ndarray, k: int, low: int, end: int) -> int | None:
        """The first byte before ``end`` after which rule k accepts, nothing before ``low`` being read."""
        state = 0
        for at in range(low, end):
            state = int(self.moves[state + int(data[at])])
            if self.member[self.accepts[state >> 8], k]:
                return at
        return None

    def _head(self, data: np.ndarray, k: int, low: int, end: int) -> int | None:
        """Where the longest head that ends before ``end`` starts, at ``low`` or later; None if there is none."""
        back = self.heads[k]
        state, found, dead = 0, None, back.dead
        for at in range(end - 1, low - 1, -1):
            state = int(back.moves[state, data[at]])
            if state == dead:
                break
            if back.accepts[state]:
                found = at
        return found


@functools.cache
def scanner_for(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: doc_id and ``found``, array of (kind, start, end) in order of start and rule."""
    kind = docs.schema[doc_id].dataType.simpleString()
    text_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_for(rules)
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                data, bounds = chunk.data, chunk.bounds
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
                found: list[list[tuple[int, int, int]]] = [[] for _ in chunk.rows]
                for k, a, b in scanner.spans(data, bounds):
                    t = int(np.searchsorted(bounds, a, side="right")) - 1
                    zero = int(points[bounds[t]])
                    found[t].append((int(points[a]) - zero, k, int(points[b]) - zero))
                rows = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in sorted(f)] for f in found]
                ids = batch.column(0).slice(chunk.rows.start, len(chunk.rows))
                spans = pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))
                yield pa.RecordBatch.from_arrays([ids, spans], ["doc_id", "found"])

    return docs.select(doc_id, whole(F.col(text))).mapInArrow(work, f"doc_id {kind}, found array<struct<kind:string,start:int,end:int>>")


def scan_digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    def shown(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in BASE]
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *counts, F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("found")).alias("spans"))
