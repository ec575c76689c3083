"""Toxicity scores from a lexicon that also catches misspelled terms, and from the words around each hit.

The lexicon is a trie of terms, whole words or stems (``lex*`` stands for all words that begin so). A word is looked up by
running its Levenshtein automaton down the trie: bit sets of the places in the word that 0 ... k edits reach, a branch left
when they are empty. Words that hold no piece of a term near its place are passed over first, which loses none. A hit counts by its term's weight, and by its context window: quotation marks around it or a word of
reporting before it speak for quotation, a word of address near it for abuse. A logistic model turns a document's sums
into a score.

``fit`` learns terms and model from labelled rows alone: of at most ``FIT_ROWS`` of them, chosen by a hash of their id, equal
texts once. Terms are words and stems of which most texts are toxic; those that add to no text that
lacks ``COVER`` terms are left out. Scores read the text only.

Rows: null and empty texts have no hits and get the score of a text without hits. Labels may be null or missing: such rows
are not learned from. Without toxic examples the lexicon is the given one. Repeated rows are scored each. Further columns are
not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaneworks.llm.common import text_batches, text_key, whole

#: Labelled rows that are learned from, at most (a bounded sample: 0.1 GB of text or so).
FIT_ROWS = 20_000
MAX_TERMS = 500
STEMS = (4, 5, 6, 7, 8)
COVER = 3
MIN_PRECISION = 0.5
WINDOW = 5
QUOTED, ADDRESSED, MISSPELLED = 0.4, 1.3, 0.5
#: Fixed word lists.
REPORTING = frozenset("said says called calls quote quoted quotes word words term terms wrote dit appelé mot sagte nannte wort dijo llamó palabra".split())
ADDRESS = frozenset("you your you're yourself u ur du dich dein deine ihr tu toi vous ton ta usted tú eres".split())
SEED_TERMS = {w: 2.0 for w in "idiot moron stupid scum".split()}
_WORD = re.compile(r"[^\W\d_]+")
_QUOTES = "\"“”«»„‟"
_FEATURES = 6


def allowed_edits(size: int) -> int:
    return 0 if size < 5 else 1 if size < 8 else 2


class Lexicon:
    """Terms and their weights, as a trie."""

    def __init__(self, terms: dict[str, float]):
        self.root: dict = {}
        self.known: dict[str, float] = {}
        #: Places at which a piece of a term begins, by piece: of a term that allows k edits k + 1 pieces, of which one stays whole.
        self.pieces: dict[str, set[int]] = {}
        for term, weight in terms.items():
            bare = term.rstrip("*")
            node = self.root
            for c in bare:
                node = node.setdefault(c, {})
            node["*" if term.endswith("*") else "."] = (weight, len(bare))
            if k := allowed_edits(len(bare)):
                cuts = [len(bare) * i // (k + 1) for i in range(k + 2)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    self.pieces.setdefault(bare[a:b], set()).add(a)
        self.sizes = sorted({len(p) for p in self.pieces})

    def weight(self, word: str) -> float:
        """The weight of the best term that the word is or misspells; 0 for none."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 400_000:
                self.known.clear()
            found = self.known[word] = self._look_up(word)
        return found

    def _look_up(self, word: str) -> float:
        node = self.root
        best = 0.0
        for n, c in enumerate(word):
            node = node.get(c)
            if node is None:
                break
            if "*" in node and n + 1 < len(word):
                best = max(best, node["*"][0])
            if "." in node and n + 1 == len(word):
                best = max(best, node["."][0])
        if best:
            return best
        k = allowed_edits(len(word))
        return MISSPELLED * self._near(word, k) if k and self._shares_piece(word, k) else 0.0

    def _shares_piece(self, word: str, k: int) -> bool:
        """Does the word hold a piece of a term, at most k places from its own? No word within k edits of a term lacks one."""
        for size in self.sizes:
            for i in range(len(word) - size + 1):
                places = self.pieces.get(word[i : i + size])
                if places and any(abs(i - p) <= k for p in places):
                    return True
        return False

    def _near(self, word: str, k: int) -> float:
        """The best term within k edits of the word or, for a stem, of a beginning of it: the word's automaton, run along the trie."""
        places: dict[str, int] = {}
        for i, c in enumerate(word):
            places[c] = places.get(c, 0) | 1 << i
        full, end = (1 << len(word) + 1) - 1, 1 << len(word)
        start = [0] * (k + 1)
        start[0] = 1
        for e in range(1, k + 1):
            start[e] = start[e - 1] | start[e - 1] << 1
        best, todo = 0.0, [(self.root, start)]
        while todo:
            node, reach = todo.pop()
            for mark, wanted in ((".", end), ("*", end - 1)):  # a whole word ends at its end, a stem before it
                hit = node.get(mark)
                if hit:
                    for e in range(1, min(k, allowed_edits(hit[1])) + 1):
                        if reach[e] & wanted:
                            best = max(best, hit[0] / e)
                            break
            for c, below in node.items():
                if c in ".*":
                    continue
                at = places.get(c, 0)
                moved = [(reach[0] & at) << 1]
                for e in range(1, k + 1):
                    moved.append(((reach[e] & at) << 1 | reach[e - 1] << 1 | reach[e - 1] | moved[e - 1] << 1) & full)
                if any(moved):
                    todo.append((below, moved))
        return best


def features(text: str, lexicon: Lexicon) -> tuple[float, ...]:
    """Sums over the hits of a text: plain, addressed and quoted weight, the largest, their number, hits per word."""
    low = text.lower()
    tokens = _WORD.findall(low)
    weight = lexicon.weight
    hits = {w: s for w in set(tokens) if (s := weight(w))}
    if not hits:
        return (0.0,) * _FEATURES
    plain = addressed = quoted = largest = 0.0
    number = 0
    spots = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(low)]
    for i, (a, b, w) in enumerate(spots):
        s = hits.get(w)
        if not s:
            continue
        near = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
        lead = tokens[max(0, i - WINDOW) : i]
        number += 1
        inside = any(q in low[spots[max(0, i - WINDOW)][0] : a] for q in _QUOTES) and any(q in low[b : spots[min(len(spots) - 1, i + WINDOW)][1] + 1] for q in _QUOTES)
        if inside or not REPORTING.isdisjoint(lead):
            s *= QUOTED
            quoted += s
        elif not ADDRESS.isdisjoint(near):
            s *= ADDRESSED
            addressed += s
        else:
            plain += s
        largest = max(largest, s)
    return (math.log1p(plain), math.log1p(addressed), math.log1p(quoted), largest, math.log1p(number), 100 * number / (len(tokens) + 20))


@dataclass(frozen=True)
class Model:
    terms: dict[str, float]
    weights: tuple[float, ...]


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights (the last one constant) by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([penalty * len(x)] * (x.shape[1] - 1) + [1e-6 * len(x)]) * 0.01
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _marks(train: DataFrame) -> DataFrame:
    """_key, toxic and the distinct words and stems (``stem*``) of each training text."""
    tokens = F.array_distinct(F.filter(F.split(F.lower("_text"), r"[^\p{L}]+"), lambda w: F.length(w) >= STEMS[0]))

    def stems(n: int):
        return F.transform(F.filter(F.col("_w"), lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))

    marks = F.array_distinct(F.concat("_w", *[stems(n) for n in STEMS])).alias("_marks")
    return train.select("_key", "_toxic", tokens.alias("_w")).select("_key", "_toxic", marks)


def learn_terms(train: DataFrame) -> dict[str, float]:
    """Terms that mark toxic texts, weighted by how far the logarithm of their odds lies above the usual."""
    marks = _marks(train)
    n_toxic, n_all = train.agg(F.coalesce(F.sum("_toxic"), F.lit(0)), F.count(F.lit(1))).first()
    usual = math.log((n_toxic + 0.5) / (n_all - n_toxic + 0.5))
    counts = marks.select("_toxic", F.explode("_marks").alias("m")).groupBy("m").agg(F.sum("_toxic").alias("pos"), F.count(F.lit(1)).alias("n"))
    good = counts.where((F.col("pos") >= max(5, n_toxic // 100)) & (F.col("pos") >= MIN_PRECISION * F.col("n")))
    rows = good.orderBy(F.desc("pos"), "m").limit(8 * MAX_TERMS).collect()
    if not rows:
        return dict(SEED_TERMS)
    count = {r.m: (r.pos, r.n) for r in rows}
    # a stem with the texts of one of its words, or with those of a shorter stem, says nothing more
    names = set(count)
    for m in sorted(count):
        bare = m.rstrip("*")
        shorter = [f"{bare[:k]}*" for k in STEMS if k < len(bare)]
        if any(s in names and count[s][0] > 1.15 * count[m][0] for s in shorter):
            names.discard(m)
    for m in sorted(names):
        if m.endswith("*") and any(not o.endswith("*") and o.startswith(m[:-1]) and count[o][0] >= 0.85 * count[m][0] for o in names if o in count):
            names.discard(m)
    listed = F.array(*[F.lit(m) for m in sorted(names)])
    held = [set(r[0]) for r in marks.where("_toxic = 1").select(F.array_intersect("_marks", listed)).collect()]
    lacking = [COVER] * len(held)
    where: dict[str, list[int]] = {m: [] for m in names}
    for i, h in enumerate(held):
        for m in h:
            where[m].append(i)
    terms: dict[str, float] = {}
    for m in sorted(names, key=lambda m: (-count[m][0], m)):
        adds = [i for i in where[m] if lacking[i] > 0]
        if len(adds) >= max(5, 0.2 * len(where[m])) and len(terms) < MAX_TERMS:
            for i in adds:
                lacking[i] -= 1
            pos, n = count[m]
            terms[m] = math.log((pos + 0.5) / (n - pos + 0.5)) - usual
    return terms


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """Terms and model from ``labels`` (doc_id, 0/1); at most ``fit_rows`` of its rows are read, in the order of a hash."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_lid"), F.col(label).cast("int").alias("_toxic"))
    chosen = known.orderBy(F.xxhash64("_lid"), "_lid", "_toxic").limit(fit_rows)
    rows = docs.select(F.col(doc_id).alias("_id"), whole(F.col(text)).alias("_text"), text_key(F.col(text)).alias("_key"))
    train = rows.join(F.broadcast(chosen), F.col("_id") == F.col("_lid"))  # a bounded number of rows
    train = train.groupBy("_key").agg(F.max("_text").alias("_text"), F.max("_toxic").alias("_toxic"))
    terms = learn_terms(train)
    sums = text_features(train.select("_toxic", "_text"), terms).collect()
    if not sums:
        return Model(terms, (0.0,) * (_FEATURES + 1))
    x, y = np.array([r[1] for r in sums], dtype=float), np.array([r[0] for r in sums], dtype=float)
    if y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Model(terms, (0.0,) * _FEATURES + (math.log(share / (1 - share)),))
    return Model(terms, tuple(_logistic(x, y).tolist()))


def text_features(rows: DataFrame, terms: dict[str, float]) -> DataFrame:
    """The first column of ``rows`` and the features of the second."""
    first = rows.schema[0]
    text_batches(rows.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms)
        for batch in batches:
            for a in range(0, len(batch), 512):
                found = [features(t or "", lexicon) for t in batch.column(1).slice(a, 512).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 512), pa.array(found, pa.list_(pa.float64()))], [first.name, "features"])

    return rows.mapInArrow(work, f"`{first.name}` {first.dataType.simpleString()}, features array<double>")


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per row: doc_id, score, predicted (1 from ``threshold`` on), n_hits."""
    found = text_features(docs.select(doc_id, whole(F.col(text)).alias("_text")), model.terms)
    total = F.lit(model.weights[-1])
    for i, w in enumerate(model.weights[:-1]):
        total = total + F.lit(w) * F.get("features", F.lit(i))
    out = found.select(doc_id, (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))).alias("score"), F.round(F.expm1(F.get("features", F.lit(4)))).cast("int").alias("n_hits"))
    return out.select(doc_id, "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_hits")
