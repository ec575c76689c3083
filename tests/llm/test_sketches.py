"""Sketches of the Jaccard join: no link is lost, sets that share a part by chance go apart."""

import random

import numpy as np
import pyarrow as pa
import pytest

from vaneworks.llm import part_enum
from vaneworks.llm.tokens import chunks


def packed(sets):
    return np.concatenate([np.array(sorted(s), dtype=np.uint64) for s in sets]), np.cumsum([0] + [len(s) for s in sets])


def random_sets(seed):
    """Sets of 1 to 3,000 elements, each with copies that lose or change elements up to both sides of the threshold."""
    rng = random.Random(seed)
    out = []
    for _ in range(60):
        base = [rng.getrandbits(64) for _ in range(rng.choice([1, 2, 5, 9, 30, 100, 103, 110, 400, 1640, 3000]))]
        for share in (0, 0.03, 0.1, 0.12, 0.15, 0.2, 0.25):
            kept = base[: len(base) - int(share * len(base))]
            out.append(set(kept if rng.random() < 0.5 else kept + [rng.getrandbits(64) for _ in range(len(base) - len(kept))]))
    return out


def near(x, y, threshold):
    common = len(x & y)
    return 100 * common >= threshold * (len(x) + len(y) - common)


@pytest.mark.parametrize("threshold", [40, 80, 85])
def test_sketches_allow_every_link_and_few_other_pairs(threshold):
    sets = random_sets(threshold)
    values, first = packed(sets)
    words, at = part_enum.sketches(values, first)
    a, b = np.triu_indices(len(sets), 1)
    got = part_enum.sketches_allow(a, b, np.diff(first), words, at, threshold)
    want = np.array([near(sets[i], sets[j], threshold) for i, j in zip(a.tolist(), b.tolist(), strict=True)])
    assert want.sum() > 200 and got[want].all()
    if threshold >= 80:
        assert got.sum() < 1.5 * want.sum()


def joined(n, pairs):
    root = list(range(n))
    for i, j in pairs:
        x, y = root[i], root[j]
        root = [min(x, y) if r in (x, y) else r for r in root]
    return root


@pytest.mark.parametrize("pairwise", [2, 32, 1000])
def test_pairs_of_a_signature_join_the_same_sets_whatever_its_size(monkeypatch, pairwise):
    monkeypatch.setattr(part_enum, "PAIRWISE", pairwise)
    sets = [s for s in random_sets(3) if len(s) > 5]
    values, first = packed(sets)
    words, at = part_enum.sketches(values, first)
    sig = np.arange(len(sets)) // 100 % 3
    again = np.arange(0, len(sets), 4)  # rows that repeat
    rows = np.concatenate([np.arange(len(sets)), again])
    spans = [words[at[i] : at[i + 1]] for i in rows.tolist()]
    got = part_enum._held(sig[rows], rows, np.diff(first)[rows], np.concatenate(spans), np.cumsum([0] + [len(x) for x in spans]), 85)
    a, b = np.triu_indices(len(sets), 1)
    want = part_enum.sketches_allow(a, b, np.diff(first), words, at, 85) & (sig[a] == sig[b])
    assert joined(len(sets), got.tolist()) == joined(len(sets), zip(a[want].tolist(), b[want].tolist(), strict=True))


def test_sets_that_share_parts_by_chance_are_no_candidates(spark, monkeypatch):
    """Unrelated texts around passages that many have: their signatures join them, and their texts were sent to each other."""
    rng = random.Random(5)
    common = [" ".join(f"c{rng.randrange(40)}" for _ in range(12)) for _ in range(20)]
    rows = []
    for i in range(500):
        own = [" ".join(f"w{rng.randrange(5000)}" for _ in range(15)) for _ in range(6)]
        text = own + rng.sample(common, 5)
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, text + " end") for i, text in rows[:30]]
    seen = {}
    for chunk in chunks(pa.array([text for _, text in rows])):
        doc, sig = part_enum.signatures(*part_enum.doc_sets(chunk, 4), 85)
        for d, s in zip(doc.tolist(), sig.tolist(), strict=True):
            seen.setdefault(s, set()).add(d + chunk.rows.start)
    assert sum(len(x) > 2 for x in seen.values()) > 50
    given, run = [], part_enum.components
    monkeypatch.setattr(part_enum, "components", lambda edges: given.append(edges.count()) or run(edges))
    got = {r.doc_id: r.component_id for r in part_enum.similarity_components(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {i: i - 1000 if i >= 1000 else i for i, _ in rows}
    assert 30 <= given[0] <= 60 and given[1] == 30
