"""Decontamination against a brute force that knows no seeds."""

import itertools
import random

import pytest

from vaneworks.llm import decontaminate


@pytest.mark.parametrize("size,differ", [(11, 2), (12, 2), (13, 2), (14, 2), (15, 3)])
def test_every_accepted_window_has_a_seed(size, differ):
    assert 100 * (size - differ) >= 80 * size > 100 * (size - differ - 1)
    for bad in itertools.combinations(range(size), differ):
        at = lambda m, i: all(i + k not in bad for k, c in enumerate(m) if c == "1")
        assert any(at(m, i) for m in decontaminate.MASKS for i in range(size - len(m) + 1)), bad


def agree(doc, item):
    size = min(15, len(item))
    return len(item) >= 11 and any(
        10 * sum(a == b for a, b in zip(doc[d : d + size], item[i : i + size], strict=True)) >= 8 * size
        for i in range(len(item) - size + 1) for d in range(len(doc) - size + 1)
    )


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(5)
    items = [(n, [f"i{n}x{k}" for k in range(size)]) for n, size in enumerate((7, 10, 11, 11, 12, 13, 14, 15, 15, 20, 40))]
    docs = []
    for _ in range(30):
        for n, own in items:
            lost = set(rng.sample(range(len(own)), max(1, round(len(own) * rng.choice([0.1, 0.2, 0.25])))))
            passage = ["other" if k in lost else w for k, w in enumerate(own)]
            docs.append((len(docs), [*(f"d{len(docs)}x{k}" for k in range(rng.randint(0, 4))), *passage, "end"]))
    for lost in ((0, 3, 4), (0,), (10,)):
        for n in (2, 7):
            docs.append((len(docs), ["x"] + ["other" if k in lost else w for k, w in enumerate(items[n][1])]))
    want = {(d, str([n for n, own in items if agree(doc, own)])) for d, doc in docs}
    text = lambda rows: [(i, " ".join(ws)) for i, ws in rows]
    got = decontaminate.flagged(spark.createDataFrame(text(docs), "doc_id int, text string"), spark.createDataFrame(text(items), "item_id int, text string"))
    assert {(r.doc_id, str(list(r.item_ids))) for r in got.collect()} == want
    assert sum(w != "[]" for _, w in want) > 100


@pytest.mark.parametrize("limit", [10**6, 0])
def test_short_items_are_found_whole_and_apart(spark, limit):
    rng = random.Random(8)
    letters = "ab"
    items = [(n, "".join(rng.choice(letters) for _ in range(size))) for n, size in enumerate((1, 2, 3, 5, 7, 9, 10, 10, 11))]
    items += [(90, ""), (91, None), (92, "abba")]
    docs = [(n, "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))) for n in range(60)] + [(60, None), (61, "c" * 3000 + "abba"), (None, "abba")]
    short = [(n, item) for n, item in items if item and len(item) < 11]
    want = {(d, str([n for n, item in short if item in (text or "")])) for d, text in docs}
    spread = lambda rows: [(i, t if t is None else " ".join(t)) for i, t in rows]
    got = decontaminate.flagged(
        spark.createDataFrame(spread(docs), "doc_id int, text string"), spark.createDataFrame(spread(items), "item_id int, text string"),
        broadcast_seeds=limit,
    ).collect()
    assert {(r.doc_id, str(list(r.short_item_ids))) for r in got} == want and len(got) == len(docs)
    assert all(r.contaminated == bool(r.item_ids) and set(r.item_ids) <= {8} for r in got)
    assert any(r.short_item_ids and not r.contaminated for r in got)
