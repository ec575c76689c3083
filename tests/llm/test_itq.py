"""Embedding near-dedup: codes, recall and results against all pairs."""

import numpy as np
import pytest

from vaneworks.llm import itq

SCHEMA = "vec_id long, embedding array<double>, label string"


def clusters(seed, dim=32, groups=20, copies=12, loners=200, noise=0.11):
    """Cosines inside a group lie around 0.98."""
    rng = np.random.default_rng(seed)
    out = [rng.normal(size=dim) for _ in range(loners)]
    for _ in range(groups):
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        out += [centre + noise / np.sqrt(dim) * rng.normal(size=dim) for _ in range(copies)]
    return [out[i] for i in rng.permutation(len(out))]


def brute(rows, threshold=0.98):
    """(id, n_links, component, kept) per row by all pairs."""
    def able(v):
        return v is not None and None not in v and all(np.isfinite(v)) and any(x != 0 for x in v)

    def near(a, b):
        if a[2] is None or a[2] != b[2] or not able(a[1]) or not able(b[1]) or len(a[1]) != len(b[1]):
            return False
        x, y = (np.array(r[1]) / np.abs(r[1]).max() for r in (a, b))
        return x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold

    links = [[j for j, b in enumerate(rows) if j != i and near(a, b)] for i, a in enumerate(rows)]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            todo = [k for j in todo for k in links[j] if k not in seen and not seen.add(k)]
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), component, rows[i][0] == component))
    return out


def found(df, **options):
    return [tuple(r) for r in itq.near_duplicates(df, **options).select("vec_id", "n_links", "component_id", "kept").collect()]


def ordered(rows):
    return sorted(rows, key=repr)


def test_recall_and_no_false_link(spark):
    rows = [(i, v.tolist(), str(i % 2)) for i, v in enumerate(clusters(1))]
    df = spark.createDataFrame(rows, SCHEMA)
    got, want = {r[0]: r for r in found(df)}, {r[0]: r for r in brute(rows)}
    total = sum(r[1] for r in want.values())
    assert total > 500
    assert all(got[k][1] <= want[k][1] for k in want)
    assert sum(r[1] for r in got.values()) >= 0.97 * total


def test_blocks_of_a_hot_bucket_give_the_same(spark):
    rows = [(i, v.tolist(), "a") for i, v in enumerate(clusters(2, groups=2, copies=70, loners=30, noise=0.05))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert ordered(found(df, block=7)) == ordered(brute(rows)) == ordered(found(df))


def test_awkward_rows(spark):
    big, tiny = [1e300, 1e300, 0.0], [1e-300, 1e-300, 0.0]
    rows = [
        (1, [1.0, 2.0, 3.0], "a"), (2, [1.0, 2.0, 3.0], "a"), (2, [1.0, 2.0, 3.0], "a"), (3, [2.0, 4.0, 6.0], "a"), (4, [1.0, 2.0, 3.0], "b"), (5, [1.0, 2.0, 3.0], None),
        (6, None, "a"), (7, [0.0, 0.0, 0.0], "a"), (8, [0.0, 0.0, 0.0], "a"), (9, [1.0, None, 3.0], "a"), (10, [1.0, float("nan"), 3.0], "a"), (11, [1.0, float("inf"), 3.0], "a"),
        (12, [1.0, 2.0], "a"), (13, [1.0, 2.0], "a"), (14, [], "a"), (15, [-0.0, 1.0, 0.0], "a"), (16, [0.0, 1.0, 0.0], "a"), (17, big, "c"), (18, tiny, "c"), (19, [-1e300, -1e300, 0.0], "c"),
        (None, [5.0, 0.0, 0.0], "d"), (None, [5.0, 0.0, 0.0], "d"), (20, [0.0, 5.0, 0.0], "d"), (None, [0.0, 5.0, 0.0], "d"),
    ]
    got = found(spark.createDataFrame(rows, SCHEMA))
    want = [(a, b, c, a is not None and a == c if c is not None else a is None) for a, b, c, _ in brute(rows)]
    assert ordered(got) == ordered(want)


def test_many_copies_are_one_class(spark):
    copies = spark.range(20_000).selectExpr("id as vec_id", "array(1.0D, 2.0D) as embedding", "'x' as label", "1 as n_links", "2 as kept", "3 as _cls")
    got = itq.near_duplicates(copies)
    assert got.groupBy("n_links", "component_id").count().collect() == [(19_999, 0, 20_000)]
    assert got.where("kept").count() == 1


def test_empty_table(spark):
    assert itq.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("dim,bits", [(1, 16), (3, 16), (64, 128), (200, 128)])
def test_planes_have_the_asked_bits(dim, bits):
    units = itq.unit(np.random.default_rng(0).normal(size=(300, dim)))
    centre, planes = itq.learn_planes(units, bits)
    assert centre.shape == (dim,) and planes.shape == (dim, bits)
    assert itq.code_words(units, (centre, planes), bits // 16, 16).max() < 1 << 16


def test_codes_are_balanced_and_near_the_corners():
    units = itq.unit(np.random.default_rng(0).normal(size=(2000, 32)) * np.linspace(1, 3, 32))
    centre, planes = itq.learn_planes(units, 32)
    share = ((units - centre) @ planes >= 0).mean(axis=0)
    assert share.min() > 0.4 and share.max() < 0.6

    def loss(p):
        x = (units - centre) @ p
        return ((np.sign(x) * np.abs(x).mean() - x) ** 2).sum()

    principal = np.linalg.eigh(np.cov(units.T))[1]
    assert loss(planes) < loss(principal)
