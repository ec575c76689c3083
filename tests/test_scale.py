import random

import pytest
from pyspark.sql import functions as F

from conftest import SF, observation_rows, observations, same_rows
from vaneworks.operators import scale
from vaneworks.plans import fixtures


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 0, 0, rng.randint(-50, 50)]), rng.randint(0, 3)) for i in range(997)]
    return spark.createDataFrame(rows, "id bigint, k bigint, s bigint").repartition(5), rows


def test_row_index_is_the_global_position(numbers):
    df, rows = numbers
    want = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    got = {r["id"]: r["row_idx"] for r in scale.row_index(df, ["k", "id"]).collect()}
    assert got == want


def test_row_index_of_an_empty_table(numbers):
    df, _ = numbers
    assert scale.row_index(df.where("id < 0"), ["k", "id"]).collect() == []


@pytest.mark.parametrize("bucket_rows", [1, 50, 200_000])
def test_hash_rank_is_a_seeded_permutation(numbers, bucket_rows):
    import hashlib

    df, rows = numbers
    order = sorted((hashlib.md5(f"9:{r[0]}".encode()).hexdigest(), r[0]) for r in rows)
    want = {i: n + 1 for n, (_, i) in enumerate(order)}
    got = {r["id"]: r["rank"] for r in scale.hash_rank(df, ["id"], 9, bucket_rows=bucket_rows).collect()}
    assert got == want


@pytest.mark.parametrize("fetch", [1, 20, 50_000])
def test_hash_cuts_narrow_to_the_exact_row(numbers, monkeypatch, fetch):
    import hashlib

    monkeypatch.setattr(scale, "FETCH_ROWS", fetch)
    df, rows = numbers
    order = sorted(hashlib.md5(f"9:{r[0]}".encode()).hexdigest() for r in rows)
    got = scale.hash_cuts(df, ["id"], 9, lambda n: [0, 1, n // 2, n])
    assert got == [None, order[0], order[len(rows) // 2 - 1], order[-1]]


@pytest.mark.parametrize("fetch", [1, 50_000])
def test_key_at_rank_with_a_hot_value(numbers, monkeypatch, fetch):
    monkeypatch.setattr(scale, "FETCH_ROWS", fetch)
    monkeypatch.setattr(scale, "_BINS_PER_STEP", 7)
    df, rows = numbers
    order = sorted((r[1], r[0]) for r in rows)
    for rank in (0, 1, 400, 800, 996):
        assert scale.key_at_rank(df, [F.col("k"), F.col("id")], lambda n, rank=rank: rank) == order[rank]
    assert scale.key_at_rank(df, [F.col("k"), F.col("id")], lambda n: n) is None
    assert scale.key_at_rank(df.where("id < 0"), [F.col("k")], lambda n: 0) is None


OPTIONS = [
    {"strategy": "partition"},
    {"strategy": "chunk", "chunk_rows": 10},
    {"strategy": "auto", "max_series_rows": 60, "chunk_rows": 16},  # some series cut, others not
    {"strategy": "auto", "max_series_rows": 1, "chunk_rows": 8},  # every series cut
    {"strategy": "auto"},
]


@pytest.mark.parametrize("options", OPTIONS)
def test_running_totals_do_not_depend_on_the_layout(spark, options):
    rows = observation_rows({1: 150, 2: 40, 3: 1, 4: 7})
    df = observations(spark, rows)
    got = scale.running(
        df,
        ["series_id"],
        ["timestamp", "event_id"],
        {"total": ("sum", F.col("temperature")), "low": ("min", F.col("humidity")), "high": ("max", F.col("humidity"))},
        **options,
    )
    assert set(got.columns) == {*df.columns, "total", "low", "high"}
    found = {r["event_id"]: (r["total"], r["low"], r["high"]) for r in got.collect()}
    want, state = {}, {}
    for r in rows:
        total, low, high = state.get(r[0], (0.0, 99.0, -1.0))
        state[r[0]] = (total + r[3], min(low, r[4]), max(high, r[4]))
        want[r[2]] = state[r[0]]
    assert found == want


def test_too_many_oversized_series_cut_everything(spark, monkeypatch):
    monkeypatch.setattr(scale, "MAX_LISTED_SERIES", 1)
    df = observations(spark, observation_rows({1: 30, 2: 30, 3: 5}))
    laid = scale.lay_out(df, ["series_id"], ["timestamp", "event_id"], after=3, max_series_rows=10, chunk_rows=8)
    assert laid.chunked
    own = laid.own_rows(laid.df)
    same_rows(own, df)


def test_chunks_must_hold_a_frame(spark):
    df = observations(spark, observation_rows({1: 30}))
    with pytest.raises(ValueError):
        scale.lay_out(df, ["series_id"], ["timestamp"], strategy="other")


def test_values_per_key_meet_null_keys(spark):
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "k int, v string")
    per_key = spark.createDataFrame([(1, 10), (None, 20)], "k int, w int")
    assert sorted(map(tuple, scale.join_small(rows, per_key, ["k"], "left").collect()), key=repr) == [(1, "a", 10), (2, "c", None), (None, "b", 20)]
    assert [r.v for r in scale.join_small(rows, per_key, ["k"], "left_anti").collect()] == ["c"]


@pytest.mark.parametrize("options", [
    {"strategy": "partition"}, {"strategy": "chunk", "chunk_rows": 2}, {"max_series_rows": 3, "chunk_rows": 2},
    {"max_series_rows": 100}, {"strategy": "chunk", "chunk_rows": 1000},
])
def test_every_layout_counts_a_null_series_through(spark, options):
    rows = spark.createDataFrame([(s, i) for s in (None, 1, 2) for i in range(6)], "s int, i int")
    got = scale.running(rows, ["s"], ["i"], {"n": ("sum", F.lit(1))}, **options).collect()
    assert sorted((repr(r.s), r.i, r.n) for r in got) == sorted((repr(s), i, i + 1) for s in (None, 1, 2) for i in range(6))


def test_a_frame_may_be_longer_than_a_chunk(spark):
    rows = spark.createDataFrame([(1, i) for i in range(40)], "s int, i int")
    laid = scale.lay_out(rows, ["s"], ["i"], after=9, strategy="chunk", chunk_rows=4)
    got = laid.own_rows(laid.df.withColumn("far", F.lead("i", 9).over(laid.window()))).collect()
    assert all(r.far == (r.i + 9 if r.i < 31 else None) for r in got) and len(got) == 40


def test_ranks_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(scale, "_TOP_BITS", 2)
    ranked = scale.hash_rank(spark.range(500).withColumnRenamed("id", "k"), ["k"], 3, bucket_rows=10).collect()
    by_hash = spark.range(500).withColumnRenamed("id", "k").withColumn("h", scale.seeded_hash(["k"], 3)).orderBy("h").collect()
    assert [r.k for r in sorted(ranked, key=lambda r: r.rank)] == [r.k for r in by_hash]


def test_cuts_among_repeated_ids(spark):
    rows = spark.range(100).selectExpr("id div 4 as k")
    cut = scale.hash_cuts(rows, ["k"], 1, lambda n: [n // 2])[0]
    below = rows.withColumn("h", scale.seeded_hash(["k"], 1)).where(F.col("h") <= cut).count()
    assert 50 <= below < 54


def test_scratch_tables_are_released(spark):
    import os

    scale.release_scratch(spark)
    kept = scale.materialise(spark.range(3), "kept")
    path = kept.inputFiles()[0].replace("file://", "")
    assert kept.count() == 3 and os.path.exists(path)
    assert scale.release_scratch(spark) == 1 and not os.path.exists(path)
    assert scale.release_scratch(spark) == 0
