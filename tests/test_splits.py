import pytest
from pyspark.sql import functions as F

from conftest import observation_rows, observations, same_rows
from test_scale import OPTIONS
from vaneworks.operators import splits, windows


@pytest.fixture(scope="module")
def table(spark):
    rows = observation_rows({1: 70, 2: 33})
    return observations(spark, rows).cache(), rows


@pytest.mark.parametrize("train, val", [(0.8, 0.1), (0.5, 0.5), (1.0, 0.0), (0.0, 0.0), (0.333, 0.333)])
def test_random_split_sizes_are_exact_and_parts_are_disjoint(table, train, val):
    df, rows = table
    got = splits.random_split(df, train=train, val=val)
    sizes = {r["split"]: r["count"] for r in got.groupBy("split").count().collect()}
    n, a, b = len(rows), int(len(rows) * train), int(len(rows) * val)
    assert sizes == {k: v for k, v in {"train": a, "val": b, "test": n - a - b}.items() if v}
    same_rows(got.drop("split"), df)


def test_random_split_follows_the_seed(table):
    df, _ = table
    pick = lambda seed: {r["event_id"] for r in splits.random_split(df, seed=seed).where("split = 'val'").collect()}
    assert pick(1) == pick(1) != pick(2)


def test_rows_with_equal_ids_stay_on_one_side(table):
    df, _ = table
    got = splits.random_split(df, ids=["series_id"])
    assert got.count() == df.count()
    assert got.groupBy("series_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0


def test_head_split_cuts_in_time(table):
    df, rows = table
    got = splits.head_split(df)
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    want = {r[2] for r in order[: int(len(rows) * 0.8)]}
    assert {r["event_id"] for r in got.where("split = 'train'").collect()} == want
    assert splits.head_split(df, train=1.0).where("split = 'val'").count() == 0
    assert splits.head_split(df.where("event_id < 0")).count() == 0


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_head_split_in_another_time_zone(spark, table, zone):
    df, rows = table
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert splits.head_split(df).where("split = 'train'").count() == int(len(rows) * 0.8)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_gap_separates_the_rows_of_the_parts(spark):
    df = observations(spark, observation_rows({1: 60}))
    found = windows.labelled_windows(df, None, 6, pool=())
    got = splits.head_split(found, order=("window_start", "event_id"), end="label_timestamp")
    parts = {r["split"]: r for r in got.groupBy("split").agg(
        F.max("label_timestamp").alias("end"), F.min("window_start").alias("start"), F.count("*").alias("n")).collect()}
    assert parts["train"]["end"] < parts["val"]["start"]
    assert parts["gap"]["n"] == 6  # as many as the window is long
    assert parts["train"]["n"] + parts["gap"]["n"] == int(54 * 0.8)


@pytest.mark.parametrize("options", OPTIONS)
def test_series_head_split(table, options):
    df, rows = table
    got = splits.series_head_split(df, gap=3, **options)
    sizes = {(r["series_id"], r["split"]): r["count"] for r in got.groupBy("series_id", "split").count().collect()}
    assert sizes == {(1, "train"): 53, (1, "gap"): 3, (1, "val"): 14, (2, "train"): 23, (2, "gap"): 3, (2, "val"): 7}


def test_batches(table):
    df, rows = table
    for got in (splits.shuffled_batches(df, batch_size=32), splits.ordered_batches(df, batch_size=32)):
        sizes = {r["batch_id"]: r["count"] for r in got.groupBy("batch_id").count().collect()}
        assert sizes == {0: 32, 1: 32, 2: 32, 3: len(rows) - 96}
    first = splits.ordered_batches(df).where("batch_id = 0").select("event_id").collect()
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    assert {r[0] for r in first} == {r[2] for r in order[:32]}


def test_samples_by_position(table):
    df, rows = table
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    got = {r["sample_idx"]: r["event_id"] for r in splits.samples_at(df, [0, 5, 102, 103]).collect()}
    assert got == {i: order[i][2] for i in (0, 5, 102)}


def test_random_split_does_not_shuffle_rows(table):
    df, _ = table
    plan = splits.random_split(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
