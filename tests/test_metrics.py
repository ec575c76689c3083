import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF
from vaneworks.operators import metrics
from vaneworks.plans import fixtures


def scored(spark, rows):
    return spark.createDataFrame([(float(p) if p is not None else None, y) for p, y in rows], "p double, y int")


def pair_auc(rows):
    pos = [p for p, y in rows if y == 1]
    neg = [p for p, y in rows if y == 0]
    if not pos or not neg:
        return 0.0
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def step_ap(rows):
    total = sum(y for _, y in rows)
    if not total:
        return 0.0
    area, last = 0.0, 0.0
    for t in sorted({p for p, _ in rows}, reverse=True):
        tp = sum(1 for p, y in rows if p >= t and y == 1)
        recall = tp / total
        area += (recall - last) * tp / sum(1 for p, _ in rows if p >= t)
        last = recall
    return area


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    rows=st.lists(st.tuples(st.sampled_from([0.0, 0.1, 0.1, 0.5, 0.77, 1.0]), st.integers(0, 1)), min_size=1, max_size=40),
    pieces=st.sampled_from([1, 2, 5]),
)
def test_rank_metrics_equal_brute_force(spark, rows, pieces):
    table = metrics.score_table(scored(spark, rows), pieces=pieces)
    got = metrics.rank_metrics(table).first()
    assert got["auc"] == pytest.approx(pair_auc(rows))
    assert got["average_precision"] == pytest.approx(step_ap(rows))


@pytest.mark.parametrize("pieces", [1, 3, 64])
def test_rank_metrics_of_many_scores(spark, pieces):
    rng = random.Random(1)
    rows = [(round(rng.random(), 3), int(rng.random() < 0.3)) for _ in range(900)]
    got = metrics.rank_metrics(metrics.score_table(scored(spark, rows).repartition(6), pieces=pieces)).first()
    assert got["auc"] == pytest.approx(pair_auc(rows)) and got["average_precision"] == pytest.approx(step_ap(rows))


def test_rank_metrics_by_group_with_a_hot_group(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, 3]), round(rng.random(), 2), rng.randint(0, 1)) for _ in range(600)]
    rows += [(4, 0.3, 1), (4, 0.4, 1)]
    df = spark.createDataFrame(rows, "g int, p double, y int")
    got = {r["g"]: r["auc"] for r in metrics.roc_auc(df, by=["g"], pieces=7).collect()}
    for g in (1, 2, 3, 4):
        assert got[g] == pytest.approx(pair_auc([(p, y) for k, p, y in rows if k == g]))


def test_one_class_and_empty_inputs(spark):
    assert metrics.roc_auc(scored(spark, [(0.2, 1), (0.3, 1)])).first()["auc"] == 0.0
    assert metrics.average_precision(scored(spark, [(0.2, 0)])).first()["average_precision"] == 0.0
    empty = scored(spark, [(0.5, 1)]).where("p > 1")
    assert metrics.roc_auc(empty).first()["auc"] == 0.0
    got = metrics.pointwise(empty).first()
    assert got["n"] == 0 and got["loss"] is None and got["precision"] == 0.0
    assert metrics.mean_over_batches(metrics.batch_metrics(empty.withColumn("batch_id", F.lit(1)))).first()["loss"] is None


def test_pointwise_values(spark):
    rows = [(0.0, 0), (1.0, 1), (0.5, 1), (0.9, 0), (0.6, 1), (None, 1)]
    got = metrics.pointwise(scored(spark, rows)).first()
    known = [r for r in rows if r[0] is not None]
    assert got["n"] == 5
    assert (got["tp"], got["fp"], got["fn"], got["tn"]) == (2, 1, 1, 1)  # a score of 0.5 is not above 0.5
    assert got["accuracy"] == pytest.approx(3 / 5)
    assert got["precision"] == pytest.approx(2 / 3) and got["recall"] == pytest.approx(2 / 3)
    assert got["f1"] == pytest.approx(2 / 3)
    assert got["brier"] == pytest.approx(sum((p - y) ** 2 for p, y in known) / 5)
    loss = [-math.log(p if y else 1 - p) for p, y in known]
    assert got["loss"] == pytest.approx(sum(loss) / 5)


@pytest.mark.parametrize("p, y", [(0.0, 1), (1.0, 0)])
def test_log_terms_are_bounded(spark, p, y):
    assert scored(spark, [(p, y)]).agg(metrics.log_loss().alias("l")).first()["l"] == 100.0


def test_batches_count_alike_whatever_their_size(spark):
    rows = [(0, 0.9, 1), (0, 0.2, 0), (0, 0.4, 0), (1, 0.3, 1)]
    df = spark.createDataFrame(rows, "batch_id bigint, p double, y int")
    per = {r["batch_id"]: r for r in metrics.batch_metrics(df).collect()}
    assert per[0]["auc"] == 1.0 and per[1]["auc"] == 0.0
    mean = metrics.mean_over_batches(metrics.batch_metrics(df)).first()
    assert mean["accuracy"] == pytest.approx((1.0 + 0.0) / 2) and mean["row_accuracy"] == pytest.approx(3 / 4)
    assert mean["loss"] == pytest.approx((per[0]["loss"] + per[1]["loss"]) / 2)


def test_batch_auc_with_ties(spark):
    rng = random.Random(5)
    rows = [(i // 32, rng.choice([0.1, 0.2, 0.2, 0.9]), rng.randint(0, 1)) for i in range(100)]
    df = spark.createDataFrame(rows, "batch_id bigint, p double, y int")
    for r in metrics.batch_metrics(df).collect():
        assert r["auc"] == pytest.approx(pair_auc([(p, y) for b, p, y in rows if b == r["batch_id"]]))


def test_calibration_bins(spark):
    table = metrics.calibration_table(scored(spark, [(0.0, 0), (0.05, 1), (0.99, 1), (1.0, 1)]), bins=10)
    got = {r["bin"]: (r["n"], r["mean_p"], r["observed_rate"]) for r in table.collect()}
    assert set(got) == {0, 9} and got[9][0] == 2 and got[0][2] == 0.5
    ece = metrics.expected_calibration_error(table).first()["ece"]
    assert ece == pytest.approx((abs(0.025 - 0.5) * 2 + abs(0.995 - 1.0) * 2) / 4)


def test_curve_ends_at_full_recall(spark):
    rows = [(0.1, 1), (0.4, 0), (0.4, 1), (0.9, 1)]
    curve = metrics.precision_recall_curve(scored(spark, rows), pieces=2).orderBy("threshold").collect()
    assert [(r["threshold"], r["tp"], r["fp"]) for r in curve] == [(0.1, 3, 1), (0.4, 2, 1), (0.9, 1, 0)]
    assert curve[0]["recall"] == 1.0


def test_scores_are_never_ordered_in_one_task(spark):
    df = metrics.score_table(fixtures.predictions(spark, SF))
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    for i, line in enumerate(lines):
        if "SinglePartition" in line:  # only over one row per piece
            assert "HashAggregate(keys=[_chunk" in lines[i + 1]


def test_null_group_and_nan_scores(spark):
    rows = [(None, 0.9, 1), (None, 0.1, 0), ("a", 0.2, 1), ("a", 0.8, 0), ("a", float("nan"), 1), ("a", None, 1)]
    df = spark.createDataFrame(rows, "g string, p double, y int")
    assert {r.g: r.auc for r in metrics.roc_auc(df, by=["g"]).collect()} == {None: 1.0, "a": 0.0}
    assert {r.g: r.n for r in metrics.pointwise(df, by=["g"]).collect()} == {None: 2, "a": 2}


def test_scores_are_cut_by_position_without_a_list(spark):
    rng = random.Random(3)
    rows = [(0.5 + 1e-12 * rng.randint(0, 5000), rng.randint(0, 1)) for _ in range(4000)]  # all within 5e-9
    table = metrics.score_table(scored(spark, rows), pieces=40)
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "_chunk" in plan
    got = metrics.rank_metrics(table).first()
    assert got["auc"] == pytest.approx(pair_auc(rows)) and got["average_precision"] == pytest.approx(step_ap(rows))
    held = table.collect()
    assert all(r["all_pos"] == sum(y for _, y in rows) for r in held) and len(held) == len({p for p, _ in rows})
