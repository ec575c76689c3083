import random

import pytest
from pyspark.sql import functions as F

from conftest import observation_rows, observations
from test_scale import OPTIONS
from vaneworks.operators import history, metrics, models, windows
from vaneworks.schema import PipelineConfig
from vaneworks.sources import state


@pytest.fixture(scope="module")
def planted(spark):
    """Windows whose label says whether the mean temperature is above its middle."""
    found = windows.labelled_windows(observations(spark, observation_rows({1: 200, 2: 200})), None, 6)
    found = found.withColumn("label", (F.col("mean_temperature") > 4.5).cast("int"))
    return found.repartition(4).cache(), windows.window_feature_columns(found)


@pytest.fixture(scope="module")
def fitted(planted):
    return models.fit_logistic(*planted, max_iter=30)


def test_logistic_model_beats_a_constant(planted, fitted):
    df, _ = planted
    scored = models.score(df, fitted)
    assert metrics.roc_auc(scored, y="label").first()["auc"] > 0.95
    losses = fitted.stages[-1].summary.objectiveHistory
    assert all(v >= 0 for v in losses) and losses[-1] < losses[0]


def test_scores_are_probabilities_and_keep_every_row(planted, fitted):
    df, _ = planted
    scored = models.score(df, fitted, threshold=0.5)
    assert scored.columns == [*df.columns, "p", "decision"]
    rows = scored.collect()
    assert len(rows) == df.count() and all(0 <= r["p"] <= 1 and r["decision"] == (r["p"] >= 0.5) for r in rows)


def test_missing_features_are_not_scored(planted, fitted):
    df, _ = planted
    holed = df.withColumn("mean_humidity", F.when(F.col("event_id") > 50, F.col("mean_humidity")))
    rows = models.score(holed, fitted).collect()
    assert len(rows) == df.count()
    assert all((r["p"] is None) == (r["event_id"] <= 50) for r in rows)
    assert models.complete_rows(holed, ["mean_humidity"]).count() == sum(r["event_id"] > 50 for r in rows)


def test_exported_weights_score_like_the_model(planted, fitted):
    df, _ = planted
    a = {r["event_id"]: r["p"] for r in models.score(df, fitted).collect()}
    b = {r["event_id"]: r["p"] for r in models.score_linear(df, models.linear_coefficients(fitted)).collect()}
    assert max(abs(a[k] - b[k]) for k in a) < 1e-12


def test_model_and_settings_survive_a_round_trip(spark, planted, fitted, tmp_path):
    df, _ = planted
    state.save_model(fitted, PipelineConfig(threshold=0.25), str(tmp_path / "m"))
    loaded, config = state.load_model(spark, str(tmp_path / "m"))
    assert config.threshold == 0.25
    pick = lambda m: sorted((r["event_id"], r["p"]) for r in models.score(df, m).collect())
    assert pick(loaded) == pick(fitted)


def test_boosted_trees_learn_the_signal(planted):
    df, names = planted
    scored = models.score(df, models.fit_boosted_trees(df, names, max_iter=3))
    assert metrics.roc_auc(scored, y="label").first()["auc"] > 0.9


@pytest.mark.parametrize("family", ["logistic", "trees"])
def test_search_picks_the_lowest_loss(planted, family):
    df, names = planted
    best, trials = models.search(df, names, family=family, trials=3, max_iter=3)
    rows = trials.collect()
    assert len(rows) == 3 and sum(r["is_best"] for r in rows) == 1
    assert min(rows, key=lambda r: r["val_loss"])["is_best"]
    assert models.score(df, best).where("p between 0 and 1").count() == df.count()
    assert set(trials.columns) == {"trial", "family", "iterations", "val_loss", "is_best"} | ({"weight_decay", "dropout"} if family == "logistic" else {"num_layers", "learning_rate"})
    again = models.search(df.repartition(1), names, family=family, trials=3, max_iter=3)[1].collect()
    assert [r["val_loss"] for r in again] == pytest.approx([r["val_loss"] for r in rows], abs=1e-6)
    with pytest.raises(ValueError):
        models.search(df, names, family="other")


def test_search_keeps_to_the_given_split(planted):
    df, names = planted
    parted = df.withColumn("split", F.when(F.col("event_id") % 3 == 0, "val").when(F.col("event_id") % 3 == 1, "gap").otherwise("train"))
    broken = parted.withColumn("label", F.when(F.col("split") == "gap", 1 - F.col("label")).otherwise(F.col("label")))
    losses = [[r["val_loss"] for r in models.search(d, names, trials=2, max_iter=3)[1].collect()] for d in (parted, broken)]
    assert losses[0] == pytest.approx(losses[1])


def test_gradient_tells_a_broken_model(planted):
    df, names = planted
    weights = models.linear_coefficients(models.fit_logistic(df, names, weight_decay=1e-2))
    assert max(abs(g) for g in models.loss_gradient(df, weights, weight_decay=1e-2).values()) < 1e-3
    weights["mean_temperature"] += 0.5
    assert max(abs(g) for g in models.loss_gradient(df, weights, weight_decay=1e-2).values()) > 1e-2


def test_missing_losses_do_not_stop_a_run(spark):
    for gap in (None, float("nan")):
        rows = [(0, i + 1, v) for i, v in enumerate((0.9, gap, 0.5, 0.3, 0.2))] + [(None, 1, gap), (None, 2, 0.4)]
        df = spark.createDataFrame(rows, "run int, epoch int, val_loss double")
        got = {r.run: r for r in history.best_checkpoint(df, patience=3).collect()}
        assert (got[0].best_epoch, got[0].min_epoch, got[None].best_epoch, got[None].min_loss) == (5, 5, 2, 0.4)
        assert {r.run: r.stop_epoch for r in history.early_stopping(df, patience=3).collect()} == {0: -1, None: -1}


def test_draws_stay_in_their_ranges_and_follow_the_seed():
    drawn = models.draw_trials(50, seed=3)
    assert drawn == models.draw_trials(50, seed=3) != models.draw_trials(50, seed=4)
    for t in drawn:
        for name, (low, high, _) in models.SEARCH_RANGES.items():
            assert low <= t[name] <= high


def stop_by_loop(losses, patience, delta):
    best, best_epoch, counter = float("inf"), -1, 0
    for epoch, loss in losses:
        if loss < best - delta:
            best, best_epoch, counter = loss, epoch, 0
        else:
            counter += 1
            if counter >= patience:
                return best_epoch, epoch
    return best_epoch, -1


@pytest.mark.parametrize("options", OPTIONS[:4])
@pytest.mark.parametrize("patience, delta", [(3, 0.05), (1, 0.0), (5, 0.3)])
def test_early_stopping_equals_the_loop(spark, options, patience, delta):
    if options.get("chunk_rows", 99) < patience:
        pytest.skip("a chunk holds at least the patience")
    rng = random.Random(11)
    runs = {1: 120, 2: 30, 3: 1, 4: 9}
    rows = [(run, 2 * e, round(rng.random() + 1.0 / (e + 1), 3)) for run, n in runs.items() for e in range(n)]
    df = spark.createDataFrame(rows, "run bigint, epoch int, val_loss double")
    got = history.early_stopping(df, patience=patience, min_delta=delta, **options).collect()
    want = {r: stop_by_loop([(e, v) for k, e, v in rows if k == r], patience, delta) for r in runs}
    assert {r["run"]: (r["best_epoch"], r["stop_epoch"]) for r in got} == want


def test_early_stopping_without_any_improvement(spark):
    df = spark.createDataFrame([(1, e, float("inf")) for e in range(5)], "run bigint, epoch int, val_loss double")
    got = history.early_stopping(df, patience=3).first()
    assert (got["best_epoch"], got["best_loss"], got["stop_epoch"]) == (-1, None, 2)


def test_best_checkpoint_differs_from_the_minimum_after_the_stop(spark):
    losses = [1.0, 0.5, 0.6, 0.6, 0.1]
    df = spark.createDataFrame([(1, e, v) for e, v in enumerate(losses)], "run bigint, epoch int, val_loss double")
    got = history.best_checkpoint(df, patience=2, min_delta=0.01).first()
    assert (got["best_epoch"], got["best_loss"], got["min_epoch"], got["min_loss"]) == (1, 0.5, 4, 0.1)


@pytest.mark.parametrize("options", OPTIONS[:3])
def test_epoch_report(spark, options):
    df = spark.createDataFrame([(1, e, v) for e, v in enumerate([3.0, 2.0, 2.5] * 10)], "run bigint, epoch int, val_loss double")
    got = history.epoch_report(df, **options).orderBy("epoch").collect()
    assert [r["delta"] for r in got[:4]] == [None, -1.0, 0.5, 0.5]
    assert [r["best_so_far"] for r in got[:4]] == [3.0, 2.0, 2.0, 2.0] and len(got) == 30


def test_objective_history_rows(spark, planted, fitted):
    rows = models.objective_history(fitted, "r1", planted[0]).collect()
    assert [r["epoch"] for r in rows] == list(range(len(rows))) and rows[-1]["value"] < rows[0]["value"]


def test_a_long_falling_run_needs_no_array(spark):
    n = 300_000
    falling = spark.range(n).selectExpr("7 as run", "id as epoch", "1000000.0D - id as val_loss")
    flat = spark.range(50).selectExpr("8 as run", "id as epoch", "if(id = 0, 5.0D, 4.9999D) as val_loss")
    found = history.early_stopping(falling.unionByName(flat), patience=10, strategy="partition")
    assert {r.run: (r.best_epoch, r.stop_epoch) for r in found.collect()} == {7: (n - 1, -1), 8: (0, 10)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "collect_set" not in plan


def test_stopping_point_equals_the_loop():
    rng = random.Random(2)
    for _ in range(300):
        losses = [round(rng.random(), 1) for _ in range(rng.randint(0, 12))]
        patience, delta = rng.randint(1, 4), rng.choice([0.0, 0.05, 0.2])
        assert history.stopping_point(losses, patience, delta) == stop_by_loop(list(enumerate(losses)), patience, delta)


@pytest.mark.parametrize("family", ["logistic", "trees"])
def test_halving_gives_survivors_the_loss_of_a_full_run(planted, family):
    df, names = planted
    halved = {r.trial: r for r in models.search(df, names, family=family, trials=5, max_iter=4, keep_one_in=2)[1].collect()}
    alone = {r.trial: r for r in models.search(df, names, family=family, trials=5, max_iter=4, parallelism=1)[1].collect()}
    assert sorted(r.iterations for r in halved.values()) == [1, 1, 2, 4, 4] and {r.iterations for r in alone.values()} == {4}
    survivors = [t for t, r in halved.items() if r.iterations == 4]
    assert all(halved[t].val_loss == pytest.approx(alone[t].val_loss, abs=1e-9) for t in survivors)
    best = min(survivors, key=lambda t: (alone[t].val_loss, t))
    assert [t for t, r in halved.items() if r.is_best] == [best]
    assert models.rungs(20, 8, 2) == [1, 2, 4, 8] and models.rungs(1, 8, 2) == [8] == models.rungs(20, 8, 1)


@pytest.mark.parametrize("family", ["logistic", "trees"])
def test_the_kept_state_is_that_of_the_best_epoch(spark, planted, family):
    df, names = planted
    parted = df.withColumn("split", F.when(F.col("event_id") % 3 == 0, "val").otherwise("train")).cache()
    model, table = models.fit_epochs(parted, names, family=family, max_iter=12, epoch_iterations=1, patience=2, min_delta=0.02)
    rows = table.orderBy("epoch").collect()
    best, stop = stop_by_loop([(r.epoch, r.val_loss) for r in rows], 2, 0.02)
    assert rows[-1].epoch == stop or (stop == -1 and len(rows) == 12)
    assert history.early_stopping(table, patience=2, min_delta=0.02).first()["best_epoch"] == best
    for split, column in (("val", "val_loss"), ("train", "train_loss")):
        scored = models.score(parted.where(F.col("split") == split), model)
        assert scored.agg(metrics.log_loss("p", "label").alias("x")).first()["x"] == pytest.approx(rows[best - 1][column], abs=1e-6)
    whole, table = models.fit_epochs(parted.where("split = 'train'"), names, family=family, max_iter=3, epoch_iterations=1, patience=1)
    assert [r.val_loss for r in table.collect()] == [None] * 3 and models.score(df, whole).where("p is null").count() == 0
