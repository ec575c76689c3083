import json
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from conftest import observation_rows, observations
from vaneworks.plans import training_job
from vaneworks.schema import PipelineConfig
from vaneworks.sources import images, state


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """80 hourly rows of one series; the label repeats the row's own temperature above its middle."""
    folder = tmp_path_factory.mktemp("job")
    rows = [r[:-1] + (int(r[3] > 4),) for r in observation_rows({0: 80})]
    df = observations(spark, rows)
    df.write.option("header", True).csv(str(folder / "obs"))
    rng = np.random.default_rng(1)
    (folder / "images").mkdir()
    for i, r in enumerate(rows):
        shape = (3, 8, 8) if i != 70 else (3, 8, 7)
        np.save(folder / "images" / r[1].strftime("%Y%m%d_%H%M%S.npy"), rng.random(shape))
    return folder, df


@pytest.mark.parametrize("split, fit_on", [("time", "train"), ("random", "all")])
def test_job_writes_every_product(spark, files, tmp_path, split, fit_on):
    folder, df = files
    out = str(tmp_path / "out")
    config = PipelineConfig(sequence_length=6, max_iter=10, batch_size=8, fit_on=fit_on)
    pics = images.read_images(spark, str(folder / "images"), shape=(3, 8, 8))
    table = training_job.run(spark, df, pics, out, config, (3, 8, 8), split)
    n = 80 - 6 - 6  # windows, without those that see the refused image
    got = {r["split"]: r["n"] for r in table.collect()}
    assert sum(got.values()) == n
    if split == "random":
        assert got == {"train": int(n * 0.8), "val": int(n * 0.1), "test": n - int(n * 0.8) - int(n * 0.1)}
    else:
        assert set(got) == {"train", "gap", "val"} and got["gap"] == 6
    windows = spark.read.parquet(f"{out}/windows")
    assert len([c for c in windows.columns if c.startswith("mean_cell_")]) == 12
    params = {r["feature"]: r for r in spark.read.parquet(f"{out}/scaler").collect()}
    assert len(params) == 8 and (params["humidity"]["n"] == 80) == (fit_on == "all")
    model, loaded = state.load_model(spark, f"{out}/model")
    assert loaded == config
    assert spark.read.parquet(f"{out}/scores").where("p between 0 and 1").count() == n
    assert spark.read.parquet(f"{out}/batch_means").first()["batches"] == -(-got["val"] // 8)
    assert spark.read.parquet(f"{out}/rejected").count() == 0 and spark.read.parquet(f"{out}/history").count() > 1


def test_job_from_the_command_line(files, tmp_path):
    folder, _ = files
    (tmp_path / "c.json").write_text(json.dumps({"sequence_length": 6, "max_iter": 5}))
    command = [sys.executable, "-m", "vaneworks.plans.training_job", "--observations", str(folder / "obs"),
               "--images", str(folder / "images"), "--image-shape", "3", "8", "8",
               "--config", str(tmp_path / "c.json"), "--out", str(tmp_path / "out")]
    done = subprocess.run(command, cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "average_precision" in done.stdout and (tmp_path / "out" / "scores").exists()


@pytest.mark.parametrize("family", ["logistic", "trees"])
def test_job_stores_the_winner_at_its_best_epoch(spark, files, tmp_path, family):
    from pyspark.sql import functions as F

    from vaneworks.operators import metrics

    _, df = files
    out = str(tmp_path / "out")
    config = PipelineConfig(sequence_length=6, max_iter=5, epoch_iterations=5, patience=9, min_delta=0.0)
    training_job.run(spark, df, None, out, config, None, "time", trials=3, family=family)
    tried = spark.read.parquet(f"{out}/trials").collect()
    assert len(tried) == 3 and sum(r["is_best"] for r in tried) == 1
    winner = next(r for r in tried if r["is_best"])
    history = spark.read.parquet(f"{out}/history").orderBy("epoch").collect()
    assert history[-1].val_loss == pytest.approx(winner.val_loss, abs=1e-6)  # the last epoch is the trial
    model, _ = state.load_model(spark, f"{out}/model")
    stage = model.stages[-1]
    if family == "logistic":
        assert (stage.getRegParam(), stage.getElasticNetParam()) == (winner.weight_decay, winner.dropout)
    else:
        assert (stage.getMaxDepth(), stage.getStepSize()) == (int(winner.num_layers), min(1.0, 10 * winner.learning_rate))
    best = spark.read.parquet(f"{out}/best_epoch").first()
    scores = spark.read.parquet(f"{out}/scores").where("split = 'val'")
    loss = scores.agg(metrics.log_loss("p", "label").alias("x")).first()["x"]
    assert loss == pytest.approx(best.best_loss, abs=1e-6) and best.best_loss == min(r.val_loss for r in history)
    if family == "trees":
        assert stage.getNumTrees == best.best_epoch
