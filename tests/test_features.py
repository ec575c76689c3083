import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import observation_rows, observations, same_rows
from vaneworks.functions import vectors
from vaneworks.functions.pixels import cell_means, standardise_image
from vaneworks.operators import scaling
from vaneworks.schema import FEATURES


def one(spark, value, kind):
    return spark.createDataFrame([(value,)], f"v {kind}")


def test_vector_keeps_the_order_of_the_contract(spark):
    rows = observation_rows({1: 1})
    v = observations(spark, rows).select(vectors.feature_vector().alias("v")).first()["v"]
    assert v == list(rows[0][3:11])


def test_absent_features_are_skipped(spark):
    df = observations(spark, observation_rows({1: 5})).drop("humidity")
    assert vectors.present(df) == [f for f in FEATURES if f != "humidity"]
    params = scaling.fit_scaler(df)
    assert "humidity" not in {r["feature"] for r in params.collect()}
    assert scaling.apply_scaler(df, params).columns == df.columns


def test_image_uses_the_sample_deviation(spark):
    values = [1.0, 2.0, 4.0, 8.0]
    got = one(spark, values, "array<float>").select(standardise_image("v").alias("v")).first()["v"]
    mean, dev = statistics.mean(values), statistics.stdev(values)
    assert got == pytest.approx([(v - mean) / dev for v in values])


@pytest.mark.parametrize("values", [[3.0, 3.0, 3.0], [5.0], [], None])
def test_constant_images_have_no_standard_form(spark, values):
    got = one(spark, values, "array<float>").select(standardise_image("v").alias("v")).first()
    assert got["v"] is None


def test_large_values_keep_their_small_deviations(spark):
    values = [1e8 + i for i in range(4)]
    got = one(spark, values, "array<double>").select(standardise_image("v").alias("v")).first()["v"]
    assert got == pytest.approx([(i - 1.5) / statistics.stdev([0, 1, 2, 3]) for i in range(4)])


def test_sequence_uses_one_population_deviation_and_keeps_its_shape(spark):
    seq = [[1.0, 2.0], [3.0, 10.0], [0.0, 2.0]]
    got = one(spark, seq, "array<array<double>>").select(vectors.standardise_sequence(F.col("v")).alias("v")).first()
    block = np.array(seq)
    assert np.allclose(np.array(got["v"]), (block - block.mean()) / block.std())


def test_pixel_scale_and_snapshot(spark):
    got = one(spark, [0.0, 51.0, 255.0], "array<float>").select(vectors.scale_pixels(F.col("v")).alias("v")).first()
    assert got["v"] == pytest.approx([0.0, 0.2, 1.0])
    seq = one(spark, [1.0, 2.0], "array<double>").select(vectors.repeat_snapshot(F.col("v"), 3).alias("v")).first()
    assert seq["v"] == [[1.0, 2.0]] * 3


def test_threshold_at_the_exact_score(spark):
    df = spark.createDataFrame([(0.4,), (0.5,), (0.6,), (None,)], "p double")
    got = df.select(
        vectors.above(F.col("p"), 0.5).alias("ge"),
        vectors.above(F.col("p"), 0.5, inclusive=False).alias("gt"),
        vectors.above(F.col("p"), None).alias("same"),
    ).collect()
    assert [r["ge"] for r in got] == [False, True, True, None]
    assert [r["gt"] for r in got] == [False, False, True, None]
    assert [r["same"] for r in got] == [0.4, 0.5, 0.6, None]


@pytest.mark.parametrize("shape, grid", [((1, 8, 8), 2), ((3, 5, 7), 3), ((2, 4, 4), 1), ((1, 6, 4), 4)])
def test_cell_means_equal_the_loop(spark, shape, grid):
    c, h, w = shape
    block = np.arange(c * h * w, dtype=float).reshape(shape) ** 1.5
    want = [
        np.mean([block[ch, r, k] for r in range(h) for k in range(w) if r * grid // h == gr and k * grid // w == gk])
        for ch in range(c) for gr in range(grid) for gk in range(grid)
    ]
    df = spark.createDataFrame([(block.ravel().tolist(),), ([1.0],), (None,)], "v array<double>")
    got = [r["m"] for r in df.select(cell_means(c, h, w, grid)("v").alias("m")).collect()]
    assert got[0] == pytest.approx(want) and got[1:] == [None, None]


def test_images_of_one_batch_may_differ_in_size(spark):
    images = [[1.0, 2.0], [], None, [5.0, 5.0], [0.0, 1.0, 5.0], [7.0]]
    df = spark.createDataFrame(list(enumerate(images)), "id int, v array<double>").coalesce(1)
    got = {r["id"]: r["m"] for r in df.select("id", standardise_image("v").alias("m")).collect()}
    for i, values in enumerate(images):
        if i in (0, 4):
            mean, dev = statistics.mean(values), statistics.stdev(values)
            assert got[i] == pytest.approx([(v - mean) / dev for v in values])
        else:
            assert got[i] is None


def test_cell_grid_must_fit():
    with pytest.raises(ValueError):
        cell_means(1, 4, 4, 5)


def test_scaler_population_deviation_missing_values_and_constants(spark):
    df = spark.createDataFrame(
        [(1.0, 5.0), (2.0, 5.0), (math.nan, 5.0), (None, 5.0), (6.0, 5.0)], "temperature double, humidity double"
    )
    got = {r["feature"]: r for r in scaling.fit_scaler(df).collect()}
    assert got["temperature"]["mean"] == pytest.approx(3.0) and got["temperature"]["n"] == 3
    assert got["temperature"]["scale"] == pytest.approx(statistics.pstdev([1.0, 2.0, 6.0]))
    assert got["humidity"]["scale"] == 1.0
    scaled = scaling.apply_scaler(df, scaling.fit_scaler(df)).collect()
    assert [r["humidity"] for r in scaled] == [0.0] * 5
    assert math.isnan(scaled[2]["temperature"]) and scaled[3]["temperature"] is None


def test_scaled_features_have_mean_zero(spark):
    df = observations(spark, observation_rows({1: 50, 2: 30}))
    scaled = scaling.apply_scaler(df, scaling.fit_scaler(df))
    for r in scaling.fit_scaler(scaled).collect():
        assert r["mean"] == pytest.approx(0.0, abs=1e-9) and r["scale"] == pytest.approx(1.0)


def test_series_scaler_equals_scaling_each_series(spark):
    df = observations(spark, observation_rows({1: 30, 2: 20}))
    got = scaling.apply_series_scaler(df, scaling.fit_scaler(df, by=["series_id"]))
    for series in (1, 2):
        own = df.where(F.col("series_id") == series)
        same_rows(got.where(F.col("series_id") == series), scaling.apply_scaler(own, scaling.fit_scaler(own)))


def test_unknown_series_keeps_its_rows(spark):
    df = observations(spark, observation_rows({1: 5, 2: 5}))
    params = scaling.fit_scaler(df.where("series_id = 1"), by=["series_id"])
    got = scaling.apply_series_scaler(df, params).where("series_id = 2").collect()
    assert len(got) == 5 and all(r["temperature"] is None for r in got)


def test_applying_the_scaler_is_a_projection(spark):
    df = observations(spark, observation_rows({1: 5}))
    plan = scaling.apply_scaler(df, scaling.fit_scaler(df))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
