import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import observation_rows, observations, same_rows
from vaneworks.schema import FEATURES, OBSERVATION_SCHEMA, PipelineConfig
from vaneworks.sources import images, requests, state, store
from vaneworks.sources import observations as obs_source


def test_csv_round_trip_and_bad_rows(spark, tmp_path):
    df = observations(spark, observation_rows({1: 20}))
    df.write.option("header", True).csv(str(tmp_path / "o"))
    header = ",".join(OBSERVATION_SCHEMA.names)
    bad = ["1,not a time,900,1,1,1,1,1,1,1,1,0", "1,2024-01-01T00:00:00,901,warm,1,1,1,1,1,1,1,0",
           "1,2024-01-01T00:00:00,902,1,1,1,1,1,1,1,1,7"]
    (tmp_path / "o" / "extra.csv").write_text("\n".join([header, *bad]) + "\n")
    read = obs_source.with_reject_reason(obs_source.read_observations(spark, str(tmp_path / "o")))
    good, rejected = obs_source.split_rejected(read)
    same_rows(good, df)
    reasons = sorted((r["event_id"], r["reject_reason"]) for r in rejected.collect())
    assert [r[1] for r in reasons] == ["malformed", "malformed", "bad_label"]


def test_parquet_filter_reaches_the_scan(spark, tmp_path):
    df = observations(spark, observation_rows({1: 20}))
    df.write.parquet(str(tmp_path / "p"))
    read = obs_source.read_observations(spark, str(tmp_path / "p"), fmt="parquet")
    same_rows(read, df)
    plan = read.where("series_id = 1").select("temperature")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(series_id,1)" in plan and "humidity" not in plan
    with pytest.raises(ValueError):
        obs_source.read_observations(spark, "x", fmt="xml")


def test_timestamp_coercion(spark):
    df = spark.createDataFrame([("2024-01-01 05:06:07.000008",), ("never",)], "timestamp string")
    lenient = obs_source.coerce_timestamp(df, strict=False).collect()
    assert str(lenient[0][0]) == "2024-01-01 05:06:07.000008" and lenient[1][0] is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        obs_source.coerce_timestamp(df).collect()
    done = obs_source.coerce_timestamp(df, strict=False)
    assert obs_source.coerce_timestamp(done) is done


@pytest.mark.parametrize(
    "name, full, token",
    [
        ("20240101_130000.npy", "2024-01-01 13:00:00", "2024-01-01 00:00:00"),
        ("20240101_130000_b2.npy", "2024-01-01 13:00:00", "2024-01-01 00:00:00"),
        ("20240101.npy", "2024-01-01 00:00:00", "2024-01-01 00:00:00"),
        ("20240101_x.npy", "2024-01-01 00:00:00", "2024-01-01 00:00:00"),
        ("2024-03-05_x.npy", "2024-03-05 00:00:00", "2024-03-05 00:00:00"),
        ("20249901_130000.npy", None, None),
        ("image.npy", None, None),
    ],
)
def test_file_time(spark, name, full, token):
    df = spark.createDataFrame([(f"file:/a_b/{name}",)], "path string")
    r = df.select(images.file_time(F.col("path")).alias("f"), images.file_time(F.col("path"), "first_token").alias("t")).first()
    assert (r["f"] and str(r["f"])) == full and (r["t"] and str(r["t"])) == token


def test_image_directory(spark, tmp_path):
    rng = np.random.default_rng(0)
    block = rng.random((3, 4, 5))
    np.save(tmp_path / "20240101_000000.npy", block)
    np.save(tmp_path / "20240101_010000.npy", np.zeros((4, 5)))
    np.save(tmp_path / "20240101_020000.npy", np.zeros((3, 4, 4)))
    np.save(tmp_path / "nodate.npy", block)
    np.save(tmp_path / "20240101_040000.npy", np.array([[["a"]]]))
    np.save(tmp_path / "20240101_050000.npy", np.array([[[{"k": 1}]]], dtype=object), allow_pickle=True)
    (tmp_path / "20240101_030000.npy").write_bytes(b"not an array")
    (tmp_path / "20240101_000000.txt").write_text("x")
    (tmp_path / "inner").mkdir()
    np.save(tmp_path / "inner" / "20240101_090000.npy", block)
    assert images.list_images(spark, str(tmp_path)).count() == 7
    got = {r["path"].split("/")[-1]: r for r in images.read_images(spark, str(tmp_path), shape=(3, 4, 5)).collect()}
    reasons = {name: r["reject_reason"] for name, r in got.items()}
    assert reasons == {
        "20240101_000000.npy": None,
        "20240101_010000.npy": "wrong_rank",
        "20240101_020000.npy": "wrong_shape",
        "20240101_030000.npy": "undecodable",
        "20240101_040000.npy": "wrong_shape",
        "20240101_050000.npy": "undecodable",
        "nodate.npy": "bad_timestamp",
    }
    good = got["20240101_000000.npy"]
    assert good["shape"] == [3, 4, 5] and good["series_id"] == 0
    assert np.array_equal(np.array(good["pixels"], dtype=np.float32), block.astype(np.float32).ravel())
    by_path = images.read_images(spark, str(tmp_path), series=F.length("path")).select("series_id").first()
    assert by_path["series_id"] > 0


def body(**changes):
    request = {"satellite_image": [[[0.5, 1.0]]], "weather_data": {f: float(i) for i, f in enumerate(FEATURES)}}
    request.update(changes)
    return json.dumps({k: v for k, v in request.items() if v is not None})


def test_snapshot_requests(spark):
    weather = {f: 1.0 for f in FEATURES[:-1]}
    rows = [
        (1, "application/json", body()),
        (2, "text/csv", body()),
        (3, "application/json", body()[:-3]),
        (4, "application/json", body(satellite_image=None)),
        (5, "application/json", body(weather_data=weather)),
        (6, "application/json", json.dumps({"invalid_key": "invalid_value"})),
        (7, None, body()),
        (8, "application/json", None),
        (9, "application/json", body(weather_data={**weather, "visibility": "far"})),
    ]
    df = spark.createDataFrame(rows, "request_id bigint, content_type string, body string")
    got = {r["request_id"]: r for r in requests.decode_snapshots(df).collect()}
    assert {k: r["reject_reason"] for k, r in got.items()} == {
        1: None, 2: "unsupported_content_type", 3: "malformed", 4: "missing_image", 5: "missing_feature",
        6: "missing_image", 7: "unsupported_content_type", 8: "malformed", 9: "malformed",
    }
    assert [got[1][f] for f in FEATURES] == [float(i) for i in range(8)] and got[1]["image"] == [[[0.5, 1.0]]]


def test_sequence_requests(spark):
    step = [0.0] * 8
    rows = [
        (1, json.dumps({"image": [[[[1.0]]]], "sequence": [[step, step]]})),
        (2, json.dumps({"image": [[[[1.0]]]]})),
        (3, json.dumps({"sequence": [[step]]})),
        (4, json.dumps({"image": [[[[1.0]]]], "sequence": [[step, [1.0]]]})),
        (5, "{"),
    ]
    df = spark.createDataFrame(rows, "id bigint, body string").withColumn("content_type", F.lit("application/json"))
    got = {r["id"]: r for r in requests.decode_sequences(df).collect()}
    assert [got[i]["reject_reason"] for i in range(1, 6)] == [
        None, "missing_sequence", "missing_image", "wrong_width", "malformed"]
    assert got[1]["sequence"] == [[step, step]]


def test_responses(spark):
    df = spark.createDataFrame([(0.25, "application/json"), (0.5, "text/html")], "p double, accept string")
    plain = [json.loads(r["response"]) for r in requests.encode_responses(df).collect()]
    assert plain[0] == {"prediction": [[0.25]], "probability": 0.25}
    typed = requests.encode_responses(df, accept="accept").collect()
    assert typed[1]["response"] is None and typed[1]["reject_reason"] == "unsupported_content_type"
    assert typed[0]["reject_reason"] is None


def test_config_round_trip():
    config = PipelineConfig.from_dict({"weight_decay": "1e-5", "batch_size": "16"})
    assert config.weight_decay == 1e-5 and config.batch_size == 16
    assert PipelineConfig.from_json(config.to_json()) == config
    with pytest.raises(ValueError):
        PipelineConfig.from_dict({"batchsize": 1})


def test_tables_survive_a_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("temperature", 1.5, 2.0, 9)], "feature string, mean double, scale double, n bigint")
    state.save_table(df, str(tmp_path / "s"))
    state.save_table(df, str(tmp_path / "s"))
    same_rows(state.load_table(spark, str(tmp_path / "s")), df)


def test_files_are_decoded_once_and_constant_images_are_rejected(spark, tmp_path):
    for i, values in enumerate(([0.0, 1.0, 2.0, 3.0], [5.0] * 4)):
        np.save(tmp_path / f"20240101_0{i}0000.npy", np.array(values).reshape(1, 2, 2))
    standard = images.standardise_images(images.read_images(spark, str(tmp_path), shape=(1, 2, 2)))
    good = standard.where("reject_reason is null")
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2  # one decodes, one standardises
    assert [r["reject_reason"] for r in standard.orderBy("path").collect()] == [None, "constant_image"]
    assert good.first()["pixels"] == pytest.approx([-1.161895, -0.387298, 0.387298, 1.161895], abs=1e-6)


def test_csv_columns_are_found_by_name(spark, tmp_path):
    df = observations(spark, observation_rows({1: 5}))
    shuffled = df.select("storm_event", "humidity", *[c for c in df.columns if c not in ("storm_event", "humidity")][::-1])
    shuffled.withColumn("note", F.lit("x")).write.option("header", True).csv(str(tmp_path / "o"))
    same_rows(obs_source.read_observations(spark, str(tmp_path / "o")).drop("_corrupt_record"), df)
    bare = df.drop("series_id", "event_id")
    bare.write.option("header", True).csv(str(tmp_path / "b"))
    with pytest.raises(ValueError, match="series_id"):
        obs_source.read_observations(spark, str(tmp_path / "b"))
    read = obs_source.read_observations(spark, str(tmp_path / "b"), optional=("series_id", "event_id"))
    same_rows(read.select(*bare.columns), bare)
    assert read.where("series_id = 0").select("event_id").distinct().count() == 5


def test_rows_without_a_series_are_set_aside(spark):
    rows = observations(spark, observation_rows({1: 2})).withColumn("series_id", F.when(F.col("event_id") == 0, 1))
    assert [r.reject_reason for r in obs_source.with_reject_reason(rows).orderBy("event_id").collect()] == [None, "missing_series"]


def test_wall_clock_of_skipped_and_repeated_hours(spark):
    from vaneworks.functions.times import ntz, wall_micros

    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        found = []
        for name in ("UTC", "America/New_York", "Asia/Kathmandu"):
            spark.conf.set("spark.sql.session.timeZone", name)
            times = spark.sql("select explode(array(timestamp_ntz'2024-03-10 02:30:00.000001', timestamp_ntz'2024-03-10 03:30:00', timestamp_ntz'1969-12-31 23:59:59.5')) as t")
            found.append([r[0] for r in times.select(wall_micros(F.col("t"))).collect()])
            import datetime as dt

            assert spark.range(1).select(ntz(dt.datetime(2024, 3, 10, 2, 30)).cast("string")).first()[0] == "2024-03-10 02:30:00"
        assert found[0] == found[1] == found[2] and found[0][1] - found[0][0] == 3_600_000_000 - 1 and found[0][2] == -500_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_bad_sequences_have_a_reason(spark):
    import json

    from vaneworks.streaming import scoring

    good = [[1.0] * 8, [2.0] * 8]
    bodies = {"ok": [good], "empty_sequence": [], "wrong_width": [good, [[1.0] * 7]], "missing_value": [[[None] * 8] * 2], "wrong_length": [good[:1]], "missing_sequence": None}
    rows = [(i, "application/json", json.dumps({"image": [[[[1.0]]]], "sequence": s})) for i, s in enumerate(bodies.values())]
    rows += [(90, "application/json", json.dumps({"image": [[[[1.0]]]], "sequence": [[]]})), (91, "application/json", json.dumps({"image": [[[[1.0]]]], "sequence": [[None]]})), (92, "application/json", "{")]
    got = scoring.score_sequences(spark.createDataFrame(rows, "request_id long, content_type string, body string"), {"intercept": 0.0, "mean_temperature": 1.0}, length=2).collect()
    assert {r.request_id: r.reject_reason or "ok" for r in got} == dict(enumerate(bodies)) | {90: "empty_sequence", 91: "wrong_width", 92: "malformed"}
    assert [r.request_id for r in got if r.response is not None] == [0]


def test_store_packs_each_state_of_a_file_once(spark, tmp_path):
    source, packed = tmp_path / "in", str(tmp_path / "store")
    (source / "day 1" / "cam=é").mkdir(parents=True)

    def put(name, value, when):
        np.save(source / name, np.full((1, 2, 2), value) + np.arange(4).reshape(1, 2, 2))
        os.utime(source / name, (when, when))

    assert store.pack_images(spark, str(source), packed) == 0 and store.read_store(spark, packed).collect() == []
    for hour in range(5):
        put(f"2024010{1 + hour % 2}_0{hour}0000.npy", hour, 1_700_000_000)
    put("day 1/cam=é/20240103_000000.npy", 7, 1_700_000_000)
    (source / "20240109_000000.npy").write_bytes(b"no array")
    (source / "_20240109_000000.npy").write_bytes(b"hidden")
    (source / "20240109_000000.txt").write_bytes(b"note")
    assert store.pack_images(spark, str(source), packed, shape=(1, 2, 2), pack_bytes=400) == 7
    assert store.pack_images(spark, str(source), packed, shape=(1, 2, 2)) == 0

    put("20240101_000000.npy", 50, 1_700_000_100)  # changed
    put("20240201_000000.npy", 60, 1_700_000_100)  # new
    (source / "20240102_010000.npy").unlink()  # deleted, stays in the store
    before = {r.path for r in store.manifest(spark, packed).collect()}
    assert store.pack_images(spark, str(source), packed, shape=(1, 2, 2)) == 2
    second = {r.path.split("/")[-1] for r in store.manifest(spark, packed).where("run = 2").collect()}
    assert second == {"20240101_000000.npy", "20240201_000000.npy"} and len(before) == 7
    assert spark.read.parquet(f"{packed}/images/run=2").count() == 2

    got = {r.path: r for r in store.read_store(spark, packed).collect()}
    names = {p.split("/")[-1]: r for p, r in got.items()}
    assert len(got) == 8 and names["20240101_000000.npy"].pixels == [50.0, 51.0, 52.0, 53.0]
    assert names["20240109_000000.npy"].reject_reason == "undecodable" and names["20240102_010000.npy"].pixels[0] == 1.0
    direct = {r.path: r for r in images.read_images(spark, str(source / "*.npy"), shape=(1, 2, 2)).collect()}
    assert all(got[p] == r for p, r in direct.items()) and len(direct) == 6


def test_store_passes_over_a_run_without_a_manifest(spark, tmp_path):
    source, packed = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    np.save(source / "20240101_000000.npy", np.ones((1, 1, 1)))
    store.pack_images(spark, str(source), packed)
    broken = spark.read.parquet(f"{packed}/images/run=1")
    broken.withColumn("path", F.lit("x/20240105_000000.npy")).write.parquet(f"{packed}/images/run=2")
    assert [r.path.split("/")[-1] for r in store.read_store(spark, packed).collect()] == ["20240101_000000.npy"]
    np.save(source / "20240102_000000.npy", np.ones((1, 1, 1)))
    assert store.pack_images(spark, str(source), packed) == 1
    assert sorted(r.path.split("/")[-1] for r in store.read_store(spark, packed).collect()) == ["20240101_000000.npy", "20240102_000000.npy"]


def test_listing_holds_no_file_in_the_driver(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"d{k}").mkdir()
        for i in range(4):
            np.save(tmp_path / f"d{k}" / f"2024010{1 + i}_000000.npy", np.ones((1, 1, 1)))
    files = store.list_files(spark, str(tmp_path))
    plan = files._jdf.queryExecution().toString()
    assert files.count() == 12 and "binaryFile" not in plan and "LocalTableScan" not in plan and "LocalRelation" not in plan
