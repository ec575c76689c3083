import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF, START, observation_rows, observations, same_rows
from vaneworks.operators import models, scaling
from vaneworks.plans import fixtures
from vaneworks.schema import OBSERVATION_SCHEMA
from vaneworks.streaming import scoring
from vaneworks.streaming.windows import WindowStream, last_rows, trailing_windows

WEIGHTS = {"intercept": 0.5, "mean_temperature": -0.1}
FEATURE = ("temperature",)


def deliver(spark, online, source, rows):
    observations(spark, rows).write.mode("append").parquet(source)
    online.start(spark.readStream.schema(OBSERVATION_SCHEMA).parquet(source)).awaitTermination()


@pytest.fixture
def folders(tmp_path):
    return str(tmp_path / "source"), str(tmp_path / "online")


@pytest.mark.parametrize("options", [{}, {"strategy": "chunk", "chunk_rows": 7}, {"max_series_rows": 20, "chunk_rows": 8}])
def test_stream_equals_batch(spark, folders, options):
    rows = observation_rows({1: 60, 2: 11, 3: 3})
    source, out = folders
    online = WindowStream(out, OBSERVATION_SCHEMA, 5, FEATURE, **options)
    for low, high in ((0, 3), (3, 4), (4, 30), (30, 99)):
        deliver(spark, online, source, [r for r in rows if low <= (r[1] - START) / dt.timedelta(hours=1) < high])
    want = trailing_windows(observations(spark, rows), 5, FEATURE)
    same_rows(online.windows(spark).drop("batch_id"), want)
    assert online.late_rows(spark).count() == 0


def test_late_rows_are_set_aside(spark, folders):
    rows = observation_rows({1: 20})
    source, out = folders
    online = WindowStream(out, OBSERVATION_SCHEMA, 5, FEATURE)
    deliver(spark, online, source, rows[:10])
    late = (1, START - dt.timedelta(hours=1), 999, *[0.0] * 8, 0)
    deliver(spark, online, source, [late, rows[9], *rows[10:]])
    assert sorted(r["event_id"] for r in online.late_rows(spark).collect()) == [9, 999]
    same_rows(online.windows(spark).drop("batch_id"), trailing_windows(observations(spark, rows), 5, FEATURE))


def test_running_a_batch_again_changes_nothing(spark, folders):
    rows = observation_rows({1: 20, 2: 9})
    _, out = folders
    online = WindowStream(out, OBSERVATION_SCHEMA, 5, FEATURE, transform=lambda w: models.score_linear(w, WEIGHTS))
    first, second = observations(spark, rows[:12]), observations(spark, rows[12:])
    online.process(first, 0)
    online.process(second, 1)
    before = online.windows(spark).collect()
    online.process(second, 1)
    after = online.windows(spark).collect()
    assert sorted(before) == sorted(after) and all(0 < r["p"] < 1 for r in after)
    assert len(after) == 16 + 5


def test_idle_series_are_forgotten(spark, folders):
    _, out = folders
    online = WindowStream(out, OBSERVATION_SCHEMA, 3, FEATURE, idle_seconds=3600 * 5)
    rows = observation_rows({1: 4, 2: 30})
    online.process(observations(spark, rows), 0)
    held = {r["series_id"]: r["count"] for r in online.held_rows(spark, 0).groupBy("series_id").count().collect()}
    assert held == {2: 2}


def test_idle_series_start_again(spark, folders):
    _, out = folders
    online = WindowStream(out, OBSERVATION_SCHEMA, 3, FEATURE, idle_seconds=3600 * 5, max_versions=1)
    rows = observation_rows({1: 40, 2: 30})
    first = [r for r in rows if r[0] == 1][:4]
    back = [r for r in rows if r[0] == 1][20:24]
    online.process(observations(spark, first + [r for r in rows if r[0] == 2]), 0)
    online.process(observations(spark, back), 1)
    got = [r["event_id"] for r in online.windows(spark).where("series_id = 1").collect()]
    assert sorted(got) == [2, 3, 22, 23]


def _stored(folder):
    """(files, rows) under a folder of the state."""
    import pyarrow.parquet as pq
    from pathlib import Path

    files = list(Path(folder).rglob("*.parquet"))
    return len(files), sum(pq.read_metadata(f).num_rows for f in files)


def test_a_batch_writes_only_the_series_it_brings(spark, folders):
    _, out = folders
    rows = spark.range(10_000 * 6).selectExpr("id % 10000 as series_id", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, cast(id div 10000 as int)) as timestamp", "id as event_id", "cast(id as double) as temperature")
    online = WindowStream(out, rows.schema, 5, FEATURE, buckets=16, max_versions=3)
    online.process(rows.where("event_id < 40000"), 0)
    assert _stored(f"{out}/state/rows/batch_id=0") == (16, 40_000)
    one = rows.where("series_id = 77")
    for batch_id, at in ((1, 40_077), (2, 50_077)):
        online.process(one.where(f"event_id = {at}"), batch_id)
        assert _stored(f"{out}/state/rows/batch_id={batch_id}") == (1, 4)
    assert online.held_rows(spark, 2).count() == 40_000
    held = online.held_rows(spark, 2).where("series_id = 77").select("event_id").collect()
    assert sorted(r[0] for r in held) == [20_077, 30_077, 40_077, 50_077]
    # the bucket has three versions now: the next batch rewrites it, and the one after deletes what it left out
    late = one.where("event_id = 77")
    online.process(late, 3)
    files, kept = _stored(f"{out}/state/rows/batch_id=3")
    assert files == 1 and 4 < kept < 4 * 10_000
    assert online.held_rows(spark, 3).count() == 40_000 and _stored(f"{out}/state/rows/batch_id=1") == (1, 4)
    online.process(late, 4)
    assert _stored(f"{out}/state/rows/batch_id=1") == (0, 0) and online.held_rows(spark, 4).count() == 40_000
    online.process(late, 4)
    assert online.held_rows(spark, 4).count() == 40_000 and online.late_rows(spark).count() == 2


@pytest.mark.parametrize("options", [{"buckets": 1, "max_versions": 1}, {"buckets": 3, "max_versions": 2}])
def test_any_bucketing_gives_the_batch_windows(spark, folders, options):
    rows = observation_rows({1: 40, 2: 17, 3: 9, 4: 30})
    _, out = folders
    online = WindowStream(out, OBSERVATION_SCHEMA, 6, FEATURE, pool=("mean", "min", "max", "last"), **options)
    for i, low in enumerate(range(0, 40, 7)):
        online.process(observations(spark, [r for r in rows if low <= (r[1] - START) / dt.timedelta(hours=1) < low + 7]), i)
        if i % 2:  # a batch that runs again
            online.process(observations(spark, [r for r in rows if low <= (r[1] - START) / dt.timedelta(hours=1) < low + 7]), i)
    same_rows(online.windows(spark).drop("batch_id"), trailing_windows(observations(spark, rows), 6, FEATURE, pool=("mean", "min", "max", "last")))


def test_labelled_trailing_windows_are_the_labelled_windows(spark):
    from conftest import images_for
    from vaneworks.operators.windows import labelled_windows, mark_images

    rows = observation_rows({1: 40, 2: 17, 3: 5})
    obs = observations(spark, rows)
    pics = images_for(spark, rows, lambda i: i % 13 == 0).selectExpr("series_id", "timestamp", "pixels as cells")
    want = labelled_windows(obs, pics, 5, FEATURE, pool=("mean", "last"), cells=4)
    flagged = mark_images(obs, pics).join(pics, ["series_id", "timestamp"], "left")
    got = trailing_windows(flagged, 5, FEATURE, pool=("mean", "last"), images="has_image", cells=4, label="storm_event")
    same_rows(got, want)
    assert want.count() > 5


def test_held_rows_are_limited_before_the_shuffle(spark):
    kept = last_rows(observations(spark, observation_rows({1: 50, 2: 3})), 4)
    assert sorted(r["event_id"] for r in kept.collect()) == [46, 47, 48, 49, 50, 51, 52]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_request_stream_equals_batch_and_resumes(spark, tmp_path):
    scaler = scaling.fit_scaler(fixtures.observations(spark, SF))
    weights = {**WEIGHTS, "last_humidity": 0.2}
    requests = fixtures.requests(spark, SF)
    source, out, checkpoint = (str(tmp_path / n) for n in ("source", "out", "checkpoint"))
    for part in ("request_id % 2 = 0", "request_id % 2 = 1"):
        requests.where(part).write.mode("append").parquet(source)
        stream = scoring.read_requests(spark, "parquet", source, maxFilesPerTrigger="1")
        scoring.run_scoring(stream, out, checkpoint, scaler, weights).awaitTermination()
    want = scoring.score_snapshots(requests, scaler, weights)
    same_rows(spark.read.parquet(out), want)
    assert want.where("reject_reason is null and (p is null or response is null)").count() == 0
    assert want.where("reject_reason is not null and (p is not null or response is not null)").count() == 0
    scoring.run_scoring(
        scoring.read_requests(spark, "parquet", source), out, checkpoint, scaler, weights
    ).awaitTermination()
    assert spark.read.parquet(out).count() == requests.count()


def test_sequence_requests_are_scored_in_their_row(spark):
    import json
    import math

    step = lambda v: [float(v)] * 8
    good = json.dumps({"image": [[[[1.0]]], [[[1.0]]]], "sequence": [[step(1), step(3)], [step(5), step(2)]]})
    rows = [(1, "application/json", good), (2, "application/json", "{"), (3, "text/csv", good)]
    df = spark.createDataFrame(rows, "request_id bigint, content_type string, body string")
    weights = {"intercept": 0.5, "mean_temperature": -0.25, "max_humidity": 0.1, "last_pressure": 0.2, "min_visibility": 0.3}
    got = {r["request_id"]: r for r in scoring.score_sequences(df, weights).collect()}
    p = [1 / (1 + math.exp(-m)) for m in (0.5 - 0.5 + 0.3 + 0.6 + 0.3, 0.5 - 0.875 + 0.5 + 0.4 + 0.6)]
    answer = json.loads(got[1]["response"])
    assert [x[0] for x in answer["prediction"]] == pytest.approx(p) and answer["probability"] == pytest.approx(p[0])
    assert got[1]["decision"] is True and got[2]["p"] is None and got[3]["response"] is None
    plan = scoring.score_sequences(df, weights)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_raw_weights_score_like_scaled_features(spark):
    obs = fixtures.observations(spark, SF)
    scaler = scaling.fit_scaler(obs)
    weights = {"intercept": 0.1, "mean_temperature": 0.5, "last_humidity": -0.3}
    names = {"mean_temperature": "temperature", "last_humidity": "humidity"}
    pooled = lambda df: df.withColumns({k: F.col(v) for k, v in names.items()})
    a = models.score_linear(pooled(scaling.apply_scaler(obs, scaler)), weights).select("event_id", "p")
    b = models.score_linear(pooled(obs), scoring.raw_weights(weights, scaler)).select("event_id", "p")
    same_rows(a, b)


@pytest.mark.parametrize("family", ["logistic", "trees"])
def test_a_stored_model_with_images_scores_requests(spark, tmp_path, family):
    import json
    import random

    from vaneworks.operators import models, scaling
    from vaneworks.schema import FEATURES, PipelineConfig
    from vaneworks.sources import state
    from vaneworks.streaming import scoring

    rng = random.Random(2)
    rows = []
    for i in range(60):
        image = [[[rng.random() + (2.0 if (r < 2) == (i % 2 == 0) else 0.0) for _ in range(4)] for r in range(4)]]
        weather = {name: rng.random() for name in FEATURES}
        rows.append((i, "application/json", json.dumps({"satellite_image": image, "weather_data": weather})))
    rows.append((90, "application/json", json.dumps({"satellite_image": [[[1.0]]], "weather_data": dict.fromkeys(FEATURES, 1.0)})))
    requests = spark.createDataFrame(rows, scoring.REQUEST_SCHEMA)
    parsed = scoring.decode_snapshots(requests)
    scaler = scaling.fit_scaler(parsed.where("request_id < 60")).cache()
    train = scoring.image_features(scoring.snapshot_features(scaling.apply_scaler(parsed, scaler), 3), "image", (1, 4, 4), 2)
    train = train.where("request_id < 60").withColumn("label", (F.col("request_id") % 2).cast("int")).cache()
    names = [f"mean_{name}" for name in FEATURES] + [f"mean_cell_{i}" for i in range(4)]
    fitted = models.fit_logistic(train, names, weight_decay=1e-2) if family == "logistic" else models.fit_boosted_trees(train, names, max_iter=3)
    state.save_model(fitted, PipelineConfig(), str(tmp_path / "m"))
    loaded, _ = state.load_model(spark, str(tmp_path / "m"))
    want = {r.request_id: r.p for r in models.score(train, fitted).collect()}

    requests.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = scoring.read_requests(spark, "parquet", str(tmp_path / "in"))
    scoring.run_scoring(stream, str(tmp_path / "out"), str(tmp_path / "c"), scaler, loaded, length=3, image_shape=(1, 4, 4), grid=2).awaitTermination()
    got = {r.request_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[90].reject_reason == "wrong_image_size" and got[90].response is None
    assert all(abs(got[i].p - want[i]) < 1e-9 and got[i].decision == (i % 2 == 1) for i in range(60))
    with pytest.raises(ValueError, match="image_shape"):
        scoring.score_with_model(requests, scaler, loaded)


def test_untouched_series_pass_through_and_null_series_counts(spark, tmp_path):
    from vaneworks.streaming.windows import WindowStream

    rows = observations(spark, observation_rows({1: 9, 2: 9})).withColumn("series_id", F.when(F.col("series_id") == 1, 1).cast("bigint"))
    online = WindowStream(str(tmp_path / "s"), rows.schema, 3, ("temperature",))
    for i, part in enumerate((rows.where("hour(timestamp) < 5"), rows.where("series_id = 1 and hour(timestamp) >= 5"), rows.where("series_id is null and hour(timestamp) >= 5"))):
        online.process(part, i)
    got = spark.read.parquet(f"{tmp_path}/s/windows").groupBy("series_id").count().collect()
    assert {r.series_id: r["count"] for r in got} == {1: 7, None: 7}
    assert spark.read.parquet(f"{tmp_path}/s/late").count() == 0


@pytest.mark.parametrize("family", ["logistic", "trees"])
def test_a_compiled_model_scores_like_the_model(spark, family):
    import random

    rng = random.Random(4)
    rows = [(i, *[round(rng.random(), 1) for _ in range(3)], i % 3 == 0) for i in range(400)]
    rows += [(900, None, 0.1, 0.2, True), (901, float("nan"), 0.1, 0.2, True), (902, float("inf"), -1.0, 0.0, False)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, y boolean").withColumn("label", ((F.col("a") + F.col("b") > 1.0) != F.col("y")).cast("int"))
    train = df.where("id < 900")
    fit = models.fit_logistic if family == "logistic" else models.fit_boosted_trees
    fitted = fit(train, ["a", "b", "c"], max_iter=12)
    got = {r.id: (r.p, r.decision) for r in models.score_compiled(df, fitted, 0.5).collect()}
    for r in models.score(df, fitted, 0.5).collect():
        p, decision = got[r.id]
        assert decision == r.decision and (p == r.p or abs(p - r.p) < 1e-12), r
    assert got[900][0] is None and got[901][0] is None and got[902][0] is not None


def test_sequence_requests_with_images_and_a_model(spark):
    import json
    import random

    from vaneworks.functions.pixels import cell_means, standardise_image
    from vaneworks.schema import FEATURES

    rng = random.Random(6)
    image = lambda: [[[round(rng.random(), 3) for _ in range(4)] for _ in range(4)]]
    step = lambda: [round(rng.random(), 3) for _ in FEATURES]
    rows = [(i, [image(), image()], [[step(), step()], [step(), step()]]) for i in range(40)]
    names = ["mean_humidity", "min_pressure", "max_visibility", "last_temperature", "mean_cell_0", "mean_cell_3"]
    scaler = spark.createDataFrame([(f, 0.5, 2.0, 1) for f in FEATURES], "feature string, mean double, scale double, n long")
    flat = [(i, k, [x for c in im[k] for r in c for x in r], *[(v - 0.5) / 2 for v in (sum(s[1] for s in q[k]) / 2, min(s[2] for s in q[k]), max(s[7] for s in q[k]), q[k][-1][0])]) for i, im, q in rows for k in (0, 1)]
    train = spark.createDataFrame(flat, "id int, k int, pixels array<float>, " + ", ".join(f"{n} double" for n in names[:4]))
    train = train.withColumn("_c", cell_means(1, 4, 4, 2)(standardise_image("pixels")))
    train = train.withColumns({"mean_cell_0": F.get("_c", F.lit(0)), "mean_cell_3": F.get("_c", F.lit(3)), "label": F.col("id") % 2}).cache()
    for fitted in (models.fit_logistic(train, names), models.fit_boosted_trees(train, names, max_iter=4)):
        want = {(r.id, r.k): r.p for r in models.score(train, fitted).collect()}
        bodies = [(i, "application/json", json.dumps({"image": im, "sequence": q})) for i, im, q in rows]
        good = rows[0]
        bodies += [
            (100, "application/json", json.dumps({"image": good[1][:1], "sequence": good[2]})),
            (101, "application/json", json.dumps({"image": [good[1][0], [[[1.0]]]], "sequence": good[2]})),
            (102, "application/json", json.dumps({"image": [good[1][0], [[[1.0] * 4] * 4]], "sequence": good[2]})),
            (103, "text/csv", json.dumps({"image": good[1], "sequence": good[2]})),
            (104, "application/json", json.dumps({"image": good[1], "sequence": [[[1.0]], [[1.0]]]})),
        ]
        requests = spark.createDataFrame(bodies, scoring.REQUEST_SCHEMA)
        got = {r.request_id: r for r in scoring.score_sequences_with_model(requests, scaler, fitted, 2, image_shape=(1, 4, 4), grid=2).collect()}
        for i in range(40):
            answer = json.loads(got[i].response)["prediction"]
            assert [x[0] for x in answer] == pytest.approx([want[i, 0], want[i, 1]], abs=1e-9) and got[i].p == pytest.approx(want[i, 0], abs=1e-9)
        assert [got[i].reject_reason for i in range(100, 105)] == ["wrong_image_count", "wrong_image_size", "wrong_image_size", "unsupported_content_type", "wrong_width"]
        assert all(got[i].response is None and got[i].p is None for i in range(100, 105))
        with pytest.raises(ValueError, match="image_shape"):
            scoring.score_sequences_with_model(requests, scaler, fitted)
    with pytest.raises(ValueError, match="mean_cell_0"):
        scoring.sequence_scores(F.col("x"), {"mean_cell_0": 1.0})


def test_images_settle_before_with_and_after_their_rows(spark, tmp_path):
    from conftest import images_for
    from pyspark.sql import types as T
    from vaneworks.operators.windows import labelled_windows
    from vaneworks.streaming.images import settle_images

    rows = observation_rows({1: 40, 2: 17, 3: 30})
    rows.append((*rows[5][:2], 500, *rows[5][3:]))  # two rows of one series and time
    obs = observations(spark, rows)
    pics = images_for(spark, rows, lambda i: i % 13 == 0).withColumnRenamed("pixels", "cells").dropDuplicates(["series_id", "timestamp"])
    twice = pics.where("path = 'a/9'").selectExpr("series_id", "timestamp", "'A/lower' as path", "array(9f, 9f, 9f, 9f) as cells")
    want = labelled_windows(obs, pics, 5, FEATURE, pool=("mean", "last"), cells=4)
    pics = pics.unionByName(twice)
    schema = T.StructType([*obs.schema.fields, T.StructField("has_image", T.BooleanType()), T.StructField("cells", T.ArrayType(T.FloatType()))])
    online = WindowStream(str(tmp_path / "o"), schema, 5, FEATURE, pool=("mean", "last"), images="has_image", cells=4, label="storm_event")
    slot = F.floor((F.unix_seconds(F.col("timestamp").cast("timestamp")) - F.unix_seconds(F.lit(START).cast("timestamp"))) / 36_000).cast("int")
    shift = F.pmod(F.xxhash64("path"), F.lit(3)).cast("int") - 1
    pics = pics.withColumn("_slot", F.greatest(F.lit(0), slot + shift))
    sources = str(tmp_path / "rows"), str(tmp_path / "images")
    stale = spark.createDataFrame([(1, START, "zz", [0.0] * 4)], "series_id bigint, timestamp timestamp_ntz, path string, cells array<float>")
    far = START + dt.timedelta(days=400)
    dropped = 0
    for i in range(6):
        o, p = obs.where(slot == i), pics.where(F.col("_slot") == i).drop("_slot")
        if i == 5:  # an image of a settled time, and a row and an image that settle the rest
            o = o.unionByName(observations(spark, [(None, far, None, *[None] * 8, None)]))
            p = p.unionByName(stale).unionByName(stale.withColumns({"series_id": F.lit(None).cast("bigint"), "timestamp": F.lit(far).cast("timestamp_ntz")}))
        o.write.mode("append").parquet(sources[0])
        p.write.mode("append").parquet(sources[1])
        streams = [spark.readStream.schema(x.schema).parquet(y) for x, y in zip((o, p), sources)]
        run = online.start(settle_images(*streams, "11 hours", ("cells",)))
        run.awaitTermination()
        dropped += sum(s["numRowsDroppedByWatermark"] for x in run.recentProgress for s in x["stateOperators"])
    same_rows(online.windows(spark).drop("batch_id"), want)
    assert want.count() > 20 and dropped == 1 and online.late_rows(spark).count() == 0
    with pytest.raises(ValueError, match="has_image"):
        settle_images(obs.withColumn("has_image", F.lit(True)), pics, "1 hour")


def test_sequence_requests_are_dealt_over_files_by_their_number(spark, monkeypatch):
    from pathlib import Path
    from conftest import SF
    from vaneworks.operators import scale
    from vaneworks.plans import queries

    monkeypatch.setattr(queries, "REQUESTS_PER_FILE", 40, raising=False)
    known = set(scale._SCRATCH)
    got = queries.QUERIES["h1_model_sequences"](spark, SF).collect()
    made = {p: Path(p.removeprefix("file:")) for p in scale._SCRATCH if p not in known}
    (source,) = [path for path in made.values() if path.name.startswith("sequence-requests")]
    sizes = [spark.read.parquet(str(f)).count() for f in source.glob("part-*.parquet")]
    assert len(got) == 2 * sum(sizes) and all(r["same"] and r["decided"] for r in got)
    assert len(sizes) > 4 and max(sizes) < 80
    runs = [path for path in made.values() if path.name.startswith("sequence-checkpoint")]
    assert [sorted(f.name for f in (path / "commits").iterdir() if f.name.isdigit()) for path in runs] == [["0", "1"]] * 2


def test_a_batch_joins_its_rows_once_and_an_empty_one_runs_on_nothing(spark, tmp_path, monkeypatch):
    from vaneworks.streaming import windows as module

    seen, build = [], module.trailing_windows

    def watched(rows, *args, **kwargs):
        seen.append((rows.storageLevel.useMemory, "LocalTableScan <empty>" in rows._jdf.queryExecution().executedPlan().toString()))
        return build(rows, *args, **kwargs)

    monkeypatch.setattr(module, "trailing_windows", watched)
    obs = observations(spark, observation_rows({1: 30, 2: 9, None: 12}))
    online = WindowStream(str(tmp_path / "o"), obs.schema, 5, FEATURE)
    cached = len(spark.sparkContext._jsc.getPersistentRDDs())
    late = obs.where("event_id = 3")
    slices = [obs.where("event_id % 30 < 8"), obs.where("false"), obs.where("event_id % 30 >= 8").unionByName(late)]
    for i, batch in enumerate(slices):
        online.process(batch, i)
    assert [kept for kept, _ in seen] == [True, False, True] and seen[1][1]
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == cached
    want = trailing_windows(obs, 5, FEATURE)
    same_rows(online.windows(spark).drop("batch_id"), want)
    assert [r["event_id"] for r in online.late_rows(spark).collect()] == [3] and want.count() > 30


def test_time_slices_ask_the_files_for_their_bounds(spark):
    from vaneworks.plans.fixtures import time_slices

    rows = [(1, START + dt.timedelta(hours=i // 2), i) for i in range(40)] + [(1, None, 40)]
    df = spark.createDataFrame(rows, "series_id long, timestamp timestamp_ntz, event_id long")
    got = time_slices(df, "timestamp", 4, "slices-test")
    assert [sorted(r["event_id"] for r in part.collect()) for part in got] == [[*range(10), 40], [*range(10, 20)], [*range(20, 30)], [*range(30, 40)]]
    plans = [part._jdf.queryExecution().executedPlan().toString() for part in got]
    assert all("LessThanOrEqual(_at" in plan for plan in plans[:3]) and all("GreaterThan(_at" in plan for plan in plans[1:])


def test_tables_of_sequence_requests_carry_what_is_read_of_them_and_go(spark, monkeypatch):
    from pathlib import Path
    from conftest import SF
    from vaneworks.operators import scale
    from vaneworks.plans import queries

    sent, repartition = [], type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda df, *args: sent.append(df.columns) or repartition(df, *args))
    known = set(scale._SCRATCH)
    got = queries.QUERIES["h1_model_sequences"](spark, SF)
    made = [Path(p.removeprefix("file:")) for p in scale._SCRATCH if p not in known]
    assert not [columns for columns in sent if "body" in columns]
    assert not [path for path in made if path.name.startswith("sequence-windows")]
    (scaled,) = [path for path in made if path.name.startswith("scaled-windows")]
    assert not {"seq", "pixels"} & set(spark.read.parquet(str(scaled)).columns)
    assert got.count() > 100 and got.where("same = 0 or decided = 0").count() == 0


def test_release_table_deletes_that_table_only(spark):
    from vaneworks.operators import scale

    one, other = (scale.materialise(spark.range(5), name, "zstd") for name in ("released", "staying"))
    known = list(scale._SCRATCH)
    scale.release_table(one)
    assert set(known) - set(scale._SCRATCH) == {p for p in known if "/released-" in p}
    assert other.count() == 5
    with pytest.raises(Exception, match="(?i)not.exist|not found|FileNotFound|no such"):
        one.collect()
