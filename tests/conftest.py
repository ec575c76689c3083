import datetime as dt
import math
import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from vaneworks.schema import FEATURES, OBSERVATION_SCHEMA  # noqa: E402
from vaneworks.session import get_session  # noqa: E402

SF = "/root/testdata/sf0.001"
START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def observation_rows(sizes, seed=7, labels=None):
    """Hourly rows per series; values repeat so that ties occur."""
    rng = random.Random(seed)
    rows, event = [], 0
    for series, n in sizes.items():
        for i in range(n):
            values = [float(rng.randint(0, 9)) for _ in FEATURES]
            label = labels[i] if labels else rng.randint(0, 1)
            rows.append((series, START + dt.timedelta(hours=i), event, *values, label))
            event += 1
    return rows


def observations(spark, rows):
    return spark.createDataFrame(rows, OBSERVATION_SCHEMA)


def images_for(spark, rows, skip=lambda i: False):
    kept = [(r[0], r[1], f"a/{r[2]}", [float(r[2]), 1.0, 2.0, 4.0]) for i, r in enumerate(rows) if not skip(i)]
    return spark.createDataFrame(kept, "series_id bigint, timestamp timestamp_ntz, path string, pixels array<float>")


def close(a, b, tolerance=1e-9):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=tolerance, abs_tol=tolerance) or (math.isnan(a) and math.isnan(b))
    return a == b


def same_rows(left, right, tolerance=1e-9):
    """Two DataFrames hold the same rows, doubles compared with a tolerance."""
    columns = sorted(left.columns)
    assert columns == sorted(right.columns)
    a = sorted((tuple(r) for r in left.select(*columns).collect()), key=repr)
    b = sorted((tuple(r) for r in right.select(*columns).collect()), key=repr)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(close(p, q, tolerance) for p, q in zip(x, y)), (x, y)
