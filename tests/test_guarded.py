"""One item that raises is listed, the others stay."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.functions import arrow
from tracewright.functions.guarded import attempt, value_or_error
from tracewright.operators import cleaning as G, features as X


@pytest.mark.parametrize("bad", [[], [0], [6], [2, 3], list(range(7))])
def test_batches_are_halved(bad):
    calls = []

    def work(x):
        calls.append(len(x))
        if set(x.to_pylist()) & set(bad):
            raise ValueError("bad row")
        return pa.array([2.0 * v for v in x.to_pylist()])

    rows = value_or_error(work, [pa.array(range(7))], pa.float64()).to_pylist()
    assert rows == [{"value": None, "error": "ValueError: bad row"} if i in bad else {"value": 2.0 * i, "error": None} for i in range(7)]
    assert len(calls) == 1 if not bad else len(calls) <= 2 * 7
    assert attempt(lambda x: x, [pa.array([], pa.int64())], pa.int64())[0][1] is None


def framed(spark):
    rng = np.random.default_rng(2)
    rows = []
    for rec in range(4):
        for s in range(3):
            x = rng.normal(size=(3, 20))
            x[2] = x[0] + 0.01 * x[2]
            data = [list(map(float, c)) for c in x]
            if (rec, s) == (1, 2):
                data[1] = data[1][:7]                       # a frame that cannot be a matrix
            rows.append((rec, s, ["A", "B", "C"], data))
    return spark.createDataFrame(rows, "recording_id bigint, s bigint, channels array<string>, data array<array<double>>").coalesce(1)


def test_failing_detector_gives_no_channels_and_a_warning(spark):
    score = arrow.frame_best_correlation(F.col("data"), 0.98)
    shares = G._low_share(G._per_channel(framed(spark), score, ["recording_id"]), 0.6, ["recording_id"])
    assert sorted((r.recording_id, r.channel) for r in G.low_channels(shares, 0.5).collect()) == [(0, "B"), (2, "B"), (3, "B")]
    (w,) = G.detector_failures(shares, "correlation").collect()
    assert (w.recording_id, w.detector) == (1, "correlation") and w.reason.startswith("ValueError")


def test_windows_that_raise_are_listed(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "A", list(map(float, rng.normal(size=80))), 80.0 if i != 5 else -1.0) for i in range(9)]
    df = spark.createDataFrame(rows, "i int, channel string, x array<double>, fs double")
    good, failed = X.features_and_failures(df, F.col("fs"), ["i"])
    want = {r.i: r.rms for r in X.window_features(df.filter("i <> 5").select("i", "channel", "x"), 80.0).collect()}
    got = {r.i: r.rms for r in good.collect()}
    assert {i: got[i] for i in want} == want
    assert set(got) | {r.i for r in failed.collect()} == set(range(9))
