"""Stored windows, fresh marks, replaced labels."""

import numpy as np
from pyspark.sql import functions as F

from helpers import ANNOTATIONS, chunk_rows, random_signals
from tracewright.operators import windows as W
from tracewright.plans import relabel as R
from tracewright.plans.tables import materialize
from tracewright.sources.tables import read_dataset

MARKS = {0: [0.4, 1.5], 1: [2.0], 2: [0.1]}


def notes(spark, marks):
    return spark.createDataFrame([(r, i, t, "*") for r, ts in marks.items() for i, t in enumerate(ts)], ANNOTATIONS)


def test_relabel_stored_windows(spark, tmp_path):
    x = random_signals(3, 3, 2, 80)
    windows = W.slide_chunks(chunk_rows(spark, x, 16), 16, 20, 10).withColumn("onset_sec", F.col("s") / 20.0)
    path, out = str(tmp_path / "windows"), str(tmp_path / "rows")
    R.store_windows(windows, notes(spark, MARKS), path)
    stored = read_dataset(spark, path)
    fresh = {0: [1.5], 1: [2.0, 3.2], 2: [0.1]}
    recordings = spark.createDataFrame([(0,), (1,), (7,), (7,)], "recording_id bigint")
    made = R.relabel(stored, notes(spark, fresh), recordings)
    got = {(r.recording_id, r.channel, r.s): (r.label, r.x) for r in made.windows.collect()}
    want = {(r, c, s): int(any(s / 20 <= t <= s / 20 + 1 for t in fresh[r])) for r in (0, 1) for c in ("C0", "C1") for s in range(0, 61, 10)}
    assert {k: v[0] for k, v in got.items()} == want and 0 < sum(want.values()) < len(want)
    assert all(np.array_equal(v[1], x[r, c][s:s + 20]) for (r, c, s), v in got.items())
    assert {(r.recording_id, r.n_read, r.n_stored) for r in made.changed.collect()} == {(0, 1, 2), (1, 2, 1)}
    assert {(r.item, r.reason) for r in made.rejected.collect()} == {("7", "no windows"), ("2", "recording not found")}

    rows, failed = R.relabelled_features(made, 20.0, ["recording_id", "s"])
    assert failed.count() == 0 and rows.count() == len(want)
    R.replace_partitions(materialize(rows, "rows"), out)
    one = materialize(rows.filter("recording_id = 1").withColumn("label", F.lit(5)), "rows")
    R.replace_partitions(one, out)                       # the other recording stays
    back = {r.recording_id: (r.n, r.total) for r in read_dataset(spark, out).groupBy("recording_id").agg(
        F.count("rms").alias("n"), F.sum("label").alias("total")).collect()}
    assert back == {0: (14, sum(v for k, v in want.items() if k[0] == 0)), 1: (14, 70)}


def test_relabel_empty_tables(spark, tmp_path):
    windows = W.slide_chunks(chunk_rows(spark, random_signals(3, 1, 1, 40), 16), 16, 20, 10).withColumn("onset_sec", F.col("s") / 20.0)
    R.store_windows(windows, notes(spark, MARKS).limit(0), str(tmp_path / "w"))
    stored = read_dataset(spark, str(tmp_path / "w"))
    everyone = spark.createDataFrame([(0,)], "recording_id bigint")
    made = R.relabel(stored, notes(spark, MARKS).limit(0), everyone)
    assert {r.label for r in made.windows.collect()} == {0} and made.changed.count() == 0 and made.rejected.count() == 0
    made = R.relabel(stored, notes(spark, MARKS), everyone.limit(0))
    assert made.windows.count() == 0 and [r.reason for r in made.rejected.collect()] == ["recording not found"]
