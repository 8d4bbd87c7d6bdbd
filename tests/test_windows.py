"""Window positions, labels and samples against sequential code."""

import numpy as np
from pyspark.sql import functions as F

from helpers import ANNOTATIONS, chunk_rows, joined, random_signals
from tracewright.functions import text as T
from tracewright.operators import ordered as O, windows as W

SEGMENTS = "recording_id bigint, segment_id bigint, seg_start double, seg_stop double, seg_type string"


def test_sliding_counts_and_onsets(spark):
    segs = [(0, 0, 1.0, 1.99, "PD"), (0, 1, 2.0, 3.0, "PD"), (0, 2, 4.0, 5.3, "PD"), (0, 3, 6.0, 7.5, "PD")]
    df = W.sliding_windows(spark.createDataFrame(segs, SEGMENTS), 80.0)
    got = {}
    for r in df.collect():
        got.setdefault(r.segment_id, []).append((r.s, r.onset_sec))
    assert 0 not in got
    for seg, start, stop in ((1, 2.0, 3.0), (2, 4.0, 5.3), (3, 6.0, 7.5)):
        n = int(round((stop - start) * 80))
        want = [(s, start + s / 80) for s in range(0, n - 80 + 1, 20)]
        assert sorted(got[seg]) == want and len(want) == (n - 80) // 20 + 1


def test_labels_match_scan(spark):
    rng = np.random.default_rng(3)
    for window in (1.0, 0.3, 7.0):
        marks = [(r, round(float(t), 2)) for r in range(3) for t in rng.uniform(0, 60, 25)]
        onsets = [(r, 0, i, round(float(t), 2)) for r in range(4) for i, t in enumerate(rng.uniform(0, 60, 200))]
        onsets += [(r, 1, i, t) for i, (r, t) in enumerate(marks)] + [(r, 2, i, t - window) for i, (r, t) in enumerate(marks)]
        w = spark.createDataFrame(onsets, "recording_id bigint, segment_id bigint, s bigint, onset_sec double")
        m = spark.createDataFrame(marks + marks, "recording_id bigint, mark_sec double")
        got = {(r.recording_id, r.segment_id, r.s): r.label for r in W.label_windows(w, m, window).collect()}
        assert len(got) == len(onsets)
        for r, k, i, t in onsets:
            assert got[r, k, i] == int(any(q == r and t <= x <= t + window for q, x in marks)), (window, t)


def test_labels_without_marks_and_with_window_column(spark):
    w = spark.createDataFrame([(0, 0, 0, 5.0, 2.0), (1, 0, 0, 5.0, 0.5)],
                              "recording_id bigint, segment_id bigint, s bigint, onset_sec double, window_sec double")
    none = spark.createDataFrame([], "recording_id bigint, mark_sec double")
    assert [r.label for r in W.label_windows(w, none).collect()] == [0, 0]
    m = spark.createDataFrame([(0, 6.5), (1, 6.5)], "recording_id bigint, mark_sec double")
    assert {r.recording_id: r.label for r in W.label_windows(w, m, "window_sec").collect()} == {0: 1, 1: 0}


def test_annotation_windows_edges(spark):
    rate, n = 80.0, 800
    times = [0.5, 0.49, 9.5, 9.51, 3.00625, 3.01875, 4.0, 5.0, 6.0]
    texts = ["*", "*", "-", "-", "*", "-", " *", "Note : *", "other"]
    a = spark.createDataFrame([(0, i, t, d) for i, (t, d) in enumerate(zip(times, texts))], ANNOTATIONS)
    recs = spark.createDataFrame([(0, rate, n)], "recording_id bigint, sfreq double, n_samples bigint")
    got = W.annotation_windows(a, recs).orderBy("row_idx").collect()
    want = []
    for i, (t, d) in enumerate(zip(times, texts)):
        c = int(np.round(t * rate))
        if d in ("*", "-") and c - 40 >= 0 and c + 40 <= n:
            want.append((i, c - 40, c + 40, int(d == "*")))
    assert [(r.ord, r.start, r.stop, r.label) for r in got] == want
    assert [r.row_idx for r in got] == list(range(len(want)))


def test_time_texts(spark):
    df = spark.createDataFrame([(1.9996,), (90061.5,), (0.0005,), (0.0015,)], "t double")
    got = df.select(T.time_text(F.col("t")).alias("a"), T.time_text_truncated(F.col("t")).alias("b")).collect()
    assert [r.a for r in got] == ["00:00:02.000", "25:01:01.500", "00:00:00.000", "00:00:00.002"]
    assert [r.b for r in got][:3] == ["00:00:01.999", "25:01:01.500", "00:00:00.000"]


def test_cut_spans_and_chunks(spark):
    signals = random_signals(1, 2, 2, 137)
    chunks = chunk_rows(spark, signals, 16)
    spans = [(r, i, a, b) for r in range(2) for i, (a, b) in enumerate([(0, 137), (5, 6), (15, 17), (16, 32), (40, 133)])]
    df = spark.createDataFrame(spans, "recording_id bigint, k bigint, start bigint, stop bigint")
    for out_len in (None, 10):
        cut = W.cut_spans(chunks, df, 16, ["k"], out_len)
        got = joined(cut if out_len else cut.withColumn("chunk", F.lit(0)), ("recording_id", "channel", "k"))
        for r, i, a, b in spans:
            for c in ("C0", "C1"):
                assert np.array_equal(got[r, c, i], signals[r, c][a:b])
    again = joined(W.to_chunks(W.from_chunks(chunks, 16), 16))
    assert all(np.array_equal(again[k], signals[k]) for k in signals)


def test_slide_chunks(spark):
    for n, length, stride in ((137, 40, 7), (64, 16, 16), (50, 50, 3), (30, 40, 5)):
        signals = random_signals(2, 1, 2, n)
        got = W.slide_chunks(chunk_rows(spark, signals, 16), 16, length, stride).collect()
        assert sorted((r.channel, r.s) for r in got) == [(c, s) for c in ("C0", "C1") for s in range(0, n - length + 1, stride)]
        assert all(np.array_equal(r.x, signals[0, r.channel][r.s:r.s + length]) for r in got)


def test_positions_and_quantiles(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), float(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 500), rng.integers(0, 40, 500)))]
    df = spark.createDataFrame(rows, "k bigint, t double, i bigint").withColumn("b", O.time_bucket(F.col("t"), 4.0))
    got = {r.i: r.pos for r in O.add_position(df, ["k"], ["t", "i"], "b", "pos").collect()}
    for k in range(3):
        order = sorted((t, i) for q, t, i in rows if q == k)
        assert [got[i] for _, i in order] == list(range(len(order)))
    for method in ("hazen", "linear"):
        q = O.exact_quantiles(df, ["k"], "t", {"a": 0.25, "b": 0.5, "c": 0.999, "d": 0.0}, method).collect()
        for r in q:
            x = [t for k, t, _ in rows if k == r.k]
            assert np.allclose([r.a, r.b, r.c, r.d], np.quantile(x, [0.25, 0.5, 0.999, 0.0], method=method))
