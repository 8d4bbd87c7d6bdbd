"""Signal cleaning against numpy on whole signals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import chunk_rows, joined, random_signals
from tracewright.operators import channels as CH, cleaning as G


def extended(x, k, edge):
    out = []
    for i in range(-k, len(x) + k):
        if 0 <= i < len(x):
            out.append(x[i])
        elif edge == "zero":
            out.append(0.0)
        else:
            j = -i if i < 0 else 2 * (len(x) - 1) - i
            pivot = x[0] if i < 0 else x[-1]
            out.append(2 * pivot - x[j] if 0 <= j < len(x) else 0.0)
    return np.array(out)


@pytest.mark.parametrize("edge", ["reflect", "zero"])
def test_fir_across_chunks(spark, edge):
    rng = np.random.default_rng(4)
    for n, taps_n, chunk in ((100, 11, 16), (100, 61, 16), (40, 101, 16), (33, 5, 64)):
        taps = rng.normal(size=taps_n)
        signals = random_signals(n, 2, 2, n)
        got = joined(G.fir_filter(chunk_rows(spark, signals, chunk), chunk, taps, edge))
        for k, x in signals.items():
            assert np.allclose(got[k], np.convolve(extended(x, taps_n // 2, edge), taps, "valid"))


def test_resample_is_filter_on_the_fine_grid(spark):
    rng = np.random.default_rng(5)
    for up, down in ((5, 16), (2, 1), (1, 2), (3, 4)):
        taps = rng.normal(size=41)
        signals = random_signals(6, 1, 2, 85)
        chunks = chunk_rows(spark, signals, 16)
        got = joined(G.resample(chunks, 16, up, down, taps, "zero"))
        for k, x in signals.items():
            fine = np.zeros(len(x) * up)
            fine[::up] = x
            want = np.convolve(fine, taps)[20:20 + len(fine)][::down]
            assert np.allclose(got[k], want), (up, down)


def test_resample_keeps_a_slow_wave(spark):
    t = np.arange(256 * 8) / 256
    signals = {(0, "C0"): np.sin(2 * np.pi * 5 * t)}
    y = joined(G.resample(chunk_rows(spark, signals, 256), 256, 5, 16))[0, "C0"]
    want = np.sin(2 * np.pi * 5 * np.arange(len(y)) / 80)
    assert len(y) == 640 and np.abs(y - want)[80:-80].max() < 0.01
    with pytest.raises(ValueError):
        G.resample(chunk_rows(spark, signals, 256), 100, 5, 16)


def test_reference_and_interpolation(spark):
    signals = random_signals(7, 2, 4, 50)
    chunks = chunk_rows(spark, signals, 16)
    bad = spark.createDataFrame([(0, "C1"), (0, "C3"), (1, "C0")], "recording_id bigint, channel string")
    weights = spark.createDataFrame(
        [("C1,C3", "C1", "C0", 0.7), ("C1,C3", "C1", "C2", -0.2), ("C1,C3", "C3", "C2", 1.0), ("C0", "C0", "C1", 0.5),
         ("C0", "C0", "C2", 0.25), ("C9", "C9", "C1", 1.0)], "bad_set string, bad_channel string, src_channel string, w double")
    fixed = G.interpolate(chunks, bad, weights)
    got = joined(fixed)
    assert np.allclose(got[0, "C1"], 0.7 * signals[0, "C0"] - 0.2 * signals[0, "C2"])
    assert np.allclose(got[0, "C3"], signals[0, "C2"])
    assert np.allclose(got[1, "C0"], 0.5 * signals[1, "C1"] + 0.25 * signals[1, "C2"])
    assert len(got) == 8 and np.array_equal(got[1, "C3"], signals[1, "C3"])
    ref = joined(G.average_reference(fixed))
    for r in range(2):
        total = sum(ref[r, f"C{c}"] for c in range(4))
        assert np.allclose(total, 0, atol=1e-12)
        assert np.allclose(ref[r, "C2"], got[r, "C2"] - sum(got[r, f"C{c}"] for c in range(4)) / 4)
    reasons = lambda rows, present=None: [(r.recording_id, r.reason) for r in G.without_weights(
        spark.createDataFrame(rows, bad.schema), weights, present=present).collect()]
    assert reasons([(0, "C2")]) == [(0, "no weights for C2")]
    half = weights.filter("bad_channel <> 'C3'")            # one of two bad channels has weights
    assert [r.reason for r in G.without_weights(bad.filter("recording_id = 0"), half).collect()] == ["no weights for C1,C3"]
    channels = chunks.select("recording_id", "channel").filter("channel <> 'C2' OR recording_id = 0").distinct()
    assert reasons([(0, "C1"), (0, "C3"), (1, "C0")], channels) == [(1, "no source C2")]


def hazen(v, q):
    return np.quantile(v, q, method="hazen")


def test_deviation(spark):
    signals = random_signals(8, 2, 6, 90)
    signals[1, "C4"] = signals[1, "C4"] * 40
    chunks = chunk_rows(spark, signals, 16)
    got = {(r.recording_id, r.channel): (r.spread, r.z) for r in G.channel_deviation(chunks).collect()}
    for r in range(2):
        s = {c: 0.7413 * (hazen(signals[r, c], 0.75) - hazen(signals[r, c], 0.25)) for c in (f"C{i}" for i in range(6))}
        v = np.array(list(s.values()))
        for c in s:
            z = (s[c] - hazen(v, 0.5)) / (0.7413 * (hazen(v, 0.75) - hazen(v, 0.25)))
            assert got[r, c] == (pytest.approx(s[c]), pytest.approx(z))
    assert abs(got[1, "C4"][1]) > 5
    assert ({(r.recording_id, r.channel) for r in G.bad_by_deviation(chunks).collect()}
            == {k for k, (_, z) in got.items() if abs(z) > 5})


def test_correlation_and_prediction(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=96)
    signals = {(0, f"C{c}"): base * (c + 1) + 0.1 * rng.normal(size=96) for c in range(5)}
    signals[0, "C2"] = rng.normal(size=96)
    chunks = chunk_rows(spark, signals, 16)
    share = {r.channel: r.low_share for r in G.correlation_share(chunks, 16, 24).collect()}
    for c in range(5):
        low = []
        for s in range(0, 96, 24):
            m = np.array([signals[0, f"C{k}"][s:s + 24] for k in range(5)])
            r = np.abs(np.corrcoef(m))
            np.fill_diagonal(r, 0)
            low.append(hazen(r[c], 0.98) < 0.4)
        assert share[f"C{c}"] == pytest.approx(np.mean(low))
    w = [(d, f"C{c}", f"C{k}", float(rng.normal())) for d in range(5) for c in range(5) for k in range(5) if c != k]
    weights = G.PredictionWeights.of(w)
    share = {r.channel: r.low_share for r in G.prediction_share(chunks, 16, 24, weights, limit=0.5).collect()}
    few = G.PredictionWeights.of(x for x in w if "C4" not in x[1:3])         # a channel without weights gets no score
    assert {r.channel: r.low_share for r in G.prediction_share(chunks, 16, 24, few, limit=0.5).collect()}["C4"] == 0.0
    at = {(d, c, k): v for d, c, k, v in w}
    for c in range(5):
        low = []
        for s in range(0, 96, 24):
            guesses = [sum(at[d, f"C{c}", f"C{k}"] * signals[0, f"C{k}"][s:s + 24] for k in range(5) if k != c) for d in range(5)]
            low.append(np.corrcoef(signals[0, f"C{c}"][s:s + 24], np.median(guesses, axis=0))[0, 1] < 0.5)
        assert share[f"C{c}"] == pytest.approx(np.mean(low))


def test_flat_channel_is_not_low_correlated(spark):
    signals = random_signals(3, 1, 3, 32)
    signals[0, "C1"] = np.zeros(32)
    got = {r.channel: r.low_share for r in G.correlation_share(chunk_rows(spark, signals, 16), 16, 16).collect()}
    assert got["C1"] == 0.0


def test_union_keeps_present_channels(spark):
    schema = "recording_id bigint, channel string"
    a, b, p = (spark.createDataFrame(v, schema) for v in ([(0, "A"), (0, "B")], [(0, "A"), (0, "X")], [(0, "A"), (0, "B"), (1, "A")]))
    got = G.bad_union(a, b, present=p).collect()
    assert sorted((r.recording_id, r.channel) for r in got) == [(0, "A"), (0, "B")]


def test_channel_sets_and_subsets(spark):
    rows = [(0, "EEG T3"), (0, "EEG Fp1 "), (0, "EKG"), (1, "A1"), (2, "O2"), (2, "EEG P8")]
    df = spark.createDataFrame(rows, "recording_id bigint, channel string")
    got = CH.resolve_channels(df).orderBy("recording_id", "ch_ord").collect()
    assert [(r.recording_id, r.channel) for r in got] == [(0, "Fp1"), (0, "T7"), (2, "P8"), (2, "O2")]
    assert [r.recording_id for r in CH.without_channels(df).collect()] == [1]
    twice = spark.createDataFrame([*rows, (0, "T7"), (2, "O2 "), (3, "X"), (3, "EEG X")], "recording_id bigint, channel string")
    assert sorted((r.recording_id, r.reason) for r in CH.duplicate_channels(twice).collect()) == [
        (0, "channel given twice: T7"), (2, "channel given twice: O2")]
    draws = CH.ransac_subsets(spark, draws=6).groupBy("sample_id").agg(F.count_distinct("src_channel").alias("n")).collect()
    assert len(draws) == 6 and {r.n for r in draws} == {5}


def test_deviation_of_values_that_are_close_together(spark):
    rng = np.random.default_rng(12)
    signals = {(0, f"C{c}"): 1e6 + rng.normal(size=500) * 1e-3 * (c + 1) for c in range(4)}
    signals[0, "C3"][::7] = np.nan
    signals[0, "C2"] = -np.round(signals[0, "C2"] - 1e6, 3)           # ties, both signs
    got = {r.channel: r.spread for r in G.channel_deviation(chunk_rows(spark, signals, 64)).collect()}
    for c in range(4):
        v = signals[0, f"C{c}"]
        v = v[~np.isnan(v)]
        assert got[f"C{c}"] == pytest.approx(0.7413 * (hazen(v, 0.75) - hazen(v, 0.25)), rel=1e-9), c


def test_buckets_grow_with_the_values():
    from tracewright.functions.kernels import value_buckets
    v = np.sort(np.concatenate([np.random.default_rng(1).normal(size=500) * 10.0 ** np.arange(-250, 250), [0.0, -0.0, np.inf, -np.inf]]))
    assert (np.diff(value_buckets(v)) >= 0).all()


def test_silent_channels_and_drop_outs(spark):
    signals = random_signals(4, 2, 5, 96)
    signals[0, "C1"] = np.full(96, 3.0)
    signals[0, "C2"][5] = np.nan
    signals[1, "C3"][90] = np.inf
    signals[1, "C4"][24:48] = 0.5
    chunks = chunk_rows(spark, signals, 16)
    got = {(r.recording_id, r.channel, r.reason) for r in G.silent_channels(chunks).collect()}
    assert got == {(0, "C1", "flat"), (0, "C2", "undefined"), (1, "C3", "undefined")}
    alive = chunks.filter("NOT (recording_id = 0 AND channel = 'C1')")
    assert [(r.recording_id, r.channel, r.flat_share) for r in G.drop_outs(alive, 16, 24).collect()] == [(1, "C4", 0.25)]


def test_repair_with_ragged_ends(spark):
    signals = random_signals(5, 1, 3, 40)
    signals[0, "C2"] = signals[0, "C2"][:25]
    chunks = chunk_rows(spark, signals, 16)
    bad = spark.createDataFrame([(0, "C0")], "recording_id bigint, channel string")
    weights = spark.createDataFrame([("C0", "C0", "C1", 0.5), ("C0", "C0", "C2", 2.0)],
                                    "bad_set string, bad_channel string, src_channel string, w double")
    got = joined(G.repair(chunks, bad, weights))
    a, b = signals[0, "C1"], signals[0, "C2"]
    fixed = 0.5 * a[:25] + 2.0 * b
    mean = np.concatenate([(fixed + a[:25] + b) / 3, a[25:]])
    assert np.allclose(got[0, "C0"], fixed - mean[:25]) and np.allclose(got[0, "C2"], b - mean[:25])
    assert np.allclose(got[0, "C1"], a - mean)
