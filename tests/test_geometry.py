"""Weights from positions against a dense solve, and the cleaning steps that use them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import chunk_rows, joined
from tracewright.functions.splines import spline_weights
from tracewright.operators import cleaning as G, geometry as GEO

AT = GEO.sphere_positions()


def legendre(n, x):
    """By the three-term recurrence."""
    before, now = 1.0, x
    for k in range(1, n):
        before, now = now, ((2 * k + 1) * x * now - k * before) / (k + 1)
    return now


def dense(sources, targets):
    """Coefficients of the spline of every unit signal, one by one, by Gauss elimination on the full system."""
    g = lambda a, b: sum((2 * n + 1) / (n * (n + 1)) ** 4 * legendre(n, float(np.dot(a, b))) for n in range(1, 51)) / (4 * np.pi)
    n = len(sources)
    m = np.array([[g(a, b) + (1e-5 if i == j else 0) for j, b in enumerate(sources)] + [1.0] for i, a in enumerate(sources)] + [[1.0] * n + [0.0]])
    out = np.zeros((len(targets), n))
    for k in range(n):
        c = np.linalg.solve(m, np.eye(n + 1)[k])
        out[:, k] = [c[n] + sum(c[j] * g(t, s) for j, s in enumerate(sources)) for t in targets]
    return out


def test_positions():
    assert len(AT) == 19 and all(abs(np.linalg.norm(p) - 1) < 1e-12 for p in AT.values())
    assert AT["T7"][0] < 0 < AT["T8"][0] and AT["Fp1"][1] > 0 > AT["O1"][1] and max(AT, key=lambda c: AT[c][2]) == "Cz"
    for left, right in (("Fp1", "Fp2"), ("F3", "F4"), ("P7", "P8"), ("C3", "C4")):
        assert np.allclose(np.array(AT[left]) * [-1, 1, 1], AT[right])


def test_weights_against_a_dense_solve():
    names = sorted(AT)
    for bad in (["Cz"], ["F3", "O1"], ["Fp1", "Fp2", "T7"]):
        src = np.array([AT[c] for c in names if c not in bad])
        dst = np.array([AT[c] for c in bad])
        w = spline_weights(src * 7.5, dst)                     # the length of a position does not matter
        assert np.allclose(w, dense(src, dst), atol=1e-9) and np.allclose(w.sum(axis=1), 1)
    smooth = lambda p: 2 + p[:, 0] - 0.5 * p[:, 2]             # a slow field is rebuilt closely
    src, dst = (np.array([AT[c] for c in names if (c == "C3") == one]) for one in (False, True))
    assert abs(spline_weights(src, dst) @ smooth(src) - smooth(dst))[0] < 0.05


def signals(seed, n, lacking=()):
    """Two slow sources seen by all channels, with a little noise; recording 1 lacks some channels."""
    rng = np.random.default_rng(seed)
    out = {}
    for r in range(2):
        a, b = rng.normal(size=(2, n))
        for c, p in AT.items():
            if r == 0 or c not in lacking:
                out[r, c] = (1 + p[0]) * a + (p[1] - p[2]) * b + 0.01 * rng.normal(size=n)
    return out


def test_repair_from_positions_per_set_of_channels(spark):
    x = signals(1, 50, lacking=("Pz", "Fz"))
    chunks = chunk_rows(spark, x, 16)
    bad = spark.createDataFrame([(0, "Cz"), (0, "Cz"), (0, "T8"), (1, "Cz"), (1, "Fz")], "recording_id bigint, channel string")
    weights = GEO.interpolation_weights(chunks, bad, AT)
    per = {(r.recording_id, r.bad_channel): r.n for r in weights.groupBy("recording_id", "bad_channel").agg(F.count("w").alias("n")).collect()}
    assert per == {(0, "Cz"): 17, (0, "T8"): 17, (1, "Cz"): 16}            # Fz is not there and no source either
    got = joined(G.interpolate(chunks, bad, weights))
    for r, gone in ((0, ["Cz", "T8"]), (1, ["Cz"])):
        src = [c for rr, c in x if rr == r and c not in gone]
        w = dense(np.array([AT[c] for c in src]), np.array([AT[c] for c in gone]))
        for i, c in enumerate(gone):
            assert np.allclose(got[r, c], sum(w[i, j] * x[r, s] for j, s in enumerate(src)), atol=1e-8)
        assert all(np.array_equal(got[r, c], x[r, c]) for c in src)


def test_channels_without_weights_are_listed(spark):
    chunks = chunk_rows(spark, {(0, "Cz"): np.ones(4), (0, "X1"): np.ones(4), (1, "Cz"): np.ones(4)}, 4)
    bad = spark.createDataFrame([(0, "X1"), (1, "Cz")], "recording_id bigint, channel string")
    weights = GEO.interpolation_weights(chunks, bad, AT)
    assert weights.count() == 0
    assert {r.recording_id for r in G.without_weights(bad, weights, present=chunks.select("recording_id", "channel")).collect()} == {0, 1}
    assert GEO.interpolation_weights(chunks.limit(0), bad, AT).count() == 0
    assert GEO.interpolation_weights(chunks, bad.limit(0), AT).count() == 0


def test_prediction_from_positions(spark):
    x = signals(2, 256, lacking=("Pz", "P3"))
    rng = np.random.default_rng(3)
    x[0, "O2"], x[1, "F7"] = rng.normal(size=(2, 256))            # agree with nobody
    chunks = chunk_rows(spark, x, 64)
    rule = GEO.SubsetPredictions.of(AT, draws=20)
    shares = G.prediction_share(chunks, 64, 64, rule)
    low = {(r.recording_id, r.channel): r.low_share for r in shares.collect()}
    assert len(low) == 36 and {k for k, v in low.items() if v > 0.4} == {(0, "O2"), (1, "F7")}
    assert {(r.recording_id, r.channel) for r in G.bad_by_prediction(chunks, 64, 64, rule).collect()} == {(0, "O2"), (1, "F7")}
    # the share equals that of plain weights per set of channels
    for r in range(2):
        names = tuple(sorted(c for rr, c in x if rr == r))
        m = np.zeros((20, len(names), len(names)))
        for d, chosen in enumerate(rule.subsets(names)):
            m[d][:, chosen] = dense(np.array([AT[names[i]] for i in chosen]), np.array([AT[c] for c in names]))
        data = np.array([x[r, c] for c in names])
        for i, c in enumerate(names):
            agree = [np.corrcoef(data[i, s:s + 64], np.median(m @ data[:, s:s + 64], axis=0)[i])[0, 1] for s in range(0, 256, 64)]
            assert low[r, c] == pytest.approx(np.mean(np.array(agree) < 0.75)), (r, c)


def test_too_few_channels_give_a_warning(spark):
    chunks = chunk_rows(spark, {(0, c): np.arange(32.0) for c in ("Cz", "Fz", "Pz")}, 16)
    shares = G.prediction_share(chunks, 16, 16, GEO.SubsetPredictions.of(AT))
    found = G.detector_failures(shares, "prediction").collect()
    assert [(r.recording_id, "4 are needed" in r.reason) for r in found] == [(0, True)]
    assert G.low_channels(shares, 0.4).count() == 0
