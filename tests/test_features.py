"""Array features against numpy and their stated edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright import constants as C
from tracewright.functions import arrays as A, kernels as K
from tracewright.operators import features as X

FS = 80.0


def moments(x):
    n, c = len(x), x - x.mean()
    m2, m3, m4 = (np.mean(c ** p) for p in (2, 3, 4))
    g1, g2 = m3 / m2 ** 1.5, m4 / m2 ** 2 - 3
    skew = g1 * np.sqrt(n * (n - 1)) / (n - 2) if n > 2 else g1
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) if n > 3 else g2
    return skew, kurt


def periodogram(x, fs):
    """Average of Hann periodograms of 256-sample segments, by plain loops."""
    size = min(256, len(x))
    w = np.array([0.5 - 0.5 * np.cos(2 * np.pi * i / size) for i in range(size)])
    specs = []
    for s in range(0, len(x) - size + 1, size - size // 2):
        part = x[s:s + size] - np.mean(x[s:s + size])
        p = np.array([abs(sum(part * w * np.exp(-2j * np.pi * k * np.arange(size) / size))) ** 2 for k in range(size // 2 + 1)])
        for k in range(size // 2 + 1):
            if k and not (size % 2 == 0 and k == size // 2):
                p[k] *= 2
        specs.append(p / (fs * np.sum(w ** 2)))
    return np.mean(specs, axis=0)


def expected(x, fs):
    c = x - x.mean()
    d = np.diff(c)
    time = [sum(a * b < 0 for a, b in zip(c[:-1], c[1:])), sum(a > 0 > b for a, b in zip(d[:-1], d[1:])),
            sum(a < 0 < b for a, b in zip(d[:-1], d[1:])), np.sqrt(np.mean(c ** 2)), *moments(x)]
    p = periodogram(c, fs)
    step = fs / min(256, len(x))
    f = np.arange(len(p)) * step
    pick = lambda lo, hi: p[(f >= lo) & (f <= hi)]

    def area(lo, hi):
        b = pick(lo, hi)
        return b[0] * step if len(b) == 1 else sum((b[1:] + b[:-1]) / 2) * step if len(b) else 0.0
    wide = pick(1, 40)
    peak = f[f >= 1][np.argmax(wide)] if len(wide) else np.nan
    bands = [C.BANDS[b] for b in C.BAND_NAMES]
    return time + [area(1, 40), peak] + [pick(*b).mean() if len(pick(*b)) else 0.0 for b in bands] + [
        area(*b) / (area(1, 40) + 1e-12) for b in bands]


@pytest.mark.parametrize("native", [False, True])
def test_all_features(spark, native):
    rng = np.random.default_rng(0)
    xs = [rng.normal(size=n) for n in (80, 80, 64, 81, 300, 520, 5)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(xs)], "i int, x array<double>")
    got = X.window_features(df, FS, native).orderBy("i").collect()
    for row, x in zip(got, xs):
        assert np.allclose([row[n] for n in C.FEATURES], expected(x, FS), rtol=1e-9, atol=1e-12), len(x)


@pytest.mark.parametrize("native", [False, True])
def test_constant_and_short_windows(spark, native):
    df = spark.createDataFrame([(0, [3.0] * 80), (1, [1.0, 2.0, 1.5]), (2, [1.0, 4.0])], "i int, x array<double>")
    rows = X.window_features(df, FS, native).orderBy("i").collect()
    assert np.isnan(rows[0].skew) and np.isnan(rows[0].kurt_excess) and rows[0].rms == 0 and rows[0].zero_cross == 0
    assert rows[1].skew == pytest.approx(moments(np.array([1.0, 2.0, 1.5]))[0])
    assert (rows[1].maxima, rows[1].minima) == (1, 0)
    assert rows[2].skew == 0


def test_zeros_and_plateaus(spark):
    x = [[1.0, 0.0, -1.0, 1.0], [0.0, 1.0, 1.0, 0.0, -1.0, 0.0]]
    df = spark.createDataFrame([(v,) for v in x], "x array<double>")
    got = df.select(A.zero_crossings(F.col("x")).alias("z"), A.local_maxima(F.col("x")).alias("a"),
                    A.local_minima(F.col("x")).alias("b")).collect()
    assert [(r.z, r.a, r.b) for r in got] == [(1, 0, 1), (0, 0, 1)]


def test_bands(spark):
    df = spark.createDataFrame([([1.0, 5.0, 2.0, 5.0, 3.0],)], "p array<double>")
    p, step = F.col("p"), F.lit(2.0)
    row = df.select(A.band_power(p, step, 0.5, 1.5).alias("none"), A.band_power(p, step, 1.5, 2.5).alias("one"),
                    A.band_power(p, step, 2.0, 6.0).alias("three"), A.band_mean(p, step, 0.5, 1.5).alias("mean_none"),
                    A.peak_frequency(p, step, 1.0, 8.0).alias("peak"), A.peak_frequency(p, step, 0.5, 1.5).alias("no_peak")).first()
    assert (row.none, row.one, row.three, row.mean_none, row.peak) == (0.0, 10.0, 14.0, 0.0, 2.0)
    assert np.isnan(row.no_peak)
    with pytest.raises(ValueError):
        A.band(p, step, 3.0, 3.0)


def test_rate_per_row_and_float_input(spark):
    x = np.random.default_rng(1).normal(size=80).astype(np.float32)
    df = spark.createDataFrame([(64.0, x.tolist()), (80.0, x.tolist())], "fs double, x array<float>")
    got = X.window_features(df, F.col("fs")).collect()
    for row in got:
        assert np.allclose([row[n] for n in C.FEATURES], expected(x.astype(float), row.fs))


def test_average_keeps_nan_and_defaults(spark):
    df = spark.createDataFrame([(0, "a", 1.0, float("nan")), (0, "b", 3.0, 1.0)], "w int, channel string, rms double, skew double")
    row = X.channel_average(df, ["w"], ["rms", "skew"]).first()
    assert row.rms == 2.0 and np.isnan(row.skew)
    made = X.with_defaults(spark.createDataFrame([(7, "pd")], "recording_id int, seg_type string")).first()
    assert (made.seg_type, made.window_sec, made.source, made.valid) == ("PD", 1.0, "7", True) and np.isnan(made.stride_sec)


def test_filter_design():
    for rate in (200.0, 256.0):
        taps = K.bandpass_taps(0.5, 40.0, rate)
        response = lambda hz: abs(np.sum(taps * np.exp(-2j * np.pi * hz / rate * np.arange(len(taps)))))
        assert len(taps) % 2 == 1 and abs(len(taps) / rate - 6.6) < 0.1
        assert np.allclose(taps, taps[::-1])
        assert response(0) < 1e-3 and response(60) < 5e-3 and abs(response(10) - 1) < 5e-3 and abs(response(35) - 1) < 5e-3
