"""Queries on the array features of windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright import constants as C
from tracewright.checks import views as V
from tracewright.checks.views import r, rs, sql
from tracewright.functions import arrow
from tracewright.operators import features as X

ID = ["window_id", "channel"]
DIGITS = 8


def _rounded(df, names, keys=ID):
    return df.select(*keys, *[r(n, DIGITS).alias(n) for n in names])


def time_features(spark, sf):
    return _rounded(X.time_columns(V.windows(spark, sf)), C.TIME_FEATURES[:4])


def moment_features(spark, sf):
    return _rounded(X.time_columns(V.windows(spark, sf)), C.TIME_FEATURES[4:])


def psd(spark, sf):
    w = V.windows(spark, sf).withColumn("psd", arrow.welch_psd(F.col("x"), V.FS))
    return w.select(*ID, F.posexplode("psd").alias("k", "p")).withColumn("k", F.col("k").cast("bigint")).withColumn("p", r("p", DIGITS))


def psd_averaged(spark, sf):
    """PSD of whole channels of at least 256 samples: one per half overlapping segment, averaged."""
    w = X.long_psd(V.chunks(spark, sf), V.CHUNK, V.FS)
    return w.select("recording_id", "channel", "k", r("p", DIGITS).alias("p"))


def band_features(spark, sf):
    names = [n for n in C.SPECTRAL_FEATURES if n != "peak_freq_1_40"]
    return _rounded(X.spectral_columns(V.windows(spark, sf), V.FS), names)


def peak_frequency(spark, sf):
    return _rounded(X.spectral_columns(V.windows(spark, sf), V.FS), ["peak_freq_1_40"])


def feature_vector(spark, sf):
    return _rounded(X.window_features(V.windows(spark, sf), V.FS), C.FEATURES)


def averaged(spark, sf):
    return X.channel_average(X.window_features(V.windows(spark, sf), V.FS), ["window_id"])


def feature_vector_avg(spark, sf):
    return _rounded(averaged(spark, sf), C.FEATURES, ["window_id"])


def feature_names(spark, sf):
    long = X.long_features(X.window_features(V.windows(spark, sf), V.FS), ["window_id"])
    return long.withColumn("value", r("value", DIGITS))


def feature_wide(spark, sf):
    channels = [f"C{i}" for i in range(8)]
    f = X.window_features(V.windows(spark, sf), V.FS)
    wide = X.wide_features(f, ["window_id"], channels)
    return _round_all(wide, [f"{c}_{n}" for c in channels for n in C.FEATURES])


def _round_all(df, names):
    return df.withColumns({n: r(n, DIGITS) for n in names})


QUERIES = {f.__name__: f for f in (
    time_features, moment_features, psd, psd_averaged, band_features, peak_frequency, feature_vector,
    feature_vector_avg, feature_names, feature_wide)}


def _cols(names):
    return ", ".join(f"{rs(n, DIGITS)} AS {n}" for n in names)


_LONG_PSD = """
SELECT recording_id, channel, k, avg(q) AS p FROM (
    SELECT recording_id, channel, seg, k, CASE WHEN k IN (0, 128) THEN 1 ELSE 2 END
           * (pow(sum(h * v * cos(2 * pi() * k * i / 256)), 2) + pow(sum(h * v * sin(2 * pi() * k * i / 256)), 2))
           / (64.0 * sum(h * h)) AS q
    FROM (SELECT recording_id, channel, g.seg, idx - g.seg * 128 AS i,
                 v - avg(v) OVER (PARTITION BY recording_id, channel, g.seg) AS v,
                 0.5 - 0.5 * cos(2 * pi() * (idx - g.seg * 128) / 256) AS h
          FROM (SELECT *, max(idx) OVER (PARTITION BY recording_id, channel) + 1 AS n FROM samples), range(0, 4) g(seg)
          WHERE idx >= g.seg * 128 AND idx < g.seg * 128 + 256 AND g.seg * 128 + 256 <= n), range(0, 129) b(k)
    GROUP BY recording_id, channel, seg, k) GROUP BY recording_id, channel, k"""

ORACLE = {
    "time_features": sql(f"SELECT window_id, channel, {_cols(C.TIME_FEATURES[:4])} FROM wtime", "wtime"),
    "moment_features": sql(f"SELECT window_id, channel, {_cols(C.TIME_FEATURES[4:])} FROM wtime", "wtime"),
    "psd": sql(f"SELECT window_id, channel, k, {rs('p', DIGITS)} AS p FROM wpsd", "wpsd"),
    "psd_averaged": sql(f"SELECT recording_id, channel, k, {rs('p', DIGITS)} AS p FROM lp", "samples", extra={"lp": _LONG_PSD}),
    "band_features": sql(f"SELECT window_id, channel, {_cols([n for n in C.SPECTRAL_FEATURES if n != 'peak_freq_1_40'])} FROM wspec", "wspec"),
    "peak_frequency": sql(f"SELECT window_id, channel, {_cols(['peak_freq_1_40'])} FROM wspec", "wspec"),
    "feature_vector": sql(f"SELECT window_id, channel, {_cols(C.FEATURES)} FROM wfeat", "wfeat"),
    "feature_vector_avg": sql("SELECT window_id, " + ", ".join(f"{rs(f'avg({n})', DIGITS)} AS {n}" for n in C.FEATURES)
                              + " FROM wfeat GROUP BY 1", "wfeat"),
    "feature_names": sql(f"""SELECT window_id, channel || '_' || feature AS name, {rs('value', DIGITS)} AS value
        FROM (SELECT window_id, channel, {', '.join(C.FEATURES)} FROM wfeat)
        UNPIVOT (value FOR feature IN ({', '.join(C.FEATURES)}))""", "wfeat"),
    "feature_wide": sql("SELECT window_id, " + ", ".join(
        rs(f"max({n}) FILTER (channel = 'C{i}')", DIGITS) + f" AS C{i}_{n}" for i in range(8) for n in C.FEATURES)
        + " FROM wfeat GROUP BY 1", "wfeat"),
}
