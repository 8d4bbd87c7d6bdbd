"""Queries on signal cleaning. Signals are recordings of eight channels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tracewright.checks import views as V
from tracewright.checks.views import r, rs, sql
from tracewright.functions.splines import spline_weights
from tracewright.operators import cleaning as G, geometry as GEO, windows as W

ID = ["recording_id", "channel"]
DIGITS = 8
FRAME = 32                                    # samples of a quality window
TAPS = [(((i * 37) % 23) - 11) / 40.0 for i in range(-50, 51)]
UP, DOWN = 5, 8                               # 64 Hz to 40 Hz
UP_TAPS = [(((i * 29) % 19) - 9) / 20.0 for i in range(-60, 61)]


def _long(chunks, chunk_len=V.CHUNK):
    return W.from_chunks(chunks, chunk_len).withColumn("v", r("v", DIGITS))


def bad_rows(spark, sf):
    """Recordings with two bad channels and with one, by turns."""
    ids = V.chunks(spark, sf).filter("chunk = 0").select(*ID)
    even = F.col("recording_id") % 2 == 0
    return ids.filter((even & F.col("channel").isin("C1", "C5")) | (~even & (F.col("channel") == "C2")))


def weights(spark, sf):
    """Weights of every bad set of the signals, from the channels they have."""
    pairs = {"C1,C5": ["C1", "C5"], "C2": ["C2"]}
    src = V.chunks(spark, sf).select("channel").distinct()
    bad = F.explode(F.array(*[F.struct(F.lit(s).alias("bad_set"), F.lit(b).alias("bad_channel"))
                              for s, bs in pairs.items() for b in bs]))
    n = lambda c: F.substring(c, 2, 1).cast("int")
    return (src.select(bad.alias("b"), F.col("channel").alias("src_channel")).select("b.*", "src_channel")
            .filter(~F.contains("bad_set", "src_channel"))
            .withColumn("w", ((n("src_channel") * 7 + n("bad_channel") * 3) % 5 - 1) / F.lit(20.0)))


# six predictions of every channel from all others
PREDICTIONS = G.PredictionWeights.of(
    (k, f"C{i}", f"C{j}", ((i * 5 + j * 3 + k * 7) % 11 - 3) / 10.0) for k in range(6) for i in range(8) for j in range(8) if i != j)


# the eight channels at eight places of the head; every third recording lacks one of them
PLACES = dict(zip([f"C{i}" for i in range(8)], [GEO.sphere_positions()[c] for c in ("Fp1", "Fp2", "F7", "T7", "C3", "Pz", "O1", "O2")]))
LACKING = "C6"
SUBSETS = GEO.SubsetPredictions.of(PLACES, draws=6, share=0.5)


def _lacking(spark, sf):
    return V.chunks(spark, sf).filter((F.col("recording_id") % 3 != 0) | (F.col("channel") != LACKING))


def interpolate_positions(spark, sf):
    """Bad channels replaced with weights from positions, of the channels that each recording has."""
    c, bad = _lacking(spark, sf), bad_rows(spark, sf)
    return _long(G.repair(c, bad, GEO.interpolation_weights(c, bad, PLACES)))


def ransac_positions(spark, sf):
    """The prediction rule without a weight input."""
    s = G.prediction_share(_lacking(spark, sf), V.CHUNK, FRAME, SUBSETS, limit=0.05).drop("error")
    return s.withColumn("low_share", r("low_share"))


def avg_reference(spark, sf):
    return _long(G.average_reference(V.chunks(spark, sf)))


def interpolate_channels(spark, sf):
    return _long(G.interpolate(V.chunks(spark, sf), bad_rows(spark, sf), weights(spark, sf)))


def interpolate_and_reference(spark, sf):
    return _long(G.repair(V.chunks(spark, sf), bad_rows(spark, sf), weights(spark, sf)))


def _spans(spark, sf):
    ids = V.chunks(spark, sf).filter("chunk = 0 AND channel = 'C0'").select("recording_id")
    return (ids.withColumn("span_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))))
            .withColumn("start", F.col("span_id") * 131 + F.col("recording_id") * 7 % 50)
            .withColumn("stop", F.col("start") + 90 + F.col("span_id") * 40))


def crop_trim(spark, sf):
    cut = W.cut_spans(V.chunks(spark, sf), _spans(spark, sf), V.CHUNK, ["span_id"])
    return cut.select(*ID, "span_id", F.posexplode("x").alias("pos", "v")).withColumn("v", r("v", DIGITS))


def crop_chunks(spark, sf):
    cut = W.cut_spans(V.chunks(spark, sf), _spans(spark, sf), V.CHUNK, ["span_id"], out_len=40)
    return cut.select(*ID, "span_id", "chunk", F.size("x").cast("bigint").alias("n"),
                      r(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), DIGITS).alias("total"))


def slide_samples(spark, sf):
    cut = W.slide_chunks(V.chunks(spark, sf), V.CHUNK, 80, 20)
    return cut.select(*ID, "s", F.size("x").cast("bigint").alias("n"),
                      r(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), DIGITS).alias("total"))


def fir_bandpass(spark, sf):
    return _long(G.fir_filter(V.chunks(spark, sf), V.CHUNK, TAPS))


def resample(spark, sf):
    return _long(G.resample(V.chunks(spark, sf), V.CHUNK, UP, DOWN, UP_TAPS, edge="zero"), V.CHUNK * UP // DOWN)


def resample_rates(spark, sf):
    """Recordings of 64 Hz (chunks of 64 samples) and, every second one, of 32 Hz (chunks of 32) to 40 Hz in one run."""
    c, odd = V.chunks(spark, sf), F.col("recording_id") % 2 == 1
    halves = c.filter(odd).select(*ID, "chunk", F.posexplode(F.array(F.slice("x", 1, 32), F.slice("x", 33, 32))).alias("half", "part"))
    rows = c.filter(~odd).withColumn("sfreq", F.lit(64.0)).unionByName(
        halves.select(*ID, (F.col("chunk") * 2 + F.col("half")).alias("chunk"), F.col("part").alias("x"), F.lit(32.0).alias("sfreq")))
    made = G.resample_rates(rows, {64.0: G.RateChange(64, UP, DOWN, UP_TAPS), 32.0: G.RateChange(32, UP, DOWN // 2, UP_TAPS)}, edge="zero")
    return _long(made, 40)


def bad_deviation(spark, sf):
    d = G.channel_deviation(V.chunks(spark, sf))
    return d.select(*ID, r("spread", DIGITS).alias("spread"), r("z", 5).alias("z"), (F.abs("z") > 1.5).alias("bad"))


def bad_correlation(spark, sf):
    return G.correlation_share(V.chunks(spark, sf), V.CHUNK, FRAME, limit=0.35).drop("error").withColumn("low_share", r("low_share"))


def ransac_vote(spark, sf):
    s = G.prediction_share(V.chunks(spark, sf), V.CHUNK, FRAME, PREDICTIONS, limit=0.05).drop("error")
    return s.withColumn("low_share", r("low_share"))


def bad_union(spark, sf):
    c = V.chunks(spark, sf)
    return G.bad_union(
        G.bad_by_deviation(c, limit=1.5), G.bad_by_correlation(c, V.CHUNK, FRAME, limit=0.35, share=0.7),
        G.bad_by_prediction(c, V.CHUNK, FRAME, PREDICTIONS, limit=0.05, share=0.6), present=c)


def finite_check(spark, sf):
    odd = F.when(F.col("chunk") == 3, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    hit = (F.col("recording_id") + F.substring("channel", 2, 1).cast("int") + F.col("chunk")) % 7 == 0
    c = V.chunks(spark, sf).withColumn("x", F.when(hit & (F.col("chunk") > 2), F.transform("x", lambda v: v * odd)).otherwise(F.col("x")))
    return G.non_finite_channels(c).withColumn("channels", F.concat_ws(",", "channels"))


QUERIES = {f.__name__: f for f in (
    avg_reference, interpolate_channels, interpolate_and_reference, crop_trim, crop_chunks, slide_samples,
    fir_bandpass, resample, bad_deviation, bad_correlation, ransac_vote, bad_union, finite_check,
    interpolate_positions, ransac_positions, resample_rates)}


def _values(rows, names):
    return f"(VALUES {', '.join(rows)}) t({', '.join(names)})"


_N = "CAST(substr({}, 2, 1) AS INTEGER)"
_FIXED = f"""
SELECT s.recording_id, s.channel, s.idx, CASE WHEN b.channel IS NULL THEN s.v ELSE p.v END AS v
FROM samples s
LEFT JOIN bad b ON b.recording_id = s.recording_id AND b.channel = s.channel
LEFT JOIN (SELECT s.recording_id, b.channel, s.idx, count(*) AS n,
                  sum(s.v * (({_N.format('s.channel')} * 7 + {_N.format('b.channel')} * 3) % 5 - 1) / 20.0) AS v
           FROM samples s JOIN bad b USING (recording_id)
           WHERE NOT EXISTS (SELECT 1 FROM bad o WHERE o.recording_id = s.recording_id AND o.channel = s.channel)
           GROUP BY s.recording_id, b.channel, s.idx) p
    ON p.recording_id = s.recording_id AND p.channel = s.channel AND p.idx = s.idx
JOIN (SELECT recording_id, count(DISTINCT channel) FILTER ((recording_id, channel) NOT IN (SELECT (recording_id, channel) FROM bad)) AS sources
      FROM samples GROUP BY 1) m ON m.recording_id = s.recording_id
WHERE b.channel IS NULL OR p.n = m.sources"""
_BAD = """
SELECT DISTINCT recording_id, channel FROM samples
WHERE (recording_id % 2 = 0 AND channel IN ('C1', 'C5')) OR (recording_id % 2 = 1 AND channel = 'C2')"""
_SPANS = """
SELECT *, start + 90 + span_id * 40 AS stop
FROM (SELECT recording_id, span_id, span_id * 131 + recording_id * 7 % 50 AS start
      FROM (SELECT DISTINCT recording_id FROM samples), range(0, 4) g(span_id))"""
_TAPS = "SELECT * FROM " + _values([f"({j}, {t!r}::DOUBLE)" for j, t in enumerate(TAPS, -50)], ["j", "h"])
_UP_TAPS = "SELECT * FROM " + _values([f"({j}, {t!r}::DOUBLE)" for j, t in enumerate(UP_TAPS, -60)], ["j", "h"])
# odd reflection: -i -> 2 x(0) - x(i), n-1+i -> 2 x(n-1) - x(n-1-i)
_EXTENDED = """
SELECT recording_id, channel, idx, v FROM samples
UNION ALL SELECT recording_id, channel, -idx, 2 * (first_value(v) OVER w) - v FROM samples WINDOW w AS (PARTITION BY recording_id, channel ORDER BY idx) QUALIFY idx > 0
UNION ALL SELECT recording_id, channel, 2 * last - idx, 2 * at_end - v
FROM (SELECT *, max(idx) OVER w AS last, arg_max(v, idx) OVER w AS at_end FROM samples WINDOW w AS (PARTITION BY recording_id, channel))
WHERE idx < last"""


def _hazen(x: str, n: str, q: float) -> str:
    """Quantile at n*q - 1/2 of a sorted list ``x`` of ``n`` values."""
    pos = f"least(greatest({n} * {q} - 0.5, 0), {n} - 1)"
    lo, hi = f"{x}[CAST(floor({pos}) AS INTEGER) + 1]", f"{x}[CAST(ceil({pos}) AS INTEGER) + 1]"
    return f"({lo} + ({hi} - {lo}) * ({pos} - floor({pos})))"


_DEVIATION = f"""
SELECT recording_id, channel, spread, CASE WHEN sd > 0 THEN (spread - mid) / sd ELSE 0 END AS z
FROM (SELECT *, {_hazen('l', 'len(l)', 0.5)} AS mid, 0.7413 * ({_hazen('l', 'len(l)', 0.75)} - {_hazen('l', 'len(l)', 0.25)}) AS sd
      FROM (SELECT recording_id, channel, spread, list_sort(list(spread) OVER (PARTITION BY recording_id)) AS l
            FROM (SELECT recording_id, channel, 0.7413 * ({_hazen('l', 'len(l)', 0.75)} - {_hazen('l', 'len(l)', 0.25)}) AS spread
                  FROM (SELECT recording_id, channel, list_sort(list(v)) AS l FROM samples GROUP BY ALL))))"""
_CORRELATION = f"""
SELECT recording_id, channel, avg(CASE WHEN best < 0.35 THEN 1.0 ELSE 0.0 END) AS low_share
FROM (SELECT recording_id, channel, win, {_hazen('l', 'len(l)', 0.98)} AS best
      FROM (SELECT recording_id, channel, win, list_sort(list(c)) AS l
            FROM (SELECT recording_id, channel, win, CASE WHEN channel = other THEN 0.0 ELSE abs(c) END AS c
                  FROM (SELECT a.recording_id, a.channel, b.channel AS other, a.idx // {FRAME} AS win, corr(a.v, b.v) AS c
                        FROM samples a JOIN samples b ON a.recording_id = b.recording_id AND a.idx = b.idx GROUP BY ALL))
            GROUP BY ALL)) GROUP BY ALL"""
_PREDICTION = f"""
SELECT recording_id, channel, avg(CASE WHEN c < 0.05 THEN 1.0 ELSE 0.0 END) AS low_share
FROM (SELECT s.recording_id, s.channel, s.idx // {FRAME} AS win, corr(s.v, m.v) AS c
      FROM samples s JOIN (
          SELECT recording_id, channel, idx, median(v) AS v FROM (
              SELECT s.recording_id, t.channel, s.idx, k,
                     sum(s.v * (({_N.format('t.channel')} * 5 + {_N.format('s.channel')} * 3 + k * 7) % 11 - 3) / 10.0) AS v
              FROM samples s, (SELECT DISTINCT channel FROM samples) t, range(0, 6) d(k)
              WHERE s.channel <> t.channel GROUP BY ALL) GROUP BY ALL) m USING (recording_id, channel, idx)
      GROUP BY ALL) GROUP BY ALL"""

_SETS = {True: tuple(c for c in PLACES if c != LACKING), False: tuple(PLACES)}


def _spline_rows() -> list[str]:
    """(recording lacks a channel, recording is even, bad, source, w) as SQL literals."""
    rows = []
    for lacks, names in _SETS.items():
        for even, gone in ((True, ("C1", "C5")), (False, ("C2",))):
            src = [c for c in names if c not in gone]
            w = spline_weights(np.array([PLACES[c] for c in src]), np.array([PLACES[c] for c in gone]))
            rows += [f"({lacks}, {even}, '{b}', '{c}', {float(w[i, j])!r}::DOUBLE)"
                     for i, b in enumerate(gone) for j, c in enumerate(src)]
    return rows


def _subset_rows() -> list[str]:
    """(recording lacks a channel, draw, channel, source, w) as SQL literals."""
    return [f"({lacks}, {k}, '{names[a]}', '{names[b]}', {float(m[k, a, b])!r}::DOUBLE)"
            for lacks, names in _SETS.items() for m in [SUBSETS.matrix(names)] for k, a, b in zip(*np.nonzero(m))]


_HAVE = f"SELECT * FROM samples WHERE recording_id % 3 <> 0 OR channel <> '{LACKING}'"
_FROM_PLACES = f"""
SELECT s.recording_id, s.channel, s.idx, s.v FROM have s ANTI JOIN bad USING (recording_id, channel)
UNION ALL SELECT s.recording_id, w.bad, s.idx, sum(s.v * w.w)
FROM have s JOIN {_values(_spline_rows(), ['lacks', 'even', 'bad', 'src', 'w']).replace(' t(', ' w(')}
    ON w.lacks = (s.recording_id % 3 = 0) AND w.even = (s.recording_id % 2 = 0) AND w.src = s.channel
GROUP BY s.recording_id, w.bad, s.idx, w.lacks, w.even
HAVING count(*) = CASE WHEN w.lacks THEN 7 ELSE 8 END - CASE WHEN w.even THEN 2 ELSE 1 END"""
# a frame with fewer than seven channels has too few for a subset: no share for its channels
_FROM_SUBSETS = f"""
SELECT recording_id, channel, CASE WHEN min(k) >= 7 THEN avg(CASE WHEN c < 0.05 THEN 1.0 ELSE 0.0 END) END AS low_share
FROM (SELECT s.recording_id, s.channel, s.idx // {FRAME} AS win, corr(s.v, m.v) AS c, any_value(n.k) AS k
      FROM have s JOIN (SELECT recording_id, idx, count(*) AS k FROM have GROUP BY ALL) n USING (recording_id, idx) LEFT JOIN (
          SELECT recording_id, channel, idx, median(v) AS v FROM (
              SELECT s.recording_id, w.channel, s.idx, w.k, sum(s.v * w.w) AS v
              FROM have s JOIN {_values(_subset_rows(), ['lacks', 'k', 'channel', 'src', 'w']).replace(' t(', ' w(')}
                  ON w.lacks = (s.recording_id % 3 = 0) AND w.src = s.channel GROUP BY ALL) GROUP BY ALL) m USING (recording_id, channel, idx)
      GROUP BY ALL) GROUP BY ALL"""

_V = rs("v", DIGITS)
_REF = "SELECT recording_id, channel, idx, v - avg(v) OVER (PARTITION BY recording_id, idx) AS v FROM {}"

ORACLE = {
    "avg_reference": sql(f"SELECT recording_id, channel, idx, {_V} AS v FROM ({_REF.format('samples')})", "samples"),
    "interpolate_channels": sql(f"SELECT recording_id, channel, idx, {_V} AS v FROM fixed", "samples", extra={"bad": _BAD, "fixed": _FIXED}),
    "interpolate_and_reference": sql(f"SELECT recording_id, channel, idx, {_V} AS v FROM ({_REF.format('fixed')})", "samples",
                                     extra={"bad": _BAD, "fixed": _FIXED}),
    "crop_trim": sql(f"""SELECT recording_id, channel, span_id, CAST(idx - start AS INTEGER) AS pos, {_V} AS v
        FROM samples JOIN spans USING (recording_id) WHERE idx >= start AND idx < stop""", "samples", extra={"spans": _SPANS}),
    "crop_chunks": sql(f"""SELECT recording_id, channel, span_id, CAST((idx - start) // 40 AS BIGINT) AS chunk, count(*) AS n,
        {rs('sum(v)', DIGITS)} AS total FROM samples JOIN spans USING (recording_id)
        WHERE idx >= start AND idx < stop GROUP BY 1, 2, 3, 4""", "samples", extra={"spans": _SPANS}),
    "slide_samples": sql(f"""SELECT recording_id, channel, s, count(*) AS n, {rs('sum(v)', DIGITS)} AS total
        FROM (SELECT *, max(idx) OVER (PARTITION BY recording_id, channel) + 1 AS n FROM samples), range(0, 561, 20) g(s)
        WHERE idx >= s AND idx < s + 80 AND s + 80 <= n GROUP BY 1, 2, 3""", "samples"),
    "fir_bandpass": sql(f"""SELECT s.recording_id, s.channel, s.idx, {rs('sum(e.v * h)', DIGITS)} AS v
        FROM samples s, taps JOIN ext e ON e.recording_id = s.recording_id AND e.channel = s.channel AND e.idx = s.idx - j
        GROUP BY 1, 2, 3""", "samples", extra={"taps": _TAPS, "ext": _EXTENDED}),
    "resample": sql(f"""SELECT recording_id, channel, k AS idx, {rs('sum(v * h)', DIGITS)} AS v
        FROM (SELECT *, max(idx) OVER (PARTITION BY recording_id, channel) + 1 AS n FROM samples), range(0, 400) g(k), taps
        WHERE j = k * {DOWN} - idx * {UP} AND k * {DOWN} < n * {UP} GROUP BY 1, 2, 3""", "samples",
                    extra={"taps": _UP_TAPS}),
    "resample_rates": sql(f"""SELECT recording_id, channel, k AS idx, {rs('sum(v * h)', DIGITS)} AS v
        FROM (SELECT *, max(idx) OVER (PARTITION BY recording_id, channel) + 1 AS n, CASE WHEN recording_id % 2 = 1 THEN {DOWN // 2} ELSE {DOWN} END AS down
              FROM samples), range(0, 800) g(k), taps
        WHERE j = k * down - idx * {UP} AND k * down < n * {UP} GROUP BY 1, 2, 3""", "samples", extra={"taps": _UP_TAPS}),
    "bad_deviation": sql(f"SELECT recording_id, channel, {rs('spread', DIGITS)} AS spread, {rs('z', 5)} AS z, abs(z) > 1.5 AS bad FROM dev",
                         "samples", extra={"dev": _DEVIATION}),
    "bad_correlation": sql(f"SELECT recording_id, channel, {rs('low_share')} AS low_share FROM cor", "samples", extra={"cor": _CORRELATION}),
    "ransac_vote": sql(f"SELECT recording_id, channel, {rs('low_share')} AS low_share FROM pre", "samples", extra={"pre": _PREDICTION}),
    "interpolate_positions": sql(f"SELECT recording_id, channel, idx, {_V} AS v FROM ({_REF.format('placed')})", "samples",
                                 extra={"bad": _BAD, "have": _HAVE, "placed": _FROM_PLACES}),
    "ransac_positions": sql(f"SELECT recording_id, channel, {rs('low_share')} AS low_share FROM pre", "samples",
                            extra={"have": _HAVE, "pre": _FROM_SUBSETS}),
    "bad_union": sql("""SELECT recording_id, channel FROM dev WHERE abs(z) > 1.5
        UNION SELECT recording_id, channel FROM cor WHERE low_share > 0.7
        UNION SELECT recording_id, channel FROM pre WHERE low_share > 0.6""", "samples",
                     extra={"dev": _DEVIATION, "cor": _CORRELATION, "pre": _PREDICTION}),
    "finite_check": sql("""SELECT recording_id, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels, 'non-finite samples' AS reason
        FROM samples WHERE idx // 64 > 2 AND (recording_id + CAST(substr(channel, 2, 1) AS INTEGER) + idx // 64) % 7 = 0 GROUP BY 1""", "samples"),
}
