"""Queries on annotations, segments, windows and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.checks import views as V
from tracewright.checks.views import r, rs, sql
from tracewright.operators import segments as S, windows as W

MARGIN_MS = 600_000      # ten minutes on each side of a mark


def segments(spark, sf):
    return S.build_segments(V.annotations(spark, sf)).select(
        "recording_id", "segment_id", r("seg_start").alias("seg_start"), r("seg_stop").alias("seg_stop"), "seg_type")


def sliding(spark, sf):
    return W.sliding_windows(S.build_segments(V.annotations(spark, sf)), V.RATE, V.WINDOW_SEC, V.STRIDE_SEC)


def labelled(spark, sf):
    return W.label_windows(sliding(spark, sf), S.marks(V.annotations(spark, sf)), V.WINDOW_SEC)


def segment_stats(spark, sf):
    s = S.segment_stats(S.build_segments(V.annotations(spark, sf)))
    return s.withColumn("total_sec", r("total_sec", 3))


def unclosed(spark, sf):
    return S.unclosed_segments(V.annotations(spark, sf)).withColumn("onset_sec", r("onset_sec"))


def events_in_segments(spark, sf):
    a = V.annotations(spark, sf)
    return S.events_in_segments(a, S.build_segments(a)).select(
        "recording_id", "segment_id", "ord", r("onset_sec").alias("onset_sec"), "label", "seg_type")


def annotation_windows(spark, sf):
    w = W.annotation_windows(V.annotations(spark, sf), V.recordings(spark, sf), MARGIN_MS)
    return w.withColumn("center_sec", r("center_sec"))


def _crops(spark, sf):
    return S.padded_crops(S.build_segments(V.annotations(spark, sf)), V.recordings(spark, sf), 3600.0)


def padded_crops(spark, sf):
    c = S.core_bounds(_crops(spark, sf), V.RATE, F.bround(F.col("crop_stop") - F.col("crop_start")).cast("bigint"))
    return c.select("recording_id", "segment_id", r("crop_start").alias("crop_start"), r("crop_stop").alias("crop_stop"),
                    r("left_pad").alias("left_pad"), "reduced_padding", "core_from", "core_to")


def event_windows(spark, sf):
    ev = S.events_in_segments(V.annotations(spark, sf), _crops(spark, sf))
    return W.event_windows(ev, V.RATE, window_sec=V.WINDOW_SEC).select(
        "recording_id", "segment_id", "ord", "label", "start", "stop")


def sliding_windows(spark, sf):
    return sliding(spark, sf).select("recording_id", "segment_id", "s", r("onset_sec").alias("onset_sec"))


def label_windows(spark, sf):
    return labelled(spark, sf).select("recording_id", "segment_id", "s", "label")


def mark_list(spark, sf):
    return S.marks(V.annotations(spark, sf)).withColumn("mark_sec", r("mark_sec"))


def mark_reconcile(spark, sf):
    stored = (S.label_annotations(V.annotations(spark, sf)).filter("label = 1")
              .groupBy("recording_id").agg(F.count(F.lit(1)).alias("n_stored")))
    return S.mark_counts(V.annotations(spark, sf), stored)


def window_order(spark, sf):
    return W.order_windows(sliding(spark, sf)).select("recording_id", "segment_id", "s", "row_idx")


def nonpd_pool(spark, sf):
    return W.negative_pool(labelled(spark, sf)).select("recording_id", "segment_id", "s", "seg_type", "label")


def window_counts(spark, sf):
    return W.window_counts(labelled(spark, sf))


def label_marks(spark, sf):
    a = V.annotations(spark, sf)
    exact = S.label_annotations(a).select("ord", F.lit("exact").alias("mode"), "label")
    return exact.unionByName(S.label_annotations(a, strip=True).select("ord", F.lit("stripped").alias("mode"), "label"))


QUERIES = {f.__name__: f for f in (
    segments, segment_stats, unclosed, events_in_segments, annotation_windows, padded_crops, event_windows,
    sliding_windows, label_windows, mark_list, mark_reconcile, window_order, nonpd_pool, window_counts, label_marks)}

_CROPS = """
SELECT s.*, rec_end_sec, greatest(0.0::DOUBLE, seg_start - 3600.0::DOUBLE) AS crop_start,
       least(rec_end_sec, seg_stop + 3600.0::DOUBLE) AS crop_stop
FROM segments s JOIN recordings USING (recording_id)"""
_EVENTS = """
SELECT n.recording_id, s.segment_id, n.ord, n.onset_sec, CASE WHEN d = '*' THEN 1 ELSE 0 END AS label, s.seg_type
FROM notes n JOIN segments s ON n.recording_id = s.recording_id AND n.onset_sec >= s.seg_start AND n.onset_sec < s.seg_stop
WHERE d IN ('*', '-')"""
_BROUND = "CAST(round_even({}, 0) AS BIGINT)"

ORACLE = {
    "segments": sql(f"SELECT recording_id, segment_id, {rs('seg_start')} AS seg_start, {rs('seg_stop')} AS seg_stop, seg_type FROM segments", "segments"),
    "segment_stats": sql(f"""SELECT recording_id, count(*) AS n_segments, count(*) FILTER (seg_type = 'PD') AS n_pd,
        count(*) FILTER (seg_type = 'NON_PD') AS n_non_pd, {rs('sum(seg_stop - seg_start)', 3)} AS total_sec
        FROM segments GROUP BY 1""", "segments"),
    "unclosed": sql(f"""SELECT recording_id, {rs('onset_sec')} AS onset_sec, regexp_replace(d, '_START$', '') AS seg_type
        FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY onset_sec DESC, ord DESC) AS k FROM notes
              WHERE d IN ('PD_START', 'PD_STOP', 'NON_PD_START', 'NON_PD_STOP')) WHERE k = 1 AND d LIKE '%START'""", "notes"),
    "events_in_segments": sql(f"SELECT recording_id, segment_id, ord, {rs('onset_sec')} AS onset_sec, label, seg_type FROM ev",
                              "segments", "notes", extra={"ev": _EVENTS}),
    "annotation_windows": sql(f"""
        SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY ord) - 1 AS row_idx, ord,
               c - m AS start, c + m AS stop, label, {rs('onset_sec')} AS center_sec,
               printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS center_hmsms
        FROM (SELECT a.*, n_samples, CASE description WHEN '*' THEN 1 ELSE 0 END AS label,
                     {_BROUND.format('onset_sec * sfreq')} AS c, CAST(trunc(sfreq * {MARGIN_MS} / 1000) AS BIGINT) AS m,
                     {_BROUND.format('onset_sec * 1000')} AS ms
              FROM annotations a JOIN recordings USING (recording_id) WHERE description IN ('*', '-'))
        WHERE c - m >= 0 AND c + m <= n_samples""", "annotations", "recordings"),
    "padded_crops": sql(f"""
        SELECT recording_id, segment_id, {rs('crop_start')} AS crop_start, {rs('crop_stop')} AS crop_stop,
               {rs('left_pad')} AS left_pad, left_pad < 3600 OR crop_stop - seg_stop < 3600 AS reduced_padding,
               least(a, n) AS core_from, least(a + len, n) AS core_to
        FROM (SELECT *, seg_start - crop_start AS left_pad, {_BROUND.format('seg_start - crop_start')} AS a,
                     {_BROUND.format('seg_stop - seg_start')} AS len, {_BROUND.format('crop_stop - crop_start')} AS n
              FROM crops)""", "segments", "recordings", extra={"crops": _CROPS}),
    "event_windows": sql(f"""
        SELECT recording_id, segment_id, ord, label, c - 3600 AS start, c + 3600 AS stop
        FROM (SELECT ev.*, {_BROUND.format('onset_sec - crop_start')} AS c, {_BROUND.format('crop_stop - crop_start')} AS n
              FROM ev JOIN crops USING (recording_id, segment_id))
        WHERE c - 3600 >= 0 AND c + 3600 <= n""", "segments", "recordings", "notes",
        extra={"crops": _CROPS, "ev": _EVENTS}),
    "sliding_windows": sql(f"SELECT recording_id, segment_id, s, {rs('onset_sec')} AS onset_sec FROM sliding", "sliding"),
    "label_windows": sql("SELECT recording_id, segment_id, s, label FROM labelled", "labelled"),
    "mark_list": sql(f"SELECT recording_id, {rs('mark_sec')} AS mark_sec FROM marks", "marks"),
    "mark_reconcile": sql("""
        SELECT recording_id, n_read, n_stored FROM (
            SELECT recording_id, count(*) FILTER (d = '*') AS n_read, count(*) FILTER (description = '*') AS n_stored
            FROM notes GROUP BY 1) WHERE n_read <> n_stored""", "notes"),
    "window_order": sql("""SELECT recording_id, segment_id, s,
        row_number() OVER (PARTITION BY recording_id ORDER BY onset_sec, segment_id, s) - 1 AS row_idx FROM sliding""", "sliding"),
    "nonpd_pool": sql("SELECT recording_id, segment_id, s, seg_type, label FROM labelled WHERE label = 1 OR seg_type = 'NON_PD'", "labelled"),
    "window_counts": sql("""SELECT recording_id, count(*) AS n_windows, count(*) FILTER (label = 1) AS n_pos,
        count(*) FILTER (label = 0) AS n_neg, count(*) FILTER (seg_type = 'PD') AS n_pd,
        count(*) FILTER (seg_type = 'NON_PD') AS n_non_pd,
        count(*) FILTER (seg_type = 'NON_PD' AND label = 0) AS n_non_pd_neg FROM labelled GROUP BY 1""", "labelled"),
    "label_marks": sql("""
        SELECT ord, 'exact' AS mode, CASE description WHEN '*' THEN 1 ELSE 0 END AS label FROM notes WHERE description IN ('*', '-')
        UNION ALL SELECT ord, 'stripped', CASE d WHEN '*' THEN 1 ELSE 0 END FROM notes WHERE d IN ('*', '-')""", "notes"),
}
