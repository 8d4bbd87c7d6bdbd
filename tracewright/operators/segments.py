"""Annotations to marks, segments and events.

Annotations: recording_id, ord, onset_sec, description. ``ord`` is the position in
the source and breaks ties of equal onsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracewright import constants as C
from tracewright.functions.text import mark_label, strip_note
from tracewright.operators.intervals import points_in_intervals
from tracewright.operators.ordered import add_position, add_previous, time_bucket

HOUR = 3600.0


def marks(annotations: DataFrame) -> DataFrame:
    """Positive marks only: recording_id, mark_sec."""
    return (annotations.filter(strip_note(F.col("description")) == C.POSITIVE_MARK)
            .select("recording_id", F.col("onset_sec").alias("mark_sec")))


def label_annotations(annotations: DataFrame, strip: bool = False) -> DataFrame:
    """Marks with label 1 or 0; everything else is dropped. ``strip`` accepts
    descriptions that carry the note prefix or blanks."""
    text = strip_note(F.col("description")) if strip else F.col("description")
    return annotations.withColumn("label", mark_label(text)).filter(F.col("label").isNotNull())


def build_segments(annotations: DataFrame, bucket_sec: float = HOUR) -> DataFrame:
    """recording_id, segment_id, seg_start, seg_stop, seg_type.

    A STOP closes the segment opened by the START directly before it (among START
    and STOP marks) when both name the same type. A later START replaces an open
    one and a STOP of the other type discards it, which is the same rule.
    ``segment_id`` is the position in order of closing, from 0.
    """
    text = strip_note(F.col("description"))
    first, *others = C.SEGMENT_TYPES
    is_marker = lambda t: text.isin(f"{t}_START", f"{t}_STOP")
    seg_type = F.when(is_marker(first), first)
    for t in others:
        seg_type = seg_type.when(is_marker(t), t)
    markers = (annotations.withColumn("seg_type", seg_type).filter(F.col("seg_type").isNotNull())
               .select("recording_id", "ord", "onset_sec", "seg_type",
                       text.endswith("_START").alias("is_start"),
                       time_bucket(F.col("onset_sec"), bucket_sec).alias("_bucket")))
    chained = add_previous(markers, ["recording_id"], ["onset_sec", "ord"], "_bucket",
                           F.struct("is_start", "seg_type", "onset_sec"), "prev")
    closed = chained.filter(~F.col("is_start") & F.col("prev.is_start")
                            & (F.col("prev.seg_type") == F.col("seg_type")))
    numbered = add_position(closed, ["recording_id"], ["onset_sec", "ord"], "_bucket", "segment_id")
    return numbered.select("recording_id", "segment_id", F.col("prev.onset_sec").alias("seg_start"),
                           F.col("onset_sec").alias("seg_stop"), "seg_type")


def unclosed_segments(annotations: DataFrame) -> DataFrame:
    """Last START of a recording that no later START or STOP follows: reported, not kept."""
    text = strip_note(F.col("description"))
    markers = annotations.select("recording_id", "ord", "onset_sec", text.alias("text")).filter(
        F.col("text").isin([f"{t}_{e}" for t in C.SEGMENT_TYPES for e in ("START", "STOP")]))
    last = markers.groupBy("recording_id").agg(
        F.max_by(F.struct("text", "onset_sec"), F.struct("onset_sec", "ord")).alias("m"))
    return (last.filter(F.col("m.text").endswith("_START"))
            .select("recording_id", F.col("m.onset_sec").alias("onset_sec"),
                    F.regexp_replace("m.text", "_START$", "").alias("seg_type")))


def events_in_segments(annotations: DataFrame, segments: DataFrame,
                       bucket_sec: float = HOUR) -> DataFrame:
    """Labelled marks with the segment they fall in (start included, stop not)."""
    events = label_annotations(annotations, strip=True).select(
        "recording_id", "ord", "onset_sec", "label")
    return points_in_intervals(events, segments, ["recording_id"], "onset_sec",
                               "seg_start", "seg_stop", bucket_sec)


def padded_crops(segments: DataFrame, recordings: DataFrame, pad_sec: float = C.EDGE_PAD_SEC) -> DataFrame:
    """Segment plus context on both sides, clipped to the recording."""
    start, stop = F.col("seg_start"), F.col("seg_stop")
    joined = segments.join(recordings.select("recording_id", "rec_end_sec"), "recording_id")
    return (joined.withColumn("crop_start", F.greatest(F.lit(0.0), start - pad_sec))
            .withColumn("crop_stop", F.least(F.col("rec_end_sec"), stop + pad_sec))
            .withColumn("left_pad", start - F.col("crop_start"))
            .withColumn("reduced_padding", (F.col("left_pad") < pad_sec)
                        | (F.col("crop_stop") - stop < pad_sec)))


def core_bounds(crops: DataFrame, rate: Column | float, n_samples: Column) -> DataFrame:
    """First and one-past-last sample of the segment inside its crop, clamped to the data."""
    rate = F.lit(float(rate)) if isinstance(rate, (int, float)) else rate
    first = F.bround(F.col("left_pad") * rate).cast("bigint")
    length = F.bround((F.col("seg_stop") - F.col("seg_start")) * rate).cast("bigint")
    return (crops.withColumn("core_from", F.least(first, n_samples))
            .withColumn("core_to", F.least(first + length, n_samples)))


def mark_counts(annotations: DataFrame, stored: DataFrame) -> DataFrame:
    """Recordings whose stored mark count (recording_id, n_stored) differs from the
    annotations; the annotations win."""
    fresh = marks(annotations).groupBy("recording_id").agg(F.count(F.lit(1)).alias("n_read"))
    both = fresh.join(stored, "recording_id", "full_outer").select(
        "recording_id", F.coalesce("n_read", F.lit(0)).alias("n_read"),
        F.coalesce("n_stored", F.lit(0)).alias("n_stored"))
    return both.filter(F.col("n_read") != F.col("n_stored"))


def segment_stats(segments: DataFrame) -> DataFrame:
    """Segments per recording and type, with total length."""
    is_type = lambda t: F.col("seg_type") == t
    return segments.groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("n_segments"),
        F.count_if(is_type("PD")).alias("n_pd"), F.count_if(is_type("NON_PD")).alias("n_non_pd"),
        F.sum(F.col("seg_stop") - F.col("seg_start")).alias("total_sec"))
