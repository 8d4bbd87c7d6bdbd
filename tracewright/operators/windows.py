"""Windows: where they lie, their labels, and their samples.

Signals are chunk rows: recording_id, channel, chunk, x. ``x`` holds the samples
chunk * chunk_len up to (chunk + 1) * chunk_len; only the last chunk of a channel
may be shorter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tracewright import constants as C
from tracewright.functions.text import time_text
from tracewright.operators.intervals import any_point_inside
from tracewright.operators.ordered import add_position, time_bucket
from tracewright.operators.segments import HOUR, label_annotations

CHANNEL = ["recording_id", "channel"]
BLOCK_WINDOWS = 4096        # windows one row of a segment turns into


# --- positions --------------------------------------------------------------

def sliding_windows(segments: DataFrame, rate: float, window_sec: float = C.WINDOW_SEC,
                    stride_sec: float = C.STRIDE_SEC, n_samples: Column | None = None) -> DataFrame:
    """Full windows inside every segment: ``s`` (offset in samples) and ``onset_sec``.

    ``n_samples`` is the length of the segment's data where known, else it follows
    from the segment's duration.
    """
    length = int(round(window_sec * rate))
    stride = int(round(stride_sec * rate))
    n = n_samples if n_samples is not None else F.bround(
        (F.col("seg_stop") - F.col("seg_start")) * float(rate)).cast("bigint")
    last = F.col("_n") - length
    steps = lambda first, to, step: F.explode(F.sequence(first, to, F.lit(step).cast("bigint")))
    # a long segment is cut into blocks that spread over the tasks before they become windows
    blocks = (segments.withColumn("_n", n).filter(last >= 0)
              .withColumn("_block", steps(F.lit(0).cast("bigint"), last, stride * BLOCK_WINDOWS))
              .repartition("recording_id", "segment_id", "_block"))
    within = F.least(last, F.col("_block") + stride * (BLOCK_WINDOWS - 1))
    return (blocks.withColumn("s", steps(F.col("_block"), within, stride))
            .withColumn("onset_sec", F.col("seg_start") + F.col("s") / float(rate)).drop("_n", "_block"))


def annotation_windows(annotations: DataFrame, recordings: DataFrame, window_ms: int = 500) -> DataFrame:
    """One window around every labelled mark of a whole recording, kept when it lies
    inside the data. Descriptions must match exactly. ``row_idx`` follows the source."""
    placed = label_annotations(annotations).join(
        recordings.select("recording_id", "sfreq", "n_samples"), "recording_id")
    centre = F.bround(F.col("onset_sec") * F.col("sfreq")).cast("bigint")
    margin = (F.col("sfreq") * window_ms / 1000).cast("bigint")
    kept = (placed.withColumn("start", centre - margin).withColumn("stop", centre + margin)
            .filter((F.col("start") >= 0) & (F.col("stop") <= F.col("n_samples"))))
    # ord numbers the annotations of the source; a fixed block of it is the bucket
    blocks = kept.withColumn("_bucket", F.floor(F.col("ord") / 100_000).cast("bigint"))
    numbered = add_position(blocks, ["recording_id"], ["ord"], "_bucket", "row_idx")
    return numbered.select("recording_id", "row_idx", "ord", "start", "stop", "label",
                           F.col("onset_sec").alias("center_sec"),
                           time_text(F.col("onset_sec")).alias("center_hmsms"))


def event_windows(events: DataFrame, rate: float, n_samples: Column | None = None,
                  window_sec: float = C.WINDOW_SEC) -> DataFrame:
    """One window around every event, in samples of its padded crop. Edges may use the
    padding; windows beyond the crop are dropped. ``events`` come from
    ``events_in_segments`` with the crops as segments."""
    margin = int(round(window_sec / 2 * rate))
    centre = F.bround((F.col("onset_sec") - F.col("crop_start")) * float(rate)).cast("bigint")
    n = n_samples if n_samples is not None else F.bround(
        (F.col("crop_stop") - F.col("crop_start")) * float(rate)).cast("bigint")
    return (events.withColumn("start", centre - margin).withColumn("stop", centre + margin)
            .filter((F.col("start") >= 0) & (F.col("stop") <= n)))


def label_windows(windows: DataFrame, marks: DataFrame,
                  window_sec: float | str = C.WINDOW_SEC) -> DataFrame:
    """``label`` = 1 when a mark of the recording lies in [onset, onset + window], else 0."""
    if isinstance(window_sec, str):
        marks = marks.join(windows.select("recording_id", window_sec).distinct(), "recording_id")
    return (any_point_inside(windows, marks, ["recording_id"], "onset_sec", "mark_sec", window_sec, "_hit")
            .withColumn("label", F.col("_hit").cast("int")).drop("_hit"))


def order_windows(windows: DataFrame, bucket_sec: float = HOUR) -> DataFrame:
    """Adds ``row_idx``: stable order by onset inside the recording."""
    blocks = windows.withColumn("_bucket", time_bucket(F.col("onset_sec"), bucket_sec))
    return add_position(blocks, ["recording_id"], ["onset_sec", "segment_id", "s"], "_bucket", "row_idx").drop("_bucket")


def window_counts(windows: DataFrame, keys: list[str] = ["recording_id"]) -> DataFrame:
    """Windows, labels and segment types per recording (or other keys)."""
    pos, non_pd = F.col("label") == 1, F.col("seg_type") == "NON_PD"
    return windows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_windows"), F.count_if(pos).alias("n_pos"),
        F.count_if(~pos).alias("n_neg"), F.count_if(~non_pd).alias("n_pd"),
        F.count_if(non_pd).alias("n_non_pd"), F.count_if(non_pd & ~pos).alias("n_non_pd_neg"))


def negative_pool(windows: DataFrame) -> DataFrame:
    """Negatives taken from NON_PD segments only; positives from anywhere."""
    return windows.filter((F.col("label") == 1) | (F.col("seg_type") == "NON_PD"))


# --- samples ----------------------------------------------------------------

def to_chunks(samples: DataFrame, chunk_len: int) -> DataFrame:
    """Long samples (recording_id, channel, idx, v) to chunk rows; a group holds one chunk."""
    return (samples.groupBy(*CHANNEL, F.floor(F.col("idx") / chunk_len).cast("bigint").alias("chunk"))
            .agg(F.array_sort(F.collect_list(F.struct("idx", "v")))["v"].alias("x")))


def from_chunks(chunks: DataFrame, chunk_len: int) -> DataFrame:
    """Chunk rows back to long samples."""
    return chunks.select(*CHANNEL, "chunk", F.posexplode("x").alias("_pos", "v")).select(
        *CHANNEL, (F.col("chunk") * chunk_len + F.col("_pos")).alias("idx"), "v")


def channel_lengths(chunks: DataFrame, chunk_len: int) -> DataFrame:
    """Number of samples per recording (the shortest channel counts)."""
    per = chunks.groupBy(*CHANNEL).agg(F.max(F.col("chunk") * chunk_len + F.size("x")).alias("n"))
    return per.groupBy("recording_id").agg(F.min("n").alias("n_samples"))


def cut_spans(chunks: DataFrame, spans: DataFrame, chunk_len: int, keys: list[str],
              out_len: int | None = None, signal: list[str] = ["recording_id"]) -> DataFrame:
    """Samples start..stop-1 of every span, for every channel of its signal.

    ``spans``: the ``signal`` columns, the ``keys`` that name a span, start, stop (bigint).
    With ``out_len`` the span comes back as chunk rows of that length counted from
    its start, else as one row with the whole span (use this for short windows).
    Joins on (signal, chunk), so a long recording never meets in one task.
    """
    size = F.lit(out_len) if out_len else F.col("stop") - F.col("start")
    parts = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("stop") - F.col("start") - 1) / size).cast("bigint"))
    outs = (spans.filter(F.col("stop") > F.col("start"))
            .select(*signal, *keys, "start", "stop", F.explode(parts).alias("out_chunk"))
            .withColumn("_from", F.col("start") + F.col("out_chunk") * size)
            .withColumn("_to", F.least(F.col("stop"), F.col("_from") + size)))
    wanted = outs.withColumn("chunk", F.explode(F.sequence(
        F.floor(F.col("_from") / chunk_len).cast("bigint"),
        F.floor((F.col("_to") - 1) / chunk_len).cast("bigint")))).drop("start", "stop")
    base = F.col("chunk") * chunk_len
    lo = F.greatest(F.col("_from") - base, F.lit(0)).cast("int")
    hi = F.least(F.col("_to") - base, F.lit(chunk_len)).cast("int")
    pieces = chunks.join(wanted, [*signal, "chunk"]).select(
        *signal, "channel", *keys, "out_chunk", "chunk", F.slice("x", lo + 1, hi - lo).alias("part"))
    whole = pieces.groupBy(*signal, "channel", *keys, "out_chunk").agg(
        F.flatten(F.array_sort(F.collect_list(F.struct("chunk", "part")))["part"]).alias("x"))
    return whole.withColumnRenamed("out_chunk", "chunk") if out_len else whole.drop("out_chunk")


def with_context(chunks: DataFrame, chunk_len: int | Column, left: int | Column, right: int | Column,
                 keys: list[str] = CHANNEL, neighbours: int | None = None) -> DataFrame:
    """Adds to each chunk up to ``left`` samples before and ``right`` after it:
    ``ext`` with ``before`` context samples in front.

    One shuffle, on the chunk without the channel: a chunk's channels land in the same
    task, so a following mean over the channels is mostly done before it shuffles.

    For signals of several rates the lengths are columns, and ``neighbours`` is the largest number of
    chunks that a context reaches on one side.
    """
    def piece(shift: int, part: Column) -> Column:
        # a piece for the chunk ``shift`` places further on
        return F.struct((F.col("chunk") + shift).alias("chunk"), F.lit(-shift).alias("rel"), part.alias("part"))

    def parts(wanted: int | Column):              # how far, and how many samples there
        if neighbours is not None:
            return [(j, F.greatest(F.lit(0), F.least(chunk_len, wanted - (j - 1) * chunk_len))) for j in range(1, neighbours + 1)]
        return [(j, F.lit(min(chunk_len, wanted - (j - 1) * chunk_len))) for j in range(1, math.ceil(wanted / chunk_len) + 1)]

    sent = [piece(0, F.col("x"))]
    for j, k in parts(left):
        sent.append(piece(j, F.slice("x", F.greatest(F.size("x") - k + 1, F.lit(1)), k)))
    for j, k in parts(right):
        sent.append(piece(-j, F.slice("x", F.lit(1), k)))
    together = [k for k in keys if k != "channel"]
    met = (chunks.select(*keys, F.explode(F.array(*sent)).alias("p")).select(*keys, "p.*")
           .repartition(*together, "chunk").groupBy(*keys, "chunk")
           .agg(F.array_sort(F.collect_list(F.struct("rel", "part"))).alias("parts"),
                F.max(F.when(F.col("rel") == 0, F.size("part"))).alias("own"),
                F.coalesce(F.sum(F.when(F.col("rel") < 0, F.size("part"))), F.lit(0)).cast("int").alias("before")))
    return met.filter(F.col("own").isNotNull()).select(
        *keys, "chunk", F.flatten(F.col("parts")["part"]).alias("ext"), "own", "before")


def slide_chunks(chunks: DataFrame, chunk_len: int, length: int, stride: int,
                 keys: list[str] = CHANNEL) -> DataFrame:
    """All full windows of gap-free chunk rows (grid from sample 0): ``s`` and ``x``.

    A window belongs to the chunk its first sample lies in, so samples are
    shuffled once, not once per overlapping window.
    """
    ext = with_context(chunks, chunk_len, 0, length - 1, keys)
    base = F.col("chunk") * chunk_len
    first = F.ceil(base / stride).cast("bigint") * stride
    last = F.least(base + F.col("own") - 1, base + F.size("ext") - length)
    starts = F.when(last >= first, F.sequence(first, last, F.lit(stride).cast("bigint")))
    return (ext.withColumn("s", F.explode(starts))
            .select(*keys, "s", F.slice("ext", (F.col("s") - base + 1).cast("int"), F.lit(length)).alias("x")))
