"""Stored windows with fresh labels.

Windows are cut and stored once with their samples; marks are corrected later. Labels, features and counts then follow from
the stored windows and the present annotations, without the recordings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tracewright import constants as C
from tracewright.operators import features as X, segments as S, windows as W
from tracewright.sources import tables as T


def store_windows(windows: DataFrame, annotations: DataFrame, path: str, partition_by: list[str] = ["recording_id"]) -> None:
    """Write window rows (recording_id, s, onset_sec, channel, x, ...) with ``n_marks``, the marks of the recording
    at this time. Partitions are what ``replace_partitions`` replaces later."""
    counts = S.marks(annotations).groupBy("recording_id").agg(F.count(F.lit(1)).alias("n_marks"))
    T.write_dataset(windows.join(counts, "recording_id", "left").fillna(0, ["n_marks"]), path, partition_by)


@dataclass(frozen=True)
class Relabelled:
    """Stored ``windows`` with the label of the present marks; recordings whose marks differ in number from those at the
    time of storing (recording_id, n_read, n_stored); ``rejected`` (item, reason): recordings without stored windows, and stored ones that are
    no longer there, whose windows are left out."""
    windows: DataFrame
    changed: DataFrame
    rejected: DataFrame


def relabel(stored: DataFrame, annotations: DataFrame, recordings: DataFrame, window_sec: float | str = C.WINDOW_SEC) -> Relabelled:
    """``stored``: what ``store_windows`` wrote. The samples move once, to meet the marks of their time bucket."""
    there = recordings.select("recording_id").distinct()
    kept = stored.join(there, "recording_id", "left_semi").drop("label")
    counts = kept.groupBy("recording_id").agg(F.max("n_marks").alias("n_stored"))
    own = annotations.join(counts.select("recording_id"), "recording_id", "left_semi")
    return Relabelled(W.label_windows(kept.drop("n_marks"), S.marks(annotations), window_sec), S.mark_counts(own, counts),
                      T.rejects(T.empty_recordings(there, stored), T.missing_recordings(stored, there)))


def relabelled_features(made: Relabelled, rate: float, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Feature rows of every window and channel with the fresh label, and the windows that failed (see
    ``features.features_and_failures``). ``key`` names a window."""
    good, failed = X.features_and_failures(made.windows.select(*key, "channel", "x"), rate, key)
    meta = made.windows.drop("x", "channel").dropDuplicates(key)
    return good.join(meta, key), failed


def replace_partitions(rows: DataFrame, path: str, partition_by: list[str] = ["recording_id"]) -> None:
    """Overwrite the partitions that ``rows`` has and leave the others. ``rows`` must not be read from ``path``; store them first."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
