"""From signals and annotations to labelled feature rows.

Signals are chunk rows (see ``operators.windows``), of one sampling rate (``Rates``) or of
several (``RateTable``), where chunks span the same time at every rate.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tracewright import constants as C
from tracewright.functions import kernels as K
from tracewright.operators import channels as CH, cleaning as G, features as X, geometry as GEO, segments as S, windows as W
from tracewright.operators.ordered import add_position, time_bucket
from tracewright.operators.segments import HOUR
from tracewright.plans.tables import materialize
from tracewright.sources.catalogue import patient_index
from tracewright.sources.tables import as_event_onset

CROP = ["recording_id", "segment_id"]


@dataclass(frozen=True)
class Rates:
    """Sampling rate of the signals, rate of the windows, and the chunk length of the
    signals; chunk_len * target / source must be whole."""
    source: float
    chunk_len: int
    target: float = C.TARGET_HZ

    @property
    def ratio(self) -> tuple[int, int]:
        f = Fraction(self.target / self.source).limit_denominator(1000)
        return f.numerator, f.denominator

    @property
    def out_len(self) -> int:
        up, down = self.ratio
        return self.chunk_len * up // down


@dataclass(frozen=True)
class RateTable:
    """Signals of several rates: a chunk spans ``chunk_sec`` seconds at each of the rates ``sources``. The rate of a
    signal is its ``sfreq`` column or that of its recording."""
    sources: tuple[float, ...]
    chunk_sec: float
    target: float = C.TARGET_HZ

    def __post_init__(self):
        for rate in (*self.sources, self.target):
            if abs(rate * self.chunk_sec - round(rate * self.chunk_sec)) > 1e-6:
                raise ValueError(f"{self.chunk_sec} s are no whole number of samples at {rate} Hz")

    def of(self, rate: float) -> Rates:
        return Rates(rate, int(round(rate * self.chunk_sec)), self.target)

    @property
    def out_len(self) -> int:
        return int(round(self.target * self.chunk_sec))

    def changes(self) -> dict[float, G.RateChange]:
        """Band-pass and resampling of every rate."""
        return {r: G.RateChange(self.of(r).chunk_len, *self.of(r).ratio, filter_and_resample_taps(self.of(r))) for r in self.sources}


def filter_and_resample_taps(rates: Rates, low: float = C.LOW_HZ, high: float = C.HIGH_HZ) -> np.ndarray:
    """Band-pass followed by the resampling filter, as one kernel at the up-sampled rate."""
    up, down = rates.ratio
    band = K.bandpass_taps(low, high, rates.source)
    spread = np.zeros((len(band) - 1) * up + 1)
    spread[::up] = band
    return np.convolve(spread, K.resample_taps(up, down))


@dataclass(frozen=True)
class CleanRecordings:
    """Cleaned ``chunks`` at the target rate, and the ``rejected`` recordings (recording_id, reason): a
    channel given twice, no weights for a bad channel, or a source of the weights missing."""
    chunks: DataFrame
    rejected: DataFrame


def _matched(rates: Rates | RateTable) -> Column:
    """The rate of the table that ``sfreq`` means, null if none."""
    known = rates.sources if isinstance(rates, RateTable) else (rates.source,)
    near = [F.when(F.abs(F.col("sfreq") - F.lit(float(r))) <= 1e-6 * r, F.lit(float(r))) for r in known]
    return F.coalesce(*near, F.lit(None).cast("double"))


def other_rates(recordings: DataFrame, rates: Rates | RateTable) -> DataFrame:
    """Recordings (recording_id, sfreq) that are not sampled at a source rate, as rejects."""
    return recordings.filter(_matched(rates).isNull()).select("recording_id", F.concat(
        F.lit("sampling rate "), F.coalesce(F.col("sfreq").cast("string"), F.lit("unknown"))).alias("reason"))


def _one_rate(rows: DataFrame) -> DataFrame:
    """recording_id, sfreq: null where the rows of a recording name several rates, or none."""
    same = F.count_distinct("sfreq") == 1
    return rows.groupBy("recording_id").agg(F.when(same, F.max("sfreq")).cast("double").alias("sfreq"))


def _with_rate(signals: DataFrame, rates: Rates | RateTable, recordings: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Signals of the source rates, for a ``RateTable`` with their sfreq, and the recordings left out."""
    if isinstance(rates, RateTable):
        if "sfreq" not in signals.columns:
            if recordings is None:
                raise ValueError("several rates need a column sfreq in the signals, or the recordings")
            signals = signals.join(_one_rate(recordings), "recording_id", "left")
        wrong = materialize(other_rates(_one_rate(signals), rates), "rates")
        kept = signals.join(wrong.select("recording_id").distinct(), "recording_id", "left_anti")
        return kept.withColumn("sfreq", _matched(rates)), wrong
    if recordings is None:
        return signals, None
    wrong = materialize(other_rates(recordings, rates), "rates")
    return signals.join(wrong.select("recording_id"), "recording_id", "left_anti"), wrong


def _weights(weights: DataFrame | GEO.Positions, present: DataFrame, bad: DataFrame, keys: list[str]) -> DataFrame:
    """Weights as given, or those that follow from positions, stored once."""
    if isinstance(weights, DataFrame):
        return weights
    return materialize(GEO.interpolation_weights(present, bad, weights, keys), "weights")


def clean_recordings(signals: DataFrame, rates: Rates | RateTable, report: DataFrame, weights: DataFrame | GEO.Positions,
                     recordings: DataFrame | None = None) -> CleanRecordings:
    """Whole recordings: band-pass and resample in one pass, replace the channels the
    report names, average reference. ``report``: recording_id, category, channel. A
    recording that cannot be cleaned is rejected; it would change the mean of all channels. With ``recordings``
    (recording_id, sfreq) those of another rate are rejected too. ``weights``: a table for ``cleaning.repair``, or the
    positions of the channels (``geometry.sphere_positions``), from which weights are solved."""
    signals, wrong = _with_rate(signals, rates, recordings)
    raw = signals.select("recording_id", "channel").distinct()
    name = CH.clean_channel(F.col("channel"))
    twice = CH.duplicate_channels(raw, name)
    present = raw.select("recording_id", name.alias("channel")).distinct()
    bad = CH.bad_channel_rows(CH.channels_to_interpolate(report, present))
    weights = _weights(weights, present, bad, ["recording_id"])
    hopeless = G.without_weights(bad, weights, present=present).join(twice, "recording_id", "left_anti")
    rejected = materialize(twice.unionByName(hopeless), "rejected")
    named = signals.withColumn("channel", name).join(rejected, "recording_id", "left_anti")
    if isinstance(rates, RateTable):
        resampled = G.resample_rates(named, rates.changes())
    else:
        resampled = G.resample(named, rates.chunk_len, *rates.ratio, filter_and_resample_taps(rates))
    stored = materialize(resampled, "resampled")
    return CleanRecordings(G.repair(stored, bad, weights), rejected if wrong is None else rejected.unionByName(wrong))


@dataclass(frozen=True)
class AnnotationRows:
    """Feature ``rows`` of the windows around labelled marks, and the recordings ``rejected`` (recording_id, reason) on the way."""
    rows: DataFrame
    rejected: DataFrame


def annotation_rows(signals: DataFrame, rates: Rates | RateTable, annotations: DataFrame, report: DataFrame, weights: DataFrame | GEO.Positions,
                    recordings: DataFrame | None = None) -> AnnotationRows:
    """One feature row per channel of every window around a labelled mark. Rejected are the recordings that
    ``clean_recordings`` rejects, and each window that raises, with its channel in the reason."""
    made = clean_recordings(signals, rates, report, weights, recordings)
    cleaned = materialize(made.chunks, "cleaned")
    lengths = W.channel_lengths(cleaned, rates.out_len).withColumn("sfreq", F.lit(rates.target))
    placed = W.annotation_windows(annotations, lengths)
    cut = W.cut_spans(cleaned, placed, rates.out_len, ["row_idx"])
    meta = placed.drop("start", "stop", "ord")
    key = ["recording_id", "row_idx"]
    good, failed = X.features_and_failures(cut, rates.target, key)
    reason = F.concat(F.lit("window "), F.col("row_idx").cast("string"), F.lit(" of "), "channel", F.lit(": "), "reason")
    return AnnotationRows(good.join(meta, key), made.rejected.unionByName(failed.select("recording_id", reason.alias("reason"))))


def annotation_features(signals: DataFrame, rates: Rates | RateTable, annotations: DataFrame, report: DataFrame,
                        weights: DataFrame) -> DataFrame:
    """The rows of ``annotation_rows``."""
    return annotation_rows(signals, rates, annotations, report, weights).rows


@dataclass(frozen=True)
class Detection:
    """Limits of the bad-channel detectors. ``flat``: largest spread of a channel without a signal;
    ``drop_out_share``: share of one-second windows without any change that a channel may have."""
    deviation: float = 5.0
    correlation: float = 0.4
    correlation_share: float = 0.01
    prediction: float = 0.75
    prediction_share: float = 0.4
    flat: float = 1e-15
    drop_out_share: float = 0.01


@dataclass(frozen=True)
class CleanCrops:
    """Padded segment crops: ``spans`` (one stored row per crop with its times and sample
    bounds), cleaned ``chunks`` at the target rate, the ``bad`` channels found, and the
    ``rejected`` crops (a channel given twice, a bad channel without weights, a source of the weights
    missing, or samples that are not finite). ``warnings``: crops where a detector raised (detector, reason); it reports
    no channel there, and the crop goes on."""
    spans: DataFrame
    chunks: DataFrame
    bad: DataFrame
    rejected: DataFrame
    warnings: DataFrame


def clean_crops(signals: DataFrame, rates: Rates | RateTable, segments: DataFrame, weights: DataFrame | GEO.Positions,
                prediction_weights: G.PredictionWeights | GEO.SubsetPredictions | None = None,
                limits: Detection = Detection(), recordings: DataFrame | None = None) -> CleanCrops:
    """Every segment on its own: crop with padding, band-pass, detect and replace bad
    channels at the source rate, average reference, resample. A crop that fails is
    rejected; the segment ids of the others do not change. With ``recordings`` (recording_id, sfreq)
    the crops of those with another rate are rejected. Signals of several rates (``RateTable``) are cleaned rate by rate, each
    detector at its own rate, and end on one grid. A crop shorter than five seconds has no window for the prediction rule;
    it is listed in the warnings."""
    signals, wrong = _with_rate(signals, rates, recordings)
    if isinstance(rates, RateTable):
        return _crops_of_rates(signals, rates, segments, weights, prediction_weights, limits, wrong)
    up, down = rates.ratio
    twice = materialize(CH.duplicate_channels(signals.select("recording_id", "channel").distinct()), "rejected")
    # names are an expression: the samples are not joined with anything
    named = signals.select("recording_id", CH.rename_channel(F.col("channel")).alias("channel"), "chunk", "x").filter(
        CH.canonical_position(F.col("channel")).isNotNull())
    n = W.channel_lengths(named, rates.chunk_len)
    ends = n.withColumn("rec_end_sec", (F.col("n_samples") - 1) / rates.source)
    sample = lambda sec: F.bround(F.col(sec) * rates.source).cast("bigint")
    known = segments.join(twice.select("recording_id"), "recording_id", "left_anti")
    spans = materialize(S.padded_crops(known, ends).withColumn("start", sample("crop_start"))
                        .withColumn("stop", sample("crop_stop") + 1)
                        .withColumn("n_out", F.ceil((F.col("stop") - F.col("start")) * up / down)), "spans")
    crops = W.cut_spans(named, spans, rates.chunk_len, ["segment_id"], rates.chunk_len)
    band = G.fir_filter(crops, rates.chunk_len, K.bandpass_taps(C.LOW_HZ, C.HIGH_HZ, rates.source), keys=CROP)
    stored = materialize(band, "filtered")
    second = int(round(rates.source))
    # channels without a signal first, then deviation and correlation; the prediction rule only sees what is left
    silent = materialize(G.silent_channels(stored, CROP, limits.flat).select(*CROP, "channel"), "silent")
    alive = stored.join(silent, [*CROP, "channel"], "left_anti")
    shares = materialize(G.correlation_share(alive, rates.chunk_len, second, CROP, limits.correlation), "correlation")
    warnings = G.detector_failures(shares, "correlation", CROP)
    found = [silent, G.bad_by_deviation(alive, CROP, limits.deviation),
             G.low_channels(shares, limits.correlation_share, CROP),
             G.drop_outs(alive, rates.chunk_len, second, CROP, limits.drop_out_share).select(*CROP, "channel")]
    if prediction_weights is not None:
        before = materialize(G.bad_union(*found, present=stored, keys=CROP), "bad-before")
        rest = stored.join(before, [*CROP, "channel"], "left_anti")
        shares = materialize(G.prediction_share(rest, rates.chunk_len, 5 * second, prediction_weights, CROP, limits.prediction),
                             "prediction")
        short = spans.filter(F.col("stop") - F.col("start") < 5 * second).select(
            *CROP, F.lit("prediction").alias("detector"), F.lit("shorter than a window of 5 s").alias("reason"))
        warnings = warnings.unionByName(G.detector_failures(shares, "prediction", CROP)).unionByName(short)
        found = [before, G.low_channels(shares, limits.prediction_share, CROP)]
    bad = materialize(G.bad_union(*found, present=stored, keys=CROP), "bad")
    present = stored.select(*CROP, "channel").distinct()
    weights = _weights(weights, present, bad, CROP)
    hopeless = materialize(G.without_weights(bad, weights, CROP, present), "hopeless")
    fixed = G.repair(stored.join(hopeless, CROP, "left_anti"), bad, weights, CROP)
    done = materialize(G.resample(fixed, rates.chunk_len, up, down, keys=CROP), "crops")
    odd = G.non_finite_channels(done, CROP).select(*CROP, "reason")
    no_names = segments.join(twice if wrong is None else twice.unionByName(wrong), "recording_id").select(*CROP, "reason")
    return CleanCrops(spans, done.join(odd, CROP, "left_anti"), bad, hopeless.unionByName(odd).unionByName(no_names),
                      warnings)


def _crops_of_rates(signals: DataFrame, table: RateTable, segments: DataFrame, weights, prediction_weights, limits: Detection,
                    wrong: DataFrame) -> CleanCrops:
    """``clean_crops`` for each rate of the table, side by side in one result."""
    rate_of = materialize(signals.select("recording_id", "sfreq").distinct(), "sfreq")
    out = None
    for rate in table.sources:
        own = segments.join(rate_of.filter(F.col("sfreq") == rate).select("recording_id"), "recording_id", "left_semi")
        one = clean_crops(signals.filter(F.col("sfreq") == rate).drop("sfreq"), table.of(rate), own, weights, prediction_weights, limits)
        out = one if out is None else CleanCrops(*[getattr(out, f.name).unionByName(getattr(one, f.name)) for f in fields(CleanCrops)])
    other = segments.join(wrong, "recording_id").select(*CROP, "reason")
    return replace(out, rejected=out.rejected.unionByName(other))


def sliding_features(crops: CleanCrops, rates: Rates | RateTable, annotations: DataFrame) -> DataFrame:
    """One feature row per channel of every sliding window inside a segment, labelled
    by the marks. Windows of the padding are not made."""
    length, stride = (int(round(s * rates.target)) for s in (C.WINDOW_SEC, C.STRIDE_SEC))
    core = S.core_bounds(crops.spans, rates.target, F.col("n_out")).select(
        *CROP, "seg_start", "seg_type", F.col("core_from").alias("start"), F.col("core_to").alias("stop"))
    inside = W.cut_spans(crops.chunks, core.select(*CROP, "start", "stop"), rates.out_len, [], rates.out_len, CROP)
    cut = W.slide_chunks(inside, rates.out_len, length, stride, [*CROP, "channel"])
    made = X.window_features(cut, rates.target)
    windows = W.sliding_windows(core, rates.target, n_samples=F.col("stop") - F.col("start"))
    labelled = W.label_windows(windows, S.marks(annotations)).select(*CROP, "s", "onset_sec", "seg_type", "label")
    return made.join(labelled, [*CROP, "s"])


def event_features(crops: CleanCrops, rates: Rates | RateTable, annotations: DataFrame) -> DataFrame:
    """One feature row per channel of the window around every mark inside a segment."""
    spans = crops.spans.drop("start", "stop")
    placed = W.event_windows(S.events_in_segments(annotations, spans), rates.target, F.col("n_out"))
    cut = W.cut_spans(crops.chunks, placed, rates.out_len, ["ord"], signal=CROP)
    meta = placed.select(*CROP, "ord", F.col("onset_sec").alias("center_sec"), "seg_type", "label")
    return X.window_features(cut, rates.target).join(meta, [*CROP, "ord"])


def feature_dataset(rows: DataFrame, recordings: DataFrame, channel_average: bool = True) -> DataFrame:
    """Extraction rows as the stored feature rows that the evaluation plans read.

    ``rows``: any of the three extractions. ``recordings``: recording_id, file_name; the patient is read off
    the name, recordings without a patient or without a name are left out (see ``unparsed_files``).
    Returns patient_id, source (the file name), row_idx (by onset over all segments of the file, from 0),
    y, time_sec, seg_type and segment_id where they exist, and the 16 features in single precision:
    averaged over the channels, or one row per channel.
    """
    timed = as_event_onset(rows).withColumnRenamed("label", "y")
    window = ["recording_id", "time_sec", *[c for c in ("segment_id", "s", "ord", "row_idx") if c in rows.columns]]
    meta = [c for c in ("seg_type", "y") if c in timed.columns]
    kept = [*window, *meta]
    data = X.channel_average(timed, kept) if channel_average else timed.select(*kept, "channel", *C.FEATURES)
    data = materialize(data.withColumnsRenamed({"row_idx": "_row"}), "windows")
    order = ["_row" if c == "row_idx" else c for c in window[1:]]
    places = data.select("recording_id", *order).distinct().withColumn("_bucket", time_bucket(F.col("time_sec"), HOUR))
    placed = add_position(places, ["recording_id"], order, "_bucket", "row_idx").drop("_bucket")
    files = patient_index(recordings.select("recording_id", "file_name")).withColumnRenamed("file_name", "source")
    out = data.join(placed, ["recording_id", *order]).join(files, "recording_id")
    columns = ["patient_id", "source", "row_idx", "y", "time_sec", *[c for c in ("segment_id", "seg_type", "channel") if c in out.columns]]
    return X.as_float(out).select(*columns, *C.FEATURES)


def dataset_counts(dataset: DataFrame) -> DataFrame:
    """patient_id, source, n_windows, n_pos, n_neg of a feature dataset."""
    return dataset.groupBy("patient_id", "source").agg(
        F.count_distinct("row_idx").alias("n_windows"), F.count_distinct(F.when(F.col("y") == 1, F.col("row_idx"))).alias("n_pos"),
        F.count_distinct(F.when(F.col("y") == 0, F.col("row_idx"))).alias("n_neg"))
