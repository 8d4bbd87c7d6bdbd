"""Signal cleaning on chunk rows (see ``operators.windows`` for the layout).

``keys`` name one signal: the recording, or a crop of it. All shuffles are on
(keys, channel, chunk) or (keys, chunk), so no task ever sees a whole recording.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.functions import arrays as A, arrow, kernels as K
from tracewright.operators.geometry import SubsetPredictions
from tracewright.operators.windows import slide_chunks, with_context

RECORDING = ["recording_id"]
IQR_TO_SD = 0.7413           # inter-quartile range to standard deviation


def _kernel(chunk_len: int, taps, up: int, down: int) -> arrow.Kernel:
    taps = np.asarray(taps, dtype=float)
    if len(taps) % 2 == 0:
        raise ValueError("taps must have odd length")
    if chunk_len * up % down:
        raise ValueError("chunk_len * up must be a multiple of down")
    return arrow.Kernel(taps, up, down, math.ceil((len(taps) // 2) / up) + 1)


def _polyphase(chunks: DataFrame, chunk_len: int, taps, up: int, down: int, edge: str,
               keys: list[str]) -> DataFrame:
    k = _kernel(chunk_len, taps, up, down)
    ext = with_context(chunks, chunk_len, k.context, k.context, [*keys, "channel"])
    y = arrow.filter_chunk(F.col("ext"), F.col("before"), F.col("chunk") * chunk_len, F.col("own"), F.lit(0.0), {0.0: k}, edge)
    return ext.select(*keys, "channel", "chunk", y.alias("x"))


@dataclass(frozen=True)
class RateChange:
    """What signals of one rate need: the samples of a chunk, and a kernel of ``taps`` at ``up`` times the rate."""
    chunk_len: int
    up: int
    down: int
    taps: np.ndarray


def resample_rates(chunks: DataFrame, changes: dict[float, RateChange], edge: str = "reflect", keys: list[str] = RECORDING) -> DataFrame:
    """Signals of several rates to one, in one pass. Rows carry their rate in ``sfreq``, chunks span the same time at every rate, and
    ``changes`` has a rule for every rate that occurs; another rate fails the job, so list its recordings first
    (``plans.extract.other_rates``). The result is on one grid of chunks, without sfreq."""
    kernels = {float(r): _kernel(c.chunk_len, c.taps, c.up, c.down) for r, c in changes.items()}
    if len({c.chunk_len * c.up // c.down for c in changes.values()}) > 1:
        raise ValueError("chunks of the rates do not span the same time")

    def of_rate(values: dict[float, int]) -> Column:
        return F.coalesce(*[F.when(F.col("sfreq") == r, F.lit(v)) for r, v in values.items()],
                          F.raise_error(F.concat(F.lit("no rule for the rate "), F.col("sfreq").cast("string"))).cast("int"))

    lengths = of_rate({r: c.chunk_len for r, c in changes.items()})
    context = of_rate({r: k.context for r, k in kernels.items()})
    reach = max(math.ceil(k.context / changes[r].chunk_len) for r, k in kernels.items())
    named = chunks.withColumn("sfreq", F.col("sfreq").cast("double"))
    ext = with_context(named, lengths, context, context, [*keys, "sfreq", "channel"], reach)
    y = arrow.filter_chunk(F.col("ext"), F.col("before"), F.col("chunk") * lengths, F.col("own"), F.col("sfreq"), kernels, edge)
    return ext.select(*keys, "channel", "chunk", y.alias("x"))


def fir_filter(chunks: DataFrame, chunk_len: int, taps, edge: str = "reflect",
               keys: list[str] = RECORDING) -> DataFrame:
    """Zero-phase FIR: centred taps of odd length. Beyond the ends the signal is
    reflected oddly (``edge="reflect"``) or zero."""
    return _polyphase(chunks, chunk_len, taps, 1, 1, edge, keys)


def resample(chunks: DataFrame, chunk_len: int, up: int, down: int, taps=None, edge: str = "reflect",
             keys: list[str] = RECORDING) -> DataFrame:
    """Rate change by up/down. ``taps`` work at ``up`` times the input rate; give a
    band-pass there to filter and decimate in one pass. Output chunks hold
    chunk_len * up / down samples."""
    taps = K.resample_taps(up, down) if taps is None else taps
    return _polyphase(chunks, chunk_len, taps, up, down, edge, keys)


def average_reference(chunks: DataFrame, keys: list[str] = RECORDING) -> DataFrame:
    """Subtract, at every instant, the mean over the channels. One shuffle on
    (keys, chunk); a window partition holds one chunk of every channel."""
    w = Window.partitionBy(*keys, "chunk")
    mean = vector_to_array(Summarizer.metrics("mean").summary(array_to_vector("x")).over(w)["mean"])
    return (chunks.withColumn("_mean", mean)
            .withColumn("x", F.zip_with("x", "_mean", lambda v, m: v - m)).drop("_mean"))


def repair(chunks: DataFrame, bad: DataFrame, weights: DataFrame, keys: list[str] = RECORDING,
           reference: bool = True) -> DataFrame:
    """Replace bad channels by weighted sums of the others and, with ``reference``, subtract the mean over
    the channels. One shuffle of the samples, on (keys, chunk): the channels of a chunk meet in
    one row and both steps happen there.

    ``bad``: keys, channel. ``weights``: bad_set (sorted names joined by commas),
    bad_channel, src_channel, w; or, with the keys instead of bad_set, those of each signal (``geometry.interpolation_weights``). Look at ``without_weights`` first: a bad channel that has
    no weights, or of which a source is missing, is left out. A replaced channel ends where its own samples or
    those of a source end. The mean at an instant is that of the channels that have it.
    """
    parts = F.collect_list(F.struct("bad_channel", "src_channel", "w"))
    plan = (bad_sets(bad, keys).join(weights, _weight_keys(weights, keys)).groupBy(*keys).agg(parts.alias("_w"))
            .join(bad.groupBy(*keys).agg(F.collect_set("channel").alias("_bad")), keys))
    met = chunks.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(F.struct("channel", "x"))).alias("_c"))
    done = met.join(plan, keys, "left").select(*keys, "chunk", arrow.repaired_frame(
        F.col("_c.channel"), F.col("_c.x"), F.col("_bad"), F.col("_w"), reference).alias("_r"))
    return done.select(*keys, "chunk", F.explode("_r").alias("_r")).select(*keys, "_r.channel", "chunk", "_r.x")


def interpolate(chunks: DataFrame, bad: DataFrame, weights: DataFrame,
                keys: list[str] = RECORDING) -> DataFrame:
    """``repair`` without the average reference."""
    return repair(chunks, bad, weights, keys, reference=False)


def _weight_keys(weights: DataFrame, keys: list[str]) -> list[str]:
    return ["bad_set"] if "bad_set" in weights.columns else keys


def bad_sets(bad: DataFrame, keys: list[str] = RECORDING) -> DataFrame:
    """keys, bad_set: the sorted bad channels of a signal."""
    return bad.groupBy(*keys).agg(F.concat_ws(",", F.array_sort(F.collect_set("channel"))).alias("bad_set"))


def without_weights(bad: DataFrame, weights: DataFrame, keys: list[str] = RECORDING,
                    present: DataFrame | None = None) -> DataFrame:
    """Signals whose bad channels cannot all be interpolated, as rejects: one of them has no weights, or,
    with ``present`` (keys, channel), a source of the weights is not among the channels."""
    sets = bad_sets(bad, keys)
    wanted = sets.join(bad.select(*keys, "channel").distinct(), keys)
    by = _weight_keys(weights, keys)
    have = weights.select(*by, F.col("bad_channel").alias("channel")).distinct()
    lacking = wanted.join(have, [*by, "channel"], "left_anti")
    out = lacking.select(*keys, F.concat(F.lit("no weights for "), "bad_set").alias("reason")).distinct()
    if present is not None:
        sources = sets.join(weights.select(*by, F.col("src_channel").alias("channel")).distinct(), by)
        absent = sources.join(present.select(*keys, "channel").distinct(), [*keys, "channel"], "left_anti")
        named = absent.groupBy(*keys).agg(F.concat_ws(",", F.array_sort(F.collect_set("channel"))).alias("_s"))
        missing = named.select(*keys, F.concat(F.lit("no source "), "_s").alias("reason"))
        out = out.unionByName(missing.join(out.select(*keys), keys, "left_anti"))
    return out


def non_finite_channels(chunks: DataFrame, keys: list[str] = RECORDING) -> DataFrame:
    """Channels with NaN or infinite samples, one sorted list per signal."""
    odd = F.exists("x", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    return (chunks.filter(odd).groupBy(*keys)
            .agg(F.array_sort(F.collect_set("channel")).alias("channels"))
            .withColumn("reason", F.lit("non-finite samples")))


def frames(chunks: DataFrame, chunk_len: int, length: int, keys: list[str] = RECORDING) -> DataFrame:
    """Short non-overlapping windows with all channels side by side: keys, s,
    channels (sorted), data. Bounded by channels x ``length``."""
    cut = slide_chunks(chunks, chunk_len, length, length, [*keys, "channel"])
    rows = cut.groupBy(*keys, "s").agg(F.array_sort(F.collect_list(F.struct("channel", "x"))).alias("r"))
    return rows.select(*keys, "s", F.col("r")["channel"].alias("channels"), F.col("r")["x"].alias("data"))


def channel_quartiles(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Exact quartiles q1 and q3 (position n q - 1/2) of the samples of every signal in ``keys``.

    First every chunk is counted by value bucket in its own row; from these counts follow the few buckets
    that hold the ranks asked for, and only their samples are shuffled.
    """
    counts = (chunks.select(*keys, F.explode(arrow.bucket_counts(F.col("x"))).alias("_h"))
              .groupBy(*keys, F.col("_h.b").alias("b")).agg(F.sum("_h.n").alias("n")))
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("n").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("below", before).withColumn("total", F.sum("n").over(w))
    first, last = F.col("below"), F.col("below") + F.col("n") - 1

    def holds(q: float) -> Column:
        pos = F.greatest(F.col("total") * F.lit(q) - 0.5, F.lit(0.0))
        return (last >= F.floor(pos)) & (first <= F.least(F.ceil(pos), F.col("total") - 1))

    wanted = placed.filter(holds(0.25) | holds(0.75)).select(*keys, "b", "below", "total")
    # at most four buckets for a signal: they fit into one row of it
    spots = wanted.groupBy(*keys).agg(F.collect_list(F.struct("b", "below")).alias("_spots"), F.max("total").alias("total"))
    picked = chunks.join(spots, keys).select(*keys, "total", "_spots", F.explode(
        arrow.samples_in_buckets(F.col("x"), F.col("_spots.b"))).alias("_v"))
    per = picked.groupBy(*keys, "total", F.col("_v.b").alias("b"), F.col("_v.v").alias("v")).agg(
        F.count(F.lit(1)).alias("n"), F.first("_spots").alias("_spots"))
    base = F.filter("_spots", lambda s: s["b"] == F.col("b"))[0]["below"]
    inside = Window.partitionBy(*keys, "b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = per.withColumn("lo", base + F.coalesce(F.sum("n").over(inside), F.lit(0)))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("lo") <= rank) & (rank < F.col("lo") + F.col("n")), F.col("v")))

    aggs = []
    for name, q in (("q1", 0.25), ("q3", 0.75)):
        pos = F.least(F.greatest(F.col("total") * F.lit(q) - 0.5, F.lit(0.0)), (F.col("total") - 1).cast("double"))
        aggs += [at(F.floor(pos)).alias(f"{name}_lo"), at(F.ceil(pos)).alias(f"{name}_hi"), F.max(pos - F.floor(pos)).alias(f"{name}_part")]
    found = ranked.groupBy(*keys).agg(*aggs)
    return found.select(*keys, *[(F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_part")).alias(n)
                                 for n in ("q1", "q3")])


def channel_deviation(chunks: DataFrame, keys: list[str] = RECORDING) -> DataFrame:
    """Robust spread of every channel and its robust z-score among the channels."""
    spread = channel_quartiles(chunks, [*keys, "channel"]).select(
        *keys, "channel", (IQR_TO_SD * (F.col("q3") - F.col("q1"))).alias("spread"))
    # one row per signal with its channels, then back: bounded by the number of channels
    together = spread.groupBy(*keys).agg(
        F.collect_list(F.struct("channel", "spread")).alias("c"),
        F.array_sort(F.collect_list("spread")).alias("o"))
    mid, q1, q3 = (A.sorted_quantile(F.col("o"), q) for q in (0.5, 0.25, 0.75))
    rows = together.select(*keys, mid.alias("mid"), (IQR_TO_SD * (q3 - q1)).alias("sd"), F.explode("c").alias("c"))
    z = F.when(F.col("sd") > 0, F.try_divide(F.col("c.spread") - F.col("mid"), F.col("sd"))).otherwise(F.lit(0.0))
    return rows.select(*keys, "c.channel", "c.spread", z.alias("z"))


def bad_by_deviation(chunks: DataFrame, keys: list[str] = RECORDING, limit: float = 5.0) -> DataFrame:
    return channel_deviation(chunks, keys).filter(F.abs("z") > limit).select(*keys, "channel")


def silent_channels(chunks: DataFrame, keys: list[str] = RECORDING, flat: float = 1e-15) -> DataFrame:
    """Channels without a signal: keys, channel, reason ("undefined" if a sample is NaN or infinite, else
    "flat" if largest and smallest sample differ by ``flat`` at most)."""
    odd = F.exists("x", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    per = chunks.groupBy(*keys, "channel").agg(
        F.max(odd).alias("_odd"), (F.max(F.array_max("x")) - F.min(F.array_min("x"))).alias("_range"))
    reason = F.when(F.col("_odd"), "undefined").when(F.col("_range") <= flat, "flat")
    return per.select(*keys, "channel", reason.alias("reason")).filter(F.col("reason").isNotNull())


def drop_outs(chunks: DataFrame, chunk_len: int, length: int, keys: list[str] = RECORDING, share: float = 0.01) -> DataFrame:
    """Channels whose signal stands still in more than ``share`` of the windows of ``length``
    samples: keys, channel, flat_share."""
    cut = slide_chunks(chunks, chunk_len, length, length, [*keys, "channel"])
    still = F.when(F.array_max("x") == F.array_min("x"), F.lit(1.0)).otherwise(F.lit(0.0))
    return cut.groupBy(*keys, "channel").agg(F.avg(still).alias("flat_share")).filter(F.col("flat_share") > share)


def _per_channel(framed: DataFrame, score: Column, keys: list[str]) -> DataFrame:
    """One row per channel and frame: r, or the error of the frame for all its channels."""
    scored = framed.withColumn("_r", score).withColumn("error", F.col("_r.error")).withColumn(
        "r", F.coalesce("_r.value", F.array().cast("array<double>")))              # zipped with nulls then
    return scored.select(*keys, "s", "error", F.explode(F.arrays_zip("channels", "r")).alias("e")).select(
        *keys, "s", F.col("e.channels").alias("channel"), F.col("e.r").alias("r"), "error")


def _low_share(scores: DataFrame, limit: float, keys: list[str]) -> DataFrame:
    """keys, channel, low_share; null where a frame with the channel raised, with its error."""
    low = F.when(F.isnan("r") | (F.col("r") >= limit), F.lit(0.0)).otherwise(F.lit(1.0))
    each = scores.groupBy(*keys, "channel").agg(F.avg(low).alias("low_share"), F.max("error").alias("error"))
    return each.withColumn("low_share", F.when(F.col("error").isNull(), F.col("low_share")))


def low_channels(shares: DataFrame, share: float, keys: list[str] = RECORDING) -> DataFrame:
    """Channels above the share; those of a frame that raised are not reported, see ``detector_failures``."""
    return shares.filter(F.col("low_share") > share).select(*keys, "channel")


def detector_failures(shares: DataFrame, detector: str, keys: list[str] = RECORDING) -> DataFrame:
    """keys, detector, reason: a warning for every item where the detector raised."""
    return (shares.filter(F.col("error").isNotNull()).groupBy(*keys).agg(F.max("error").alias("reason"))
            .select(*keys, F.lit(detector).alias("detector"), "reason"))


def correlation_share(chunks: DataFrame, chunk_len: int, length: int, keys: list[str] = RECORDING,
                      limit: float = 0.4, q: float = 0.98) -> DataFrame:
    """Share of windows in which a channel's best correlation stays under ``limit``.
    The correlations of a window are computed inside its row, not as pairs of rows."""
    framed = frames(chunks, chunk_len, length, keys)
    return _low_share(_per_channel(framed, arrow.frame_best_correlation(F.col("data"), q), keys), limit, keys)


def bad_by_correlation(chunks: DataFrame, chunk_len: int, length: int, keys: list[str] = RECORDING,
                       limit: float = 0.4, share: float = 0.01) -> DataFrame:
    return low_channels(correlation_share(chunks, chunk_len, length, keys, limit), share, keys)


@dataclass(frozen=True)
class PredictionWeights:
    """A parameter of the prediction rule, like filter taps: ``values`` has one (names x names) matrix of
    weights per draw; a row holds what the other channels contribute to a channel."""
    names: tuple[str, ...]
    values: np.ndarray

    def matrix(self, names: tuple[str, ...]) -> np.ndarray:
        """(draws, names, names) for the channels of a frame; channels that are absent weigh nothing."""
        pick = [self.names.index(c) for c in names]
        return self.values[:, pick][:, :, pick]

    @staticmethod
    def of(rows: Iterable[tuple[int, str, str, float]]) -> PredictionWeights:
        """From (draw, channel, source channel, weight)."""
        rows = list(rows)
        names = sorted({x for r in rows for x in r[1:3]})
        draws = sorted({r[0] for r in rows})
        values = np.zeros((len(draws), len(names), len(names)))
        for draw, channel, source, w in rows:
            values[draws.index(draw), names.index(channel), names.index(source)] += w
        return PredictionWeights(tuple(names), values)


def prediction_share(chunks: DataFrame, chunk_len: int, length: int, weights: PredictionWeights | SubsetPredictions,
                     keys: list[str] = RECORDING, limit: float = 0.75) -> DataFrame:
    """Share of windows in which a channel disagrees with the median of its
    predictions from channel subsets. Channels without weights get no score and count as good. ``weights`` are given
    (``PredictionWeights``) or solved from positions for the channels of each frame (``SubsetPredictions``)."""
    score = arrow.frame_prediction_correlation(F.col("channels"), F.col("data"), list(weights.names), weights.matrix)
    return _low_share(_per_channel(frames(chunks, chunk_len, length, keys), score, keys), limit, keys)


def bad_by_prediction(chunks: DataFrame, chunk_len: int, length: int, weights: PredictionWeights | SubsetPredictions,
                      keys: list[str] = RECORDING, limit: float = 0.75, share: float = 0.4) -> DataFrame:
    return low_channels(prediction_share(chunks, chunk_len, length, weights, keys, limit), share, keys)


def bad_union(*found: DataFrame, present: DataFrame, keys: list[str] = RECORDING) -> DataFrame:
    """Channels any detector reported and the signal really has."""
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    return every.distinct().join(present.select(*keys, "channel").distinct(), [*keys, "channel"], "left_semi")
