"""Arrow list columns as flat numpy arrays, and the batch functions built on them."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import arrow_udf

from tracewright import constants as C
from tracewright.functions import kernels as K
from tracewright.functions.guarded import value_or_error

_SCORES = "struct<value:array<double>,error:string>"
FEATURE_STRUCT = "struct<" + ",".join(f"{f}:double" for f in C.FEATURES) + ">"


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and row offsets of a list array without nulls."""
    offsets = lists.offsets.to_numpy()
    values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return values, offsets - offsets[0]


def to_lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    values = np.concatenate(rows) if rows else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.float64()))


def _same_shape_groups(offsets: np.ndarray, fs: np.ndarray):
    """Row numbers grouped by window length and rate; normally one group."""
    shape = np.stack([np.diff(offsets).astype(float), fs], axis=1)
    for key in np.unique(shape, axis=0):
        yield np.nonzero((shape == key).all(axis=1))[0], int(key[0]), float(key[1])


def _rows(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray, length: int) -> np.ndarray:
    if len(rows) == len(offsets) - 1:
        return values.reshape(len(rows), length)
    return values[offsets[rows][:, None] + np.arange(length)]


def _rate(fs: Column | float) -> Column:
    return fs if isinstance(fs, Column) else F.lit(float(fs))


def window_feature_struct(x: Column, fs: Column | float) -> Column:
    """The 16 features of a window as a struct. A window without samples gives null fields."""
    @arrow_udf(FEATURE_STRUCT)
    def run(x: pa.Array, fs: pa.Array) -> pa.Array:
        return _feature_rows(x, fs)
    return run(x, _rate(fs))


def _feature_rows(x: pa.Array, fs: pa.Array) -> pa.Array:
    values, offsets = flat(x)
    out = np.full((len(x), len(C.FEATURES)), np.nan)
    for rows, length, rate in _same_shape_groups(offsets, fs.to_numpy(zero_copy_only=False)):
        if length:
            out[rows] = K.all_features(_rows(values, offsets, rows, length), rate)
    return pa.StructArray.from_arrays([pa.array(c) for c in out.T], names=C.FEATURES)


def window_features_or_error(x: Column, fs: Column | float) -> Column:
    """(value, error) of every window: the features as a struct, or what the window raised."""
    kind = pa.struct([(f, pa.float64()) for f in C.FEATURES])

    @arrow_udf(f"struct<value:{FEATURE_STRUCT},error:string>")
    def run(x: pa.Array, fs: pa.Array) -> pa.Array:
        return value_or_error(_feature_rows, [x, fs], kind)
    return run(x, _rate(fs))


def welch_psd(x: Column, fs: Column | float) -> Column:
    """One-sided PSD; bin k lies at k * fs / min(256, size) Hz."""
    @arrow_udf("array<double>")
    def run(x: pa.Array, fs: pa.Array) -> pa.Array:
        values, offsets = flat(x)
        out: list = [np.empty(0)] * len(x)
        for rows, length, rate in _same_shape_groups(offsets, fs.to_numpy(zero_copy_only=False)):
            if length:
                for r, p in zip(rows, K.welch(_rows(values, offsets, rows, length), rate)[1]):
                    out[r] = p
        return to_lists(out)
    return run(x, _rate(fs))


def psd_step(x: Column, fs: Column | float) -> Column:
    return _rate(fs) / F.least(F.size(x), F.lit(256))


class Kernel(NamedTuple):
    """Centred taps at ``up`` times the input rate, every ``down``-th output kept, and the context in input samples."""
    taps: np.ndarray
    up: int
    down: int
    context: int


def filter_chunk(ext: Column, before: Column, start: Column, own: Column, rate: Column,
                 kernels: dict[float, Kernel], edge: str) -> Column:
    """Polyphase filter of one chunk with its context by the kernel of its rate; see ``kernels.polyphase``."""
    @arrow_udf("array<double>")
    def run(ext: pa.Array, before: pa.Array, start: pa.Array, own: pa.Array, rate: pa.Array) -> pa.Array:
        values, offsets = flat(ext)
        spectra = {r: {} for r in kernels}
        out = []
        for i, (b, s, n, r) in enumerate(zip(*(c.to_pylist() for c in (before, start, own, rate)))):
            k = kernels[r]
            x = values[offsets[i]:offsets[i + 1]]
            x = K.extend_edges(x, k.context - b, k.context - (len(x) - b - n), edge)
            out.append(K.polyphase(x, k.context, s, n, k.taps, k.up, k.down, spectra[r]))
        return to_lists(out)
    return run(ext, before, start, own, rate)


def _frames(data: pa.Array):
    """Each row's list of equal-length channel arrays as a matrix."""
    outer = data.offsets.to_numpy()
    values, inner = flat(data.flatten())
    outer = outer - outer[0]
    for a, b in zip(outer[:-1], outer[1:]):
        yield values[inner[a]:inner[b]].reshape(b - a, -1)


def frame_best_correlation(data: Column, q: float) -> Column:
    """Per channel of a frame (array of channel arrays) the q-quantile of its
    absolute correlation with the other channels: (value, error), one of them null."""
    def scores(data: pa.Array) -> pa.Array:
        return to_lists([K.best_correlation(m, q) for m in _frames(data)])

    @arrow_udf(_SCORES)
    def run(data: pa.Array) -> pa.Array:
        return value_or_error(scores, [data], pa.list_(pa.float64()))
    return run(data)


def frame_prediction_correlation(channels: Column, data: Column, names: list[str],
                                 weights_of: Callable[[tuple[str, ...]], np.ndarray]) -> Column:
    """Per channel of a frame its correlation with the median prediction. ``weights_of`` gives
    (predictions, present, present) for those of ``names`` that a frame has; its other channels
    get NaN. Gives (value, error), one of them null."""
    have = set(names)

    def scores(channels: pa.Array, data: pa.Array) -> pa.Array:
        out = []
        for present, m in zip(channels.to_pylist(), _frames(data)):
            known = [i for i, c in enumerate(present) if c in have]
            score = np.full(len(present), np.nan)
            if known:
                score[known] = K.prediction_correlation(m[known], weights_of(tuple(present[i] for i in known)))
            out.append(score)
        return to_lists(out)

    @arrow_udf(_SCORES)
    def run(channels: pa.Array, data: pa.Array) -> pa.Array:
        return value_or_error(scores, [channels, data], pa.list_(pa.float64()))
    return run(channels, data)


def repaired_frame(channels: Column, data: Column, bad: Column, weights: Column, reference: bool) -> Column:
    """Array of (channel, x) of one chunk: the ``bad`` channels replaced by the ``weights``
    (bad_channel, src_channel, w) of the others, then the mean over the channels subtracted."""
    @arrow_udf("array<struct<channel:string,x:array<double>>>")
    def run(channels: pa.Array, data: pa.Array, bad: pa.Array, weights: pa.Array) -> pa.Array:
        outer = data.offsets.to_numpy()
        values, inner = flat(data.flatten())
        outer = outer - outer[0]
        names, parts, sizes = [], [], []
        for i, (present, odd, w) in enumerate(zip(channels.to_pylist(), bad.to_pylist(), weights.to_pylist())):
            x = {c: values[inner[k]:inner[k + 1]] for c, k in zip(present, range(outer[i], outer[i + 1]))}
            fixed = K.replace_channels(x, set(odd or ()), [(p["bad_channel"], p["src_channel"], p["w"]) for p in w or ()])
            if reference:
                fixed = K.subtract_mean(fixed)
            names += list(fixed)
            parts += list(fixed.values())
            sizes.append(len(fixed))
        rows = pa.StructArray.from_arrays([pa.array(names, pa.string()), to_lists(parts)], names=["channel", "x"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), rows)
    return run(channels, data, bad, weights)


def bucket_counts(x: Column) -> Column:
    """Array of (b, n): how many samples of a chunk lie in each value bucket (see ``kernels.value_buckets``)."""
    @arrow_udf("array<struct<b:bigint,n:bigint>>")
    def run(x: pa.Array) -> pa.Array:
        values, offsets = flat(x)
        found = [np.unique(K.value_buckets(v[~np.isnan(v)]), return_counts=True) for v in np.split(values, offsets[1:-1])]
        return _structs([f[0] for f in found], ["b", "n"], [np.concatenate([np.empty(0, np.int64), *(f[i] for f in found)])
                                                           for i in (0, 1)])
    return run(x)


def samples_in_buckets(x: Column, buckets: Column) -> Column:
    """Array of (b, v): the samples of a chunk that lie in one of the buckets."""
    @arrow_udf("array<struct<b:bigint,v:double>>")
    def run(x: pa.Array, buckets: pa.Array) -> pa.Array:
        values, offsets = flat(x)
        kept, codes = [], []
        for v, wanted in zip(np.split(values, offsets[1:-1]), buckets.to_pylist()):
            v = v[~np.isnan(v)]
            b = K.value_buckets(v)
            on = np.isin(b, wanted)
            kept.append(v[on])
            codes.append(b[on])
        return _structs(kept, ["b", "v"], [np.concatenate([np.empty(0, np.int64), *codes]), np.concatenate([np.empty(0), *kept])])
    return run(x, buckets)


def _structs(rows: list[np.ndarray], names: list[str], columns: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(c) for c in columns], names=names))
