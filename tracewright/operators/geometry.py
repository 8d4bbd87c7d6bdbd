"""Weights from electrode positions: to replace bad channels, and to predict channels from random subsets.

Positions are a small parameter, {channel: (x, y, z)} with x to the right and y to the front, and not a table: a montage has some dozens of
names. Weights depend on the set of channels that a signal has. Few such sets occur, so each is solved
once and joined back to its signals.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from tracewright import constants as C
from tracewright.functions.splines import spline_weights, subset_weights

Positions = Mapping[str, tuple[float, float, float]]
WEIGHT = "struct<bad_channel:string,src_channel:string,w:double>"


def sphere_positions() -> dict[str, tuple[float, float, float]]:
    """The 19 names of the 10-20 system on the unit sphere, from its rule: steps of 18 degrees on the ring (72 degrees from the top)
    and of 36 degrees on both arcs over the top; F3, F4, P3 and P4 are half way on the great circle between their neighbours.
    Measured positions of a montage can be given instead wherever positions are a parameter."""
    def place(from_top: float, to_right: float) -> np.ndarray:     # both in degrees; 0 to the right is the front
        t, a = np.radians([from_top, to_right])
        return np.array([np.sin(t) * np.sin(a), np.sin(t) * np.cos(a), np.cos(t)])

    out = {"Cz": place(0, 0), "Fz": place(36, 0), "Pz": place(36, 180)}
    for side, left, right in ((18, "Fp1", "Fp2"), (54, "F7", "F8"), (90, "T7", "T8"), (126, "P7", "P8"), (162, "O1", "O2")):
        out[left], out[right] = place(72, -side), place(72, side)
    out["C3"], out["C4"] = place(36, -90), place(36, 90)
    for name, ring, middle in (("F3", "F7", "Fz"), ("F4", "F8", "Fz"), ("P3", "P7", "Pz"), ("P4", "P8", "Pz")):
        half = out[ring] + out[middle]
        out[name] = half / np.linalg.norm(half)
    return {c: tuple(float(v) for v in out[c]) for c in C.CANONICAL_CHANNELS}


def interpolation_weights(channels: DataFrame, bad: DataFrame, positions: Positions, keys: list[str] = ["recording_id"]) -> DataFrame:
    """keys, bad_channel, src_channel, w for the bad channels of every signal, from all its good channels with a position.

    ``channels``: keys, channel (all that the signal has); ``bad``: keys, channel. A bad channel that the signal does not have
    is ignored; one without a position, or in a signal without a good channel, gets no weights
    (``cleaning.without_weights`` lists it). The result goes into ``cleaning.repair`` as it is.
    """
    known = {c: tuple(map(float, p)) for c, p in positions.items()}

    @arrow_udf(f"array<{WEIGHT}>")
    def solve(present: pa.Array, odd: pa.Array) -> pa.Array:
        rows = []
        for have, out in zip(present.to_pylist(), odd.to_pylist()):
            sources = [c for c in have if c in known and c not in out]
            targets = [c for c in out if c in known]
            made = []
            if sources and targets:
                w = spline_weights(np.array([known[c] for c in sources]), np.array([known[c] for c in targets]))
                made = [{"bad_channel": t, "src_channel": s, "w": float(w[i, j])}
                        for i, t in enumerate(targets) for j, s in enumerate(sources)]
            rows.append(made)
        return pa.array(rows, pa.list_(pa.struct([("bad_channel", pa.string()), ("src_channel", pa.string()), ("w", pa.float64())])))

    flagged = bad.select(*keys, "channel").distinct().withColumn("_bad", F.lit(True))
    every = channels.select(*keys, "channel").distinct().join(flagged, [*keys, "channel"], "left")
    sets = every.groupBy(*keys).agg(
        F.array_sort(F.collect_list("channel")).alias("_have"),
        F.array_sort(F.collect_list(F.when(F.col("_bad"), F.col("channel")))).alias("_odd")).filter(F.size("_odd") > 0)
    solved = sets.select("_have", "_odd").distinct().withColumn("_w", solve("_have", "_odd"))
    return sets.join(solved, ["_have", "_odd"]).select(*keys, F.explode("_w").alias("_w")).select(*keys, "_w.*")


@dataclass(frozen=True)
class SubsetPredictions:
    """The prediction rule's parameter when weights come from positions: ``draws`` subsets of ``share`` of the channels that a frame has
    and that have a position, drawn by a seeded hash of (draw, name). Every channel is predicted in every draw.
    With fewer than ``least`` channels in a subset the frame raises, which the detector lists as a warning."""
    positions: tuple[tuple[str, tuple[float, float, float]], ...]
    draws: int = 50
    share: float = 0.25
    least: int = 4
    seed: int = C.RANDOM_SEED

    @staticmethod
    def of(positions: Positions, **settings) -> SubsetPredictions:
        return SubsetPredictions(tuple(sorted((c, tuple(map(float, p))) for c, p in positions.items())), **settings)

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(c for c, _ in self.positions)

    def subsets(self, names: tuple[str, ...]) -> list[list[int]]:
        """Chosen places in ``names`` for every draw."""
        size = int(round(self.share * len(names)))
        if size < self.least:
            raise ValueError(f"{size} channels in a subset, {self.least} are needed")
        by_hash = lambda draw: sorted(range(len(names)), key=lambda i: xxhash.xxh64_intdigest(f"{draw}:{names[i]}", self.seed))
        return [sorted(by_hash(draw)[:size]) for draw in range(self.draws)]

    def matrix(self, names: tuple[str, ...]) -> np.ndarray:
        """(draws, names, names) for one set of channels."""
        return _solved(self, names)


@functools.lru_cache(maxsize=256)
def _solved(rule: SubsetPredictions, names: tuple[str, ...]) -> np.ndarray:
    """A task meets the same few sets of channels in all its frames; beyond 256 sets some are solved again."""
    at = dict(rule.positions)
    return subset_weights(names, np.array([at[c] for c in names]), rule.subsets(names))
