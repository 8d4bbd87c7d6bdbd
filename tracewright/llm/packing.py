"""Best-fit packing of documents into fixed-length sequences under several capacities."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tracewright.llm.tokens import encoder
from tracewright.plans.tables import materialize

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
GROUP_ITEMS = 16_384


@dataclass(frozen=True)
class Capacity:
    """What a sequence may hold, and how much each residual counts in the choice of a
    bin. The attention cost of a piece is the square of its length."""
    tokens: int = 4096
    documents: int = 4096
    attention: float = 4096.0 ** 2
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"                      # or "dot"

    def limits(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], float)


def cut_pieces(docs: DataFrame, vocabulary: str, end_id: int = 1, length: int = 4096,
               with_ids: bool = False) -> DataFrame:
    """Token ids of every whole text with ``end_id`` appended, cut into pieces of ``length``
    where longer. Null texts count as empty; repeated rows are kept. ``with_ids``
    adds the ids of each piece as an array."""
    schema = PIECES + (", ids array<long>" if with_ids else "")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        step = 4 * length
        for batch in batches:
            rows, keys = [], []
            for key, coded in zip(batch["doc_id"], coder.encode(batch["text"].tolist())):
                coded += end
                for k, at in enumerate(range(0, len(coded), step)):
                    part = coded[at:at + step]
                    rows.append((k, k * length, len(part) // 4, zlib.crc32(part)))
                    keys.append((key, np.frombuffer(part, "<u4").astype(np.int64) if with_ids else None))
            out = pd.DataFrame(rows, columns=["piece", "start", "length", "ids_crc32"])
            out.insert(0, "doc_id", pd.array([None if pd.isna(k) else k for k, _ in keys], "Int64"))
            if with_ids:
                out["ids"] = [x for _, x in keys]
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, schema)


def vector_best_fit(sizes: np.ndarray, capacity: Capacity) -> np.ndarray:
    """Bin number of every item (rows of tokens, documents, attention), items taken in the
    given order. Of the open bins that can take the item under every limit, the one
    with the smallest weighted norm of what would be left ("norm") or the
    largest weighted product of item and residual ("dot") is chosen; ties go to the oldest bin. An
    item that exceeds a limit by itself gets its own bin."""
    limits, weight = capacity.limits(), np.array(capacity.weights)
    scaled = sizes / limits
    smallest = np.minimum.accumulate(scaled[::-1], axis=0)[::-1]    # of what is still to come
    free = np.empty((1024, 3))
    number = np.empty(1024, np.int64)
    used, made = 0, 0
    out = np.empty(len(sizes), np.int64)
    slack = 1e-12
    for i, item in enumerate(scaled):
        left = free[:used] - item
        fits = (left >= -slack).all(axis=1)
        at = -1
        if fits.any():
            if capacity.rule == "dot":
                score = np.where(fits, -(free[:used] * (item * weight)).sum(axis=1), np.inf)
            else:
                score = np.where(fits, (left * left * weight).sum(axis=1), np.inf)
            at = int(np.argmin(score))
        if at < 0:
            if used == len(free):
                free, number = np.concatenate([free, free]), np.concatenate([number, number])
            free[used], number[used], at = 1.0, made, used
            used, made = used + 1, made + 1
        free[at] -= item
        out[i] = number[at]
        if i % 256 == 255 and i + 1 < len(sizes):        # bins that nothing to come can enter
            keep = (free[:used] >= smallest[i + 1] - slack).all(axis=1)
            free[:keep.sum()], number[:keep.sum()] = free[:used][keep], number[:used][keep]
            used = int(keep.sum())
    return out


def pack(pieces: DataFrame, capacity: Capacity = Capacity(), group_items: int = GROUP_ITEMS) -> DataFrame:
    """Add sequence_id and offset to the pieces (doc_id, piece, length, ...), which should be a stored table.

    Pieces are dealt by a hash of their number in the table (ids may be null or repeat) into groups of about ``group_items``; each group is packed in
    one task, longest pieces first. Groups share no bins, which costs about one partly
    filled sequence per group. Pieces of one document may lie in different sequences.
    """
    total = pieces.count()
    groups = max(1, -(-total // group_items))
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable",
                                ignore_index=True)
        length = part["length"].to_numpy(np.float64)
        bins = vector_best_fit(np.column_stack([length, np.ones(len(part)), length ** 2]), capacity)
        group = int(part["_group"].iloc[0])
        part["sequence_id"] = bins * groups + group
        part["offset"] = part.groupby("sequence_id", sort=False)["length"].cumsum() - part["length"]
        return part.drop(columns="_group")

    grouped = pieces.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    return grouped.groupBy("_group").applyInPandas(fill, schema)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: Capacity = Capacity(),
                   with_ids: bool = False) -> DataFrame:
    """Documents (doc_id, text) to packed pieces: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. Every token of every document is in exactly one place; a document
    is cut only if it is longer than a sequence. An empty table gives an empty result."""
    pieces = materialize(cut_pieces(docs, vocabulary, end_id, capacity.tokens, with_ids), "pieces")
    return pack(pieces, capacity)
