"""SimHash fingerprints and a meet-in-the-middle join of their Hamming balls.

Every distinct fingerprint is sent out with all variants within half the radius. Two
fingerprints within the radius share a variant, and a variant is shared by no more
fingerprints than its own ball holds (65 for 64 bits and radius 2), however many documents
there are: documents with equal fingerprints are one class before anything is sent out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tracewright.llm.common import words
from tracewright.llm.components import connected_components
from tracewright.plans.tables import materialize

SEED = 42
_CHUNK = 1 << 16


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of all word shingles of the whole text, repeats included. Fewer words: one
    shingle of them all; no word: none."""
    ws = words(text)
    if not ws:
        return np.zeros(0, np.uint64)
    joined = b" ".join(ws)
    digest = xxhash.xxh64_digest
    if len(ws) <= size:
        raw = digest(joined, SEED)
    else:
        ends = np.cumsum([len(w) + 1 for w in ws]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        raw = b"".join([digest(joined[a:b], SEED)
                        for a, b in zip(starts[:len(ws) - size + 1].tolist(), ends[size - 1:].tolist())])
    return np.frombuffer(raw, ">u8").astype(np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """Bits (0/1) that more than half of the hashes have set; ``hashes`` has one row per shingle and one
    column per 64 bits. Bit i of a word is the one of value 2**i."""
    total = np.zeros(64 * hashes.shape[1], np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = np.ascontiguousarray(hashes[i:i + _CHUNK]).view(np.uint8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return (2 * total > len(hashes)).astype(np.uint8)


def fingerprint(text: str | None, size: int) -> int:
    """64-bit SimHash as a signed number."""
    bits = majority(shingle_hashes(text, size)[:, None])
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp of every row. A text without words has fingerprint 0."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"),
                                "fp": [fingerprint(t, size) for t in batch["text"]]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(work, "doc_id long, fp long")


def ball(fp: Column, bits: int, reach: int) -> Column:
    """Array of all values that differ from ``fp`` in at most ``reach`` of its low ``bits`` bits."""
    masks = [0]
    for k in range(1, reach + 1):
        masks += [sum(1 << i for i in c) for c in combinations(range(bits), k)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    return F.array(*[fp.bitwiseXOR(F.lit(m).cast("long")) for m in signed])


def ball_links(values: DataFrame, bits: int = 64, radius: int = 2, keys: tuple[str, ...] = ()) -> DataFrame:
    """Links between the distinct ``fp`` values (with the same ``keys``, if given): keys, a, b with a < b and distance
    at most ``radius``; every linked pair is joined by a path of links, and pairs that meet
    in the middle at several variants appear once.

    The values that share a variant are all within the radius of each other when it is even; each
    is verified against the smallest one, and any that fails (odd radius) against the rest.
    """
    reach = (radius + 1) // 2
    sent = values.select(*keys, "fp", F.explode(ball(F.col("fp"), bits, reach)).alias("variant"))
    met = (sent.groupBy(*keys, "variant").agg(F.collect_list("fp").alias("fps"))     # at most one ball
           .filter(F.size("fps") > 1).select(*keys, F.array_sort("fps").alias("fps")))
    if radius % 2:
        pairs = met.select(*keys, F.explode("fps").alias("a"), "fps").select(*keys, "a", F.explode("fps").alias("b"))
    else:
        rest = F.slice("fps", F.lit(2), F.size("fps"))
        pairs = met.select(*keys, F.element_at("fps", 1).alias("a"), F.explode(rest).alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    return pairs.filter((F.col("a") < F.col("b")) & near).distinct()


def components(docs: DataFrame, size: int = 3, bits: int = 64, radius: int = 2) -> DataFrame:
    """Every row with its fingerprint (16 hex digits) and component_id: the smallest doc_id that can be
    reached over links, its own included.

    Null and empty texts have fingerprint zero and are linked like any other. A row with a null id
    takes part; its component_id is null only if no row it reaches has an id. Repeated
    rows share a fingerprint. An empty table gives an empty result; other columns are ignored.
    """
    rows = materialize(fingerprints(docs, size), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    found = connected_components(ball_links(classes, bits, radius), "links")
    groups = classes.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component"))
    least = groups.groupBy("component").agg(F.min("first").alias("component_id"))
    label = groups.join(least, "component").select(F.col("fp").alias("_fp"), "component_id")
    out = rows.join(label, F.col("fp") == F.col("_fp"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
