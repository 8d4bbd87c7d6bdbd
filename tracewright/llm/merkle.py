"""Merkle manifest of a table: one tree of eight children a node for each language, and one over their roots.

Nodes are logged in the order in which they are completed (postorder): a leaf, then every node whose last
child has just been written; runs that are still open close at the end. The position of a node in
the log of its tree follows from the number of leaves below and before it alone (``position``), so siblings are
addressed without pointers or an index.

A tree is built by aligned builders: each takes 512 consecutive leaves and writes the log of their subtree, three
levels high; the roots of those subtrees are the leaves of the next tier. A language of any
size is spread over its builders, and one segment is all that a task holds. Proofs go down again: the path above a segment
is extracted once for all its leaves, the path inside it by position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tracewright.llm.common import ranked
from tracewright.plans.tables import materialize

FAN = 8
LEVELS = 3
SPAN = FAN ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_SIZE = 32
_SEGMENT = ("key string, block long, blocks long, doc_ids array<string>, changed array<string>, "
            "levels int, log binary, top string")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def nodes_before(leaves: int) -> int:
    """Nodes that are complete once so many leaves are written, with more to come."""
    total = 0
    while leaves:
        total += leaves
        leaves //= FAN
    return total


def position(level: int, index: int, leaves: int) -> int:
    """Place in the completion order of node ``index`` of a level, in a tree of so many leaves. The node is
    written right after its last leaf and the nodes of the levels between."""
    return nodes_before(min((index + 1) * FAN ** level, leaves) - 1) + level


def height(leaves: int) -> int:
    levels = 0
    while FAN ** levels < leaves:
        levels += 1
    return levels


def append_log(leaves: list[str], levels: int) -> list[str]:
    """All nodes above and with these leaves in completion order, up to a level with a single node."""
    log: list[str] = []
    open_runs: list[list[str]] = [[] for _ in range(levels + 1)]

    def write(node: str, level: int) -> None:
        log.append(node)
        open_runs[level].append(node)

    for leaf in leaves:
        write(leaf, 0)
        level = 0
        while level < levels and len(open_runs[level]) == FAN:
            run, open_runs[level] = open_runs[level], []
            level += 1
            write(digest(run), level)
    for level in range(levels):
        if open_runs[level]:
            write(digest(open_runs[level]), level + 1)
    return log


def runs_of(log: list[str], leaves: int, levels: int, leaf: int) -> list[tuple[int, list[str]]]:
    """For every level of a segment the run that holds the leaf or the node above it, and its place there."""
    out, count, index = [], leaves, leaf
    for level in range(levels):
        first = index - index % FAN
        run = [log[position(level, i, leaves)] for i in range(first, min(first + FAN, count))]
        out.append((index - first, run))
        count, index = -(-count // FAN), index // FAN
    return out


def _step(place: int, run: list[str]) -> str:
    """One level of a proof as text: the place, then the others of the run."""
    return f"{place}{''.join(run[:place])}{''.join(run[place + 1:])}"


def fold(leaf: str, path: list[str]) -> str:
    """The root that follows from a leaf and its proof."""
    node = leaf
    for step in path:
        cut = 1 + 64 * int(step[0])
        node = hashlib.sha256((step[1:cut] + node + step[cut:]).encode()).hexdigest()
    return node


def _unpack(raw: bytes) -> list[str]:
    text = raw.hex()
    return [text[i:i + 2 * _SIZE] for i in range(0, len(text), 2 * _SIZE)]


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: dict[str, Column]) -> Column:
    """SHA-256 of the fields, each ``-`` if null, else its length in UTF-8, a colon and the value."""
    return F.sha2(F.concat(*[_field(columns[c]) for c in FIELDS]), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


@dataclass(frozen=True)
class Manifest:
    """``tiers`` are the segments of the languages' trees from the leaves up, ``top`` those of the tree over the languages:
    key, block (number of the segment), blocks (of that tier), doc_ids, changed, levels, log (digests in completion
    order), top (the last one)."""
    tiers: list[DataFrame]
    top: list[DataFrame]


def _segments(nodes: DataFrame) -> DataFrame:
    """One row for each aligned block of ``nodes`` (key, i, n, doc_id, changed, h)."""
    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("i")
        blocks = -(-int(group["n"].iloc[0]) // SPAN)
        levels = LEVELS if blocks > 1 else height(len(group))
        log = append_log(group["h"].tolist(), levels)
        ids, changed = ([None if pd.isna(x) else x for x in group[c]] for c in ("doc_id", "changed"))
        return pd.DataFrame({"key": group["key"].iloc[:1], "block": group["block"].iloc[:1], "blocks": [blocks],
                             "doc_ids": [ids], "changed": [changed], "levels": [levels],
                             "log": [bytes.fromhex("".join(log))], "top": [log[-1]]})

    return nodes.withColumn("block", F.expr(f"i div {SPAN}")).groupBy("key", "block").applyInPandas(build, _SEGMENT)


def _grow(nodes: DataFrame) -> list[DataFrame]:
    tiers = []
    while True:
        segments = materialize(_segments(nodes), "merkle-segments")
        tiers.append(segments)
        none = F.lit(None).cast("string")
        nodes = segments.filter("blocks > 1").select("key", F.col("block").alias("i"), F.col("blocks").alias("n"),
                                                     none.alias("doc_id"), none.alias("changed"), F.col("top").alias("h"))
        if nodes.isEmpty():
            return tiers


def _roots(tiers: list[DataFrame]) -> DataFrame:
    out = None
    for t in tiers:
        part = t.filter("blocks = 1").select("key", "top")
        out = part if out is None else out.union(part)
    return out


def build(docs: DataFrame, tampered: Column | None = None) -> Manifest:
    """Manifest of all rows of ``docs`` (doc_id, source, lang, n_chars, text).

    Leaves ascend by doc_id inside their language, null first, rows with one id by their digest; repeated rows are
    leaves of their own. The null language is the first. ``tampered`` marks rows whose digest is
    also taken of a text with A-Z in lower case (``changed``). An empty table has no segment; other columns are ignored.
    """
    columns = {c: F.col(c) for c in FIELDS}
    other = leaf_digest(columns | {"text": lower_ascii(F.col("text"))})
    none = F.lit(None).cast("string")
    leaves = docs.select(
        F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang").cast("string"))).alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(columns).alias("h"),
        (none if tampered is None else F.when(tampered, other)).alias("changed"),
        F.monotonically_increasing_id().alias("seq"))
    placed = ranked(materialize(leaves, "merkle-leaves"), ["key"], ["doc_id", "h", "seq"])
    tiers = _grow(placed.select("key", "i", "n", F.col("doc_id").cast("string").alias("doc_id"), "changed", "h"))
    languages = _roots(tiers).select(F.lit("").alias("key"), F.col("key").alias("doc_id"), F.col("top").alias("h"))
    placed = ranked(languages, ["key"], ["doc_id"])
    return Manifest(tiers, _grow(placed.select("key", "i", "n", "doc_id", none.alias("changed"), "h")))


def _with_paths(tiers: list[DataFrame], start: DataFrame | None) -> DataFrame:
    """The lowest segments with ``above`` (the proof of their root) and ``ends`` (the roots it passes). ``start``
    has them for the roots of the trees; none: these are the last roots."""
    def children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                log, n = _unpack(r.log), len(r.doc_ids)
                paths = [[_step(*x) for x in runs_of(log, n, r.levels, j)] + list(r.above) for j in range(n)]
                yield pd.DataFrame({"key": r.key, "block": [r.block * SPAN + j for j in range(n)], "above": paths,
                                    "ends": [list(r.ends)] * n})

    empty = F.array().cast("array<string>")
    found = None
    for t in reversed(tiers):
        last = t.filter("blocks = 1")
        if start is None:
            last = last.withColumn("above", empty).withColumn("ends", F.array("top"))
        else:
            last = last.join(start, "key").withColumn("ends", F.concat(F.array("top"), "ends"))
        rows = last if found is None else last.unionByName(t.filter("blocks > 1").join(found, ["key", "block"]))
        if t is not tiers[0]:
            found = rows.mapInPandas(children, "key string, block long, above array<string>, ends array<string>")
    return rows


def _addressed(manifest: Manifest) -> DataFrame:
    """The segments of leaves with the whole path above them."""
    def languages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                log, n = _unpack(r.log), len(r.doc_ids)
                paths = [[_step(*x) for x in runs_of(log, n, r.levels, j)] + list(r.above) for j in range(n)]
                yield pd.DataFrame({"key": list(r.doc_ids), "above": paths, "ends": [list(r.ends)] * n})

    start = _with_paths(manifest.top, None).mapInPandas(languages, "key string, above array<string>, ends array<string>")
    return _with_paths(manifest.tiers, materialize(start, "merkle-languages"))


def proofs(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, path (for each level the place in the run and the digests of the others), subroot, root."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                log, n = _unpack(r.log), len(r.doc_ids)
                yield pd.DataFrame({
                    "doc_id": list(r.doc_ids), "leaf": [log[position(0, j, n)] for j in range(n)],
                    "path": [[_step(*x) for x in runs_of(log, n, r.levels, j)] + list(r.above) for j in range(n)],
                    "subroot": r.ends[0], "root": r.ends[1]})

    out = _addressed(manifest).mapInPandas(
        work, "doc_id string, leaf string, path array<string>, subroot string, root string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def log_rows(manifest: Manifest) -> DataFrame:
    """The logs of the languages as rows: key, position, level, digest."""
    def rows_of(tier: int, leaves: DataFrame) -> DataFrame:
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.itertuples(index=False):
                    log, n, rows = _unpack(r.log), len(r.doc_ids), []
                    for level in range(1 if tier else 0, r.levels + 1):
                        first = r.block * FAN ** (LEVELS - level)
                        for i in range(-(-n // FAN ** level)):
                            at = position(level + LEVELS * tier, first + i, r.total)
                            rows.append((r.key, at, level + LEVELS * tier, log[position(level, i, n)]))
                    yield pd.DataFrame(rows, columns=["key", "position", "level", "digest"])

        return manifest.tiers[tier].join(leaves, "key").mapInPandas(
            work, "key string, position long, level int, digest string")

    leaves = manifest.tiers[0].groupBy("key").agg(F.sum(F.size("doc_ids")).alias("total"))
    out = rows_of(0, leaves)
    for tier in range(1, len(manifest.tiers)):
        out = out.union(rows_of(tier, leaves))
    return out


def audit(docs: DataFrame, tampered: Column) -> DataFrame:
    """Every row of ``docs`` with its place in the manifest checked: doc_id, leaf, subroot, root, proof_sha256 (digest
    of the proof's siblings), folded_root (from the changed leaf of a tampered row, else from its own) and
    verified. See ``build`` for nulls, ties, repeated rows and empty tables."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                log, n, rows = _unpack(r.log), len(r.doc_ids), []
                subroot, root = r.ends
                above = "".join(s[1:] for s in r.above)
                for j in range(n):
                    path = [_step(*x) for x in runs_of(log, n, r.levels, j)]
                    leaf = log[position(0, j, n)]
                    own = "".join([s[1:] for s in path]) + above
                    folded = fold(r.changed[j] or leaf, [*path, *r.above])
                    rows.append((r.doc_ids[j], leaf, subroot, root, hashlib.sha256(own.encode()).hexdigest(), folded,
                                 folded == root))
                yield pd.DataFrame(rows, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                                                  "verified"])

    out = _addressed(build(docs, tampered)).mapInPandas(
        work, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
              "verified boolean")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
