"""Lines that several documents hold stay only in the first of them.

Lines are hashed (128 bits), and the hashes are partitioned by range and sorted with document and position as
secondary keys. A task streams its sorted rows: the first row of a hash names the document that keeps the line, and
the rows of other documents are lost. A frequent line may fill many partitions, because the ranges cut by
document and position too; only the first hash of a partition can have begun before it, so its rows are left open until
the first and last hash of all partitions are known, which are two rows each.

The result is one bitmap of kept lines for each document that loses any, not the text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from tracewright.plans.tables import materialize

MIN_CHARS = 10
NO_ID = 2 ** 63 - 1
_SPACE = " \t\n\v\f\r"
_BATCH = 1 << 16
_ORDER = ["h1", "h2", "d", "t", "at"]
_ROWS = "h1 long, h2 long, d long, t long, at int"


def line_key(line: str) -> str:
    """The line without blanks at its ends and with A-Z in lower case."""
    return line.strip(_SPACE).encode().lower().decode()


def bitmap(lost: np.ndarray, n_lines: int) -> bytes:
    """One bit for each line, set if it stays, packed and compressed."""
    keep = np.ones(n_lines, bool)
    keep[lost] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes())


def bits(packed: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=n_lines, bitorder="little").astype(bool)


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id (as text), d, t, text: a document is its doc_id; one without is known by its text and comes after all others."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"),
                       F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(F.lit(0).cast("long")).alias("t"),
                       text.alias("text"))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2, d, t, at of every line whose key has ``min_chars`` code points or more."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            raw, ds, ts, ats = [], [], [], []

            def block() -> pd.DataFrame:
                h = np.frombuffer(b"".join(raw), ">i8").astype(np.int64).reshape(-1, 2)
                return pd.DataFrame({"h1": h[:, 0], "h2": h[:, 1], "d": ds, "t": ts, "at": np.array(ats, np.int32)})

            for d, t, text in zip(batch["d"].tolist(), batch["t"].tolist(), batch["text"]):
                for at, line in enumerate(text.split("\n")):
                    line = line.strip(_SPACE)
                    if len(line) >= min_chars:
                        raw.append(digest(line.encode().lower()))
                        ds.append(d)
                        ts.append(t)
                        ats.append(at)
                        if len(raw) == _BATCH:
                            yield block()
                            raw, ds, ts, ats = [], [], [], []
            if raw:
                yield block()

    return _identified(docs).drop("doc_id").mapInPandas(work, _ROWS)


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over the sorted rows of a partition: rows that are lost (kind 0), all rows of its first hash (kind 1), and
    the first row of its first and of its last hash (kind 2)."""
    first, last, keeper, edge = None, None, None, None
    for batch in batches:
        h1, h2, d, t, at = (batch[c].to_numpy() for c in ("h1", "h2", "d", "t", "at"))
        if not len(h1):
            continue
        if first is None:
            first = last = (h1[0], h2[0])
            keeper = edge = (h1[0], h2[0], d[0], t[0], at[0])
        starts = np.ones(len(h1), bool)
        starts[0] = (h1[0], h2[0]) != last
        starts[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        run = np.cumsum(starts)                                # 0: the hash that the last batch ended in
        where = np.concatenate([[0], np.flatnonzero(starts)])
        kd, kt = d[where], t[where]
        kd[0], kt[0] = keeper[2], keeper[3]
        lost = (d != kd[run]) | (t != kt[run])
        opened = (h1 == first[0]) & (h2 == first[1])
        out = batch.assign(kind=np.where(opened, 1, 0).astype(np.int32))
        yield out[lost | opened]
        if run[-1]:
            i = where[-1]
            keeper = (h1[i], h2[i], d[i], t[i], at[i])
        last = (h1[-1], h2[-1])
    if first is not None:
        yield pd.DataFrame([edge, keeper], columns=["h1", "h2", "d", "t", "at"]).assign(kind=2)


def lost_lines(lines: DataFrame) -> DataFrame:
    """d, t, at of the lines that go. ``lines`` (from ``line_hashes``) should be a stored table."""
    ordered = lines.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    seen = materialize(ordered.mapInPandas(_stream, _ROWS + ", kind int"), "line-stream")
    # two rows for each partition of the sort at most
    keeper = seen.filter("kind = 2").groupBy("h1", "h2").agg(F.min(F.struct("d", "t")).alias("first"))
    left_open = seen.filter("kind = 1").join(F.broadcast(keeper), ["h1", "h2"])
    other = left_open.filter((F.col("d") != F.col("first.d")) | (F.col("t") != F.col("first.t")))
    return seen.filter("kind = 0").select("d", "t", "at").union(other.select("d", "t", "at"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """d, t, lost (number), last (the last line that goes), keep (compressed bitmap up to that line), for the documents
    that lose lines; lines behind the bitmap stay.

    Documents without a doc_id come last, and count as one if their texts are equal. Rows with equal ids are
    one document: what they share among each other stays. Nulls and empty texts are one empty line, which is
    too short to count. An empty table gives no bitmap; other columns are ignored.
    """
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lost = [np.asarray(x) for x in batch["at"]]
            last = [int(x.max()) for x in lost]
            yield batch[["d", "t"]].assign(lost=[len(x) for x in lost], last=last,
                                           keep=[bitmap(x, n + 1) for x, n in zip(lost, last)])

    lines = materialize(line_hashes(docs, min_chars), "line-hashes")
    # repeated rows of one document give its lines more than once
    own = lost_lines(lines).groupBy("d", "t").agg(F.collect_set("at").alias("at"))
    return own.mapInPandas(work, "d long, t long, lost long, last int, keep binary")


def apply_bitmap(text: str, last: int, keep: bytes) -> list[str]:
    """The lines of a text that stay."""
    lines = text.split("\n")
    kept = bits(keep, last + 1)
    return [line for line, k in zip(lines, kept) if k] + lines[last + 1:]


def deduplicate(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Every row of ``docs``: doc_id, n_lines (before), n_dropped, kept_sha256 (of the lines that stay, joined by
    line ends). See ``keep_bitmaps`` for nulls, ties, repeated rows and empty tables."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, last, keep in zip(batch["text"], batch["last"], batch["keep"]):
                n = text.count("\n") + 1
                kept = text if keep is None else "\n".join(apply_bitmap(text, int(last), keep))
                m = n if keep is None else n - int((~bits(keep, int(last) + 1)).sum())
                rows.append((n, n - m, hashlib.sha256(kept.encode()).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept_sha256"], index=batch.index)
            yield pd.concat([batch[["doc_id"]], out], axis=1)

    maps = keep_bitmaps(docs, min_chars).select(F.col("d").alias("_d"), F.col("t").alias("_t"), "last", "keep")
    rows = _identified(docs)
    joined = rows.join(maps, (F.col("d") == F.col("_d")) & (F.col("t") == F.col("_t")), "left")
    # ids are text here, because pandas turns numbers beside nulls into floats
    out = joined.select("doc_id", "text", "last", "keep").mapInPandas(work, "doc_id string, n_lines long, n_dropped long, kept_sha256 string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
