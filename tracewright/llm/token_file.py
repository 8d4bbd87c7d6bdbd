"""Token ids as flat binary files with Elias-Fano document boundaries.

One file holds a run of documents in ascending order: their ids back to back, the
boundaries and the document ids as Elias-Fano sequences. A reader finds any document by
``select`` on the boundaries; no table of 64-bit offsets exists.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tracewright.llm import blobfile
from tracewright.llm.elias_fano import EliasFano
from tracewright.llm.tokens import encoder
from tracewright.session import scratch_path

FILES = ("file_no long, path string, first_key long, n_docs long, n_ids long, n_bytes long")
FILE_IDS = 1 << 26          # ids in a file, so that a writer's memory is bounded
SIGN = 1 << 63


def _flush(folder: str, keys: list[int], lengths: list[int], parts: list[np.ndarray]) -> dict:
    ids = np.concatenate(parts)
    ends = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))])
    arrays = {"ids": ids, **blobfile.prefixed(EliasFano.encode(ends, int(ends[-1]) + 1), "bounds")}
    base = keys[0]
    offsets = np.array([k - base for k in keys], np.uint64)
    arrays |= {"base": np.array([base - SIGN], np.int64),
               **blobfile.prefixed(EliasFano.encode(offsets, int(offsets[-1]) + 1), "keys")}
    path = f"{folder}/ids-{uuid.uuid4().hex}.bin"
    size = blobfile.write_arrays(path, arrays)
    return {"path": path, "first_key": base - SIGN, "n_docs": len(keys), "n_ids": int(ends[-1]), "n_bytes": size}


def write_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int, dtype: str = "<u2",
                file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every text of ``docs`` (doc_id, text) with ``end_id`` appended and write the
    ids in ascending order of doc_id. Returns one row per file with its number in
    that order.

    Null texts count as empty. Repeated ids are kept next to each other, the texts in
    their own order; a null id is stored as the smallest 64-bit integer. An empty table gives no file.
    ``dtype`` must hold every id of the vocabulary (``<u2`` or ``<u4``), else an error is raised.
    """
    lowest = -SIGN

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        if max(coder.largest, end_id) > np.iinfo(dtype).max:
            raise ValueError(f"ids up to {max(coder.largest, end_id)} do not fit into {dtype}")
        made, keys, lengths, parts, held = [], [], [], [], 0
        for batch in batches:
            for key, coded in zip(batch["doc_id"].tolist(), coder.encode(batch["text"].tolist())):
                coded += end
                keys.append(key + SIGN)
                lengths.append(len(coded) // 4)
                parts.append(np.frombuffer(coded, "<u4").astype(dtype))
                held += lengths[-1]
                if held >= file_ids:
                    made.append(_flush(folder, keys, lengths, parts))
                    keys, lengths, parts, held = [], [], [], 0
        if keys:
            made.append(_flush(folder, keys, lengths, parts))
        if made:
            yield pd.DataFrame(made).assign(file_no=-1)[["file_no", "path", "first_key", "n_docs", "n_ids", "n_bytes"]]

    blobfile.make_folder(folder)
    rows = (docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("doc_id"), "text")
            .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))
    return rows.mapInPandas(write, FILES)


def read_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The documents of the files: doc_id, start (ids of all documents before it), n_tokens and
    the checksum of its ids as little-endian unsigned 32-bit integers."""
    lowest = -SIGN

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, before in zip(batch["path"], batch["ids_before"].tolist()):
                arrays = blobfile.read_arrays(path)
                bounds = EliasFano(blobfile.group(arrays, "bounds"))
                names = EliasFano(blobfile.group(arrays, "keys"))
                base = int(arrays["base"][0])
                for i in range(0, len(names), 65536):
                    at = np.arange(i, min(i + 65536, len(names)))
                    starts = bounds.select(at).astype(np.int64)
                    ends = bounds.select(at + 1).astype(np.int64)
                    crc = [zlib.crc32(arrays["ids"][a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends)]
                    keys = names.select(at).astype(np.int64) + base
                    yield pd.DataFrame({"doc_id": keys, "start": before + starts,
                                        "n_tokens": ends - starts, "ids_crc32": np.array(crc, np.int64)})

    numbered = files.repartition(max(1, files.count()), "path")
    out = numbered.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != lowest, F.col("doc_id")))


def number_files(files: DataFrame) -> DataFrame:
    """Add ``ids_before``: the ids of all files before this one. There is one row per file, so
    the window stays small (a file holds up to 2**26 ids)."""
    before = Window.orderBy("first_key", "path").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("ids_before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 1, dtype: str = "<u2",
               file_ids: int = FILE_IDS) -> DataFrame:
    """Write the files to the shared folder, then read every document back from them."""
    spark = docs.sparkSession
    root = scratch_path(spark, "token-files")
    index = f"{root}-index"
    write_files(docs, root, vocabulary, end_id, dtype, file_ids).write.parquet(index)
    return read_files(spark, number_files(spark.read.schema(FILES).parquet(index)))
