"""Exact deduplication by a tree merge of sorted digest runs. DataFrame operations only.

Every row belongs to one of ``runs`` runs: distinct keys (digest, second hash, byte length) with the row to keep and
the number of rows. Runs are stored in buckets of the digest, sorted inside each, so that equal digests of all
runs lie in buckets of one number. In every round ``fan_in`` neighbouring runs are merged into
one, bucket by bucket and without an exchange, and the key is compared whole again; the result is stored in
the same buckets, until one run is left. A text with millions of copies costs one row per run after the
first, local aggregation; texts are never shuffled.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from tracewright.llm.common import text_or_empty
from tracewright.plans.tables import discard, materialize
from tracewright.session import scratch_path

KEY = ["digest", "check", "n_bytes"]


def digests(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """doc_id, seq (number of the row), digest (SHA-256, 32 bytes), check (an independent 64-bit hash), n_bytes. ``text``
    is the normalised text; by default the text itself, null as empty."""
    text = text_or_empty() if text is None else text
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text")).select(
        "doc_id", F.monotonically_increasing_id().alias("seq"), F.unhex(F.sha2(F.col("_text"), 256)).alias("digest"), F.xxhash64("_text").alias("check"),
        F.octet_length("_text").cast("long").alias("n_bytes"))


class _Runs:
    """A level of the tree: runs in sorted buckets of the digest."""

    def __init__(self, rows: DataFrame, buckets: int):
        self._spark, self._name = rows.sparkSession, f"digest_runs_{uuid.uuid4().hex}"
        self.stage_path = scratch_path(self._spark, "digest-runs")
        (rows.write.bucketBy(buckets, "digest").sortBy("run", *KEY).option("path", self.stage_path)
         .format("parquet").saveAsTable(self._name))

    def rows(self) -> DataFrame:
        return self._spark.table(self._name)

    def drop(self) -> None:
        self._spark.sql(f"DROP TABLE {self._name}")
        discard(self)

    @property
    def sparkSession(self):
        return self._spark


def merge_round(level: DataFrame, fan_in: int, keep: str) -> DataFrame:
    """Neighbouring runs of a stored level as one. Buckets hold whole digests, so no row moves."""
    best = {"min": F.min, "max": F.max}[keep]
    return (level.withColumn("run", F.floor(F.col("run") / fan_in).cast("long")).groupBy("run", *KEY)
            .agg(best("best").alias("best"), F.sum("group_size").alias("group_size")))


def merge_runs(rows: DataFrame, runs: int = 64, fan_in: int = 8, keep: str = "min") -> DataFrame:
    """One row per distinct text: key, keep_id, keep_seq, group_size. ``rows`` come from ``digests``.

    The merge compares the second hash and the length with the digest at every level, so two texts are
    only merged if all three agree. Null identifiers count as rows and are kept only if
    a text has no other; of rows with one identifier the first (``min``) or last one in the table is kept.
    """
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = F.col("doc_id").isNull() if keep == "min" else F.col("doc_id").isNotNull()
    first = rows.select(F.pmod(F.xxhash64("seq"), F.lit(runs)).alias("run"), *KEY,
                        F.struct(known.alias("o"), "doc_id", "seq").alias("best"), F.lit(1).cast("long").alias("group_size"))
    # a run has a text once, so that its rows can go to the buckets whatever the number of copies
    level = _Runs(merge_round(first, 1, keep).repartition(buckets, "digest"), buckets)
    while runs > 1:
        runs = -(-runs // fan_in)
        above = _Runs(merge_round(level.rows(), fan_in, keep), buckets)
        level.drop()
        level = above
    out = materialize(level.rows().select(*KEY, F.col("best.doc_id").alias("keep_id"), F.col("best.seq").alias("keep_seq"),
                                          "group_size"), "survivors")
    level.drop()
    return out


def exact_groups(docs: DataFrame, keep: str = "min", runs: int = 64, fan_in: int = 8,
                 text: Column | None = None) -> DataFrame:
    """Every row of ``docs`` with its group: doc_id, keep_id, group_size, kept, text_sha256.

    One row of each group is kept, also where rows have equal ids and texts or no id.
    An empty table gives an empty result; other columns are ignored.
    """
    rows = materialize(digests(docs, text), "digests")
    survivors = merge_runs(rows, runs, fan_in, keep)
    joined = rows.join(survivors, KEY)
    return joined.select("doc_id", "keep_id", "group_size", (F.col("seq") == F.col("keep_seq")).alias("kept"),
                         F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame, keep: str = "min", runs: int = 64, fan_in: int = 8) -> DataFrame:
    """The documents that stay, with their columns. Full repeats of the kept row
    (same id, same text) are reduced to one row."""
    kept = exact_groups(docs, keep, runs, fan_in).filter("kept").select(
        F.col("doc_id").alias("_kept"), F.unhex("text_sha256").alias("_digest")).distinct()
    rows = docs.select(F.struct("*").alias("_row")).select(
        "_row", F.col("_row.doc_id").cast("long").alias("_id"),
        F.unhex(F.sha2(F.coalesce(F.col("_row.text"), F.lit("")), 256)).alias("_sha"))
    one = rows.join(kept, F.col("_id").eqNullSafe(F.col("_kept")) & (F.col("_sha") == F.col("_digest")))
    return one.dropDuplicates(["_id", "_sha"]).select("_row.*")
