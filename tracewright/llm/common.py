"""Small helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tracewright.plans.tables import materialize

SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8 with A-Z in lower case. Separators are the blank and
    code points 9 to 13, the ones that ``bytes.split`` knows."""
    return text.encode().lower().split() if text else []


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def unit_hash(column: Column, seed: int) -> Column:
    """Uniform number in [0, 1) that depends on the value and the seed only."""
    return F.shiftrightunsigned(F.xxhash64(column, F.lit(seed)), 11) / F.lit(float(2 ** 53))


def few_files(df: DataFrame, per_core: int = 4) -> DataFrame:
    """Narrow rows in at most ``per_core`` partitions a core, so that they are not written as one
    tiny file for each shuffle partition. Partitions are read one after the other by
    a task, so its memory does not grow."""
    return df.coalesce(per_core * df.sparkSession.sparkContext.defaultParallelism)


def ranked(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``rows`` with i, the place (from 0) of each among the rows of its key, and n, their number. The keys must not be
    null. Rows are sorted over all partitions and numbered inside them; only one row for each partition and
    key is summed up, so a key may hold any part of the rows."""
    placed = rows.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
    placed = materialize(placed.withColumn("_at", F.monotonically_increasing_id())
                         .withColumn("_part", F.shiftright("_at", 33)), "ranked")
    runs = placed.groupBy(*key, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_m"))
    whole = Window.partitionBy(*key)
    before = F.sum("_m").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(*key, "_part", (F.coalesce(before, F.lit(0).cast("long")) - F.col("_first")).alias("_shift"),
                       F.sum("_m").over(whole).alias("n"))
    return placed.join(runs, [*key, "_part"]).withColumn("i", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")
