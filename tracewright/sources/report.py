"""Channel-detection reports.

A report is a text with one block per recording: a header ``[i/N] NAME.edf`` and
lines ``category : [list]``. Malformed lists count as empty, the first line of a
category wins inside a block, the last block of a recording wins in a report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tracewright import constants as C

# (?md): ^ and $ at line ends, newline the only line end.
_HEADER = r"\[\d+/\d+\]\s+(.+?)\.edf\s*$"
_HEADER_LINE = rf"^{_HEADER}"
_ITEM = r"""(?:'[^'\\]*'|"[^"\\]*"|[+-]?\d+(?:\.\d+)?)"""
_LIST = rf"^\[\s*(?:{_ITEM}\s*(?:,\s*{_ITEM}\s*)*,?\s*)?\]$"


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """report_id (path), value (whole text) per report file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("report_id"), "value")


def _channel_list(raw: Column) -> Column:
    plain = F.regexp_replace(raw, r"np\.str_\(([^)]+)\)", "$1")
    items = F.regexp_extract_all(plain, F.lit(f"({_ITEM})"), 1)
    names = F.transform(items, lambda i: F.regexp_replace(i, r"""^['"]|['"]$""", ""))
    return F.when(plain.rlike(_LIST), names).otherwise(F.array().cast("array<string>"))


def parse_reports(reports: DataFrame) -> DataFrame:
    """report_id, recording_id, one ``array<string>`` per category. Every block gives
    a row, also one without any category."""
    blocks = reports.select("report_id", F.posexplode(
        F.split("value", rf"(?md)(?=^{_HEADER})")).alias("block", "text")).select(
        "report_id", "block", "text",
        F.trim(F.regexp_extract("text", rf"(?md)\A{_HEADER}", 1)).alias("recording_id"),
    ).filter(F.col("recording_id") != "")
    body = F.regexp_replace("text", rf"(?md)\A{_HEADER}", "")
    found = blocks.withColumn("_body", body).select("report_id", "recording_id", "block", *[
        _channel_list(F.regexp_extract("_body", rf"(?md)^\s*{c}\s*:\s*(\[.*?\])\s*$", 1)).alias(c)
        for c in C.REPORT_CATEGORIES])
    last = found.groupBy("report_id", "recording_id").agg(
        F.max_by(F.struct(*C.REPORT_CATEGORIES), "block").alias("b"))
    return last.select("report_id", "recording_id", "b.*")


def read_report_lines(spark: SparkSession, path: str) -> DataFrame:
    """report_id, split (where the part of the file that a task reads begins), line (grows inside a split), value: reports
    of any size, one row per line. Store the result: lines are numbered while they are read."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("_metadata.file_path").alias("report_id"), F.col("_metadata.file_block_start").alias("split"),
                       F.monotonically_increasing_id().alias("line"), "value")


def parse_report_lines(lines: DataFrame) -> DataFrame:
    """``parse_reports`` for lines (report_id, split, line, value). A header stands on one line, so does a category with its list.

    The header of a line is the last one before it: inside a split by a window over the split, and for the lines before
    the first header of a split by one row per split that carries the last header on.
    """
    place = F.struct("split", "line")
    name = F.trim(F.regexp_extract("value", rf"(?d){_HEADER_LINE}", 1))
    marked = lines.withColumn("_head", F.when(name != "", F.struct(place.alias("at"), name.alias("recording_id"))))
    inside = Window.partitionBy("report_id", "split").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy("report_id").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    ends = marked.groupBy("report_id", "split").agg(F.max("_head").alias("_last"))       # the latest: ordered by its place
    carried = ends.select("report_id", "split", F.last("_last", ignorenulls=True).over(across).alias("_before"))
    owned = marked.withColumn("_own", F.last("_head", ignorenulls=True).over(inside)).join(carried, ["report_id", "split"])
    owned = owned.withColumn("_block", F.coalesce("_own", "_before")).filter(F.col("_block").isNotNull())

    def first(category: str) -> Column:
        found = F.regexp_extract("value", rf"(?d)^\s*{category}\s*:\s*(\[.*?\])\s*$", 1)
        return F.min_by(found, F.when(found != "", place)).alias(category)

    blocks = owned.groupBy("report_id", "_block").agg(*[first(c) for c in C.REPORT_CATEGORIES])
    lists = blocks.select("report_id", "_block", *[_channel_list(F.coalesce(c, F.lit(""))).alias(c) for c in C.REPORT_CATEGORIES])
    last = lists.groupBy("report_id", F.col("_block.recording_id").alias("recording_id")).agg(
        F.max_by(F.struct(*C.REPORT_CATEGORIES), "_block.at").alias("b"))
    return last.select("report_id", "recording_id", "b.*")


def report_rows(parsed: DataFrame) -> DataFrame:
    """report_id, recording_id, category, channel: one row per flagged channel."""
    return (parsed.unpivot(["report_id", "recording_id"], C.REPORT_CATEGORIES, "category", "channels")
            .select("report_id", "recording_id", "category", F.explode("channels").alias("channel")))
