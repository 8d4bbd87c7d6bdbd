"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracewright.llm.common import few_files
from tracewright.plans.tables import discard, materialize


def connected_components(edges: DataFrame, name: str = "edges", rounds: int | None = None) -> DataFrame:
    """node, component (its smallest node) for every node of ``edges`` (a, b: two longs).

    Alternating star contraction: every node links its larger neighbours, then its smaller
    ones, to the smallest node it sees, until only stars are left. Rounds grow with the
    logarithm of the size, each is a written table, and a node with
    many neighbours only takes part in sums and in joins that Spark can split. Edges are dealt evenly after each
    step and go on in few partitions, so that small graphs cost few tasks.

    With ``rounds`` it ends after that many: nodes with one component are joined, but joined nodes may still have several.
    """
    def both(e: DataFrame) -> DataFrame:
        return e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        way = both(e) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = way.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
        seen = way.join(least, F.col("a") == F.col("n"))
        if large:
            out = seen.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = seen.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(
                least.select(F.col("n").alias("a"), F.col("m").alias("b")))
        return few_files(out.filter(F.col("a") != F.col("b")).distinct())

    def stars_only(e: DataFrame) -> bool:
        """Every larger node has one edge, and none is the smaller node of another."""
        ends = e.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            e.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        seen = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return not seen.agg(F.coalesce(F.max(F.col("up") + F.col("down") > 1), F.lit(False))).first()[0]

    larger = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, done = materialize(few_files(larger.filter(F.col("a") != F.col("b")).distinct()), name), 0
    while done != rounds and not stars_only(now):
        old, now = now, materialize(star(star(now, True), False), name)
        discard(old)
        done += 1
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return few_files(stars.union(stars.select("component", "component")).groupBy("node").agg(F.min("component").alias("component")))
