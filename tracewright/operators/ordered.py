"""Order-dependent values without putting a whole key into one task.

A recording, a fold or a feature may hold a large share of all rows, so a window
over the key alone would end in one task. Each helper splits the key into buckets
that follow the order, runs the window inside a bucket, and carries one small row
per bucket across the buckets of the key. Buckets of times are plain functions of the row;
those of values are ranges that Spark draws from the data, stored once, so a recomputed task gives the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.plans.tables import materialize

_BUCKET = "_bucket"


def time_bucket(sec: Column, width: float) -> Column:
    return F.floor(sec / F.lit(float(width))).cast("bigint")


def add_position(df: DataFrame, keys: list[str], order: list[str], bucket: str, name: str) -> DataFrame:
    """0-based row number inside each key. The ``bucket`` column must not decrease along
    ``order``. ``df`` is read twice (sizes and rows): store it first when it is costly."""
    group = [*keys, bucket]
    df = df.filter(F.col(bucket).isNotNull())
    across = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = (df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
              .select(*group, F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before")))
    inside = Window.partitionBy(*group).orderBy(*order)
    return (df.withColumn("_rn", F.row_number().over(inside) - 1).join(before, group)
            .withColumn(name, (F.col("_rn") + F.col("_before")).cast("bigint")).drop("_rn", "_before"))


def add_previous(df: DataFrame, keys: list[str], order: list[str], bucket: str, value: Column,
                 name: str) -> DataFrame:
    """``value`` of the preceding row of the key (null for its first row).

    Only the first and last rows of the buckets meet in the window over the key. Both
    parts keep all columns, so Spark shuffles the rows once and reuses the exchange.
    """
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(*order)
    # the explicit null filter keeps both parts' exchanges identical
    tagged = df.filter(F.col(bucket).isNotNull()).withColumn("_value", value).withColumns({
        name: F.lag("_value").over(inside), "_first": F.row_number().over(inside) == 1,
        "_last": F.lead(F.lit(True), 1, False).over(inside)}).withColumn("_last", ~F.col("_last"))
    edge = F.col("_first") | F.col("_last")
    carried = F.when(F.col("_first"), F.lag("_value").over(across)).otherwise(F.col(name))
    edges = tagged.filter(edge).withColumn(name, carried)
    return tagged.filter(~edge).unionByName(edges).drop("_value", "_first", "_last")


def counts_by_value(df: DataFrame, keys: list[str], value: str, counts: dict[str, Column]) -> DataFrame:
    """One row per distinct value of a key with the named sums and its bucket, as a stored table. Equal
    values are pre-aggregated before the shuffle, so ties cost one row. Rows with a
    null key or value are left out."""
    known = df
    for c in (*keys, value):
        known = known.filter(F.col(c).isNotNull())
    return in_ranges(known.groupBy(*keys, value).agg(*[F.sum(e).cast("bigint").alias(c) for c, e in counts.items()]), [*keys, value])


def in_ranges(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` as a stored table with a bucket that does not decrease along ``order``. The bounds are quantiles of the rows
    themselves, so buckets hold about equally many, however close or far apart the values lie."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).withColumn(_BUCKET, F.spark_partition_id())
    return materialize(placed, "ranges")


def _before(order: str, *keys: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def pairs_won(df: DataFrame, keys: list[str], value: str, pos: Column, neg: Column) -> DataFrame:
    """keys, wins, pos, neg: over all (positive, negative) pairs of a key, how often the
    positive has the larger value, ties one half.

    Wins inside a bucket come from a window over the bucket; wins over lower buckets from
    the bucket sums. Distinct values are shuffled once and never joined back.
    """
    own = counts_by_value(df, keys, value, {"pos": pos, "neg": neg})
    below = F.coalesce(F.sum("neg").over(_before(value, *keys, _BUCKET)), F.lit(0))
    per_bucket = (own.withColumn("wins", F.col("pos") * (below + F.col("neg") / F.lit(2.0)))
                  .groupBy(*keys, _BUCKET).agg(*[F.sum(c).alias(c) for c in ("wins", "pos", "neg")]))
    lower = F.coalesce(F.sum("neg").over(_before(_BUCKET, *keys)), F.lit(0)).cast("double")
    return (per_bucket.withColumn("wins", F.col("wins") + F.col("pos") * lower)
            .groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("wins", "pos", "neg")]))


def counts_below(df: DataFrame, keys: list[str], value: str,
                 counts: dict[str, Column]) -> DataFrame:
    """One row per distinct value of a key with, for every named count, its sum at
    the value (``c``), below it (``c_below``) and over the key (``c_total``)."""
    per_value = counts_by_value(df, keys, value, counts)
    across, whole = _before(_BUCKET, *keys), Window.partitionBy(*keys)
    per_bucket = per_value.groupBy(*keys, _BUCKET).agg(*[F.sum(c).alias(c) for c in counts])
    offsets = per_bucket.select(
        *keys, _BUCKET,
        *[F.coalesce(F.sum(c).over(across), F.lit(0)).alias(f"_{c}_before") for c in counts],
        *[F.sum(c).over(whole).alias(f"{c}_total") for c in counts])
    inside = _before(value, *keys, _BUCKET)
    joined = per_value.select(
        *keys, _BUCKET, value, *counts,
        *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_{c}_inside") for c in counts],
    ).join(offsets, [*keys, _BUCKET])
    return joined.select(
        *keys, value, *counts, *[f"{c}_total" for c in counts],
        *[(F.col(f"_{c}_inside") + F.col(f"_{c}_before")).alias(f"{c}_below") for c in counts])


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                    method: str = "hazen") -> DataFrame:
    """Exact quantiles per key, named by ``probs``. Position n*q - 1/2 (``hazen``)
    or (n-1)*q (``linear``), 0-based, linear interpolation; NaN rows are dropped."""
    ranked = counts_below(df.filter(~F.isnan(value)), keys, value, {"_n": F.lit(1)})
    n, below = F.col("_n_total"), F.col("_n_below")

    def at(rank: Column) -> Column:
        return F.max(F.when((below <= rank) & (rank < below + F.col("_n")), F.col(value)))

    aggs = []
    for name, q in probs.items():
        raw = n * F.lit(q) - 0.5 if method == "hazen" else (n - 1) * F.lit(q)
        pos = F.least(F.greatest(raw, F.lit(0.0)), (n - 1).cast("double"))
        aggs += [at(F.floor(pos)).alias(f"_{name}_lo"), at(F.ceil(pos)).alias(f"_{name}_hi"),
                 F.max(pos - F.floor(pos)).alias(f"_{name}_part")]
    picked = ranked.groupBy(*keys).agg(*aggs)
    return picked.select(*keys, *[
        (F.col(f"_{p}_lo") + (F.col(f"_{p}_hi") - F.col(f"_{p}_lo")) * F.col(f"_{p}_part")).alias(p)
        for p in probs])
