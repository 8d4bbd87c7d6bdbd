"""Group statistics and separability diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracewright import constants as C
from tracewright.functions.arrays import nan
from tracewright.operators.ordered import pairs_won


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def zscore(df: DataFrame, names: list[str], keys: list[str] = ["patient_id"],
           eps: float = C.ZSCORE_EPS) -> DataFrame:
    """(x - mean) / (population std + eps) inside each key. The statistics are
    aggregated map-side and joined back; rows are not shuffled for a broadcastable
    number of keys."""
    stats = df.groupBy(*keys).agg(
        *[F.avg(n).alias(f"_m_{n}") for n in names], *[F.stddev_pop(n).alias(f"_s_{n}") for n in names])
    scaled = {n: (F.col(n) - F.col(f"_m_{n}")) / (F.col(f"_s_{n}") + eps) for n in names}
    return df.join(stats, keys).withColumns(scaled).select(*df.columns)


def feature_stats(df: DataFrame, names: list[str]) -> DataFrame:
    """feature, mean, std (population) over all rows."""
    one = df.agg(*[F.struct(F.avg(n).alias("mean"), F.stddev_pop(n).alias("std")).alias(n) for n in names])
    return one.unpivot([], names, "feature", "v").select("feature", "v.mean", "v.std")


def single_feature_auc(df: DataFrame, names: list[str], keys: list[str] = ["dataset"],
                       label: str = "y") -> DataFrame:
    """keys, feature, auc of the raw values; ties count half, non-finite values are
    left out, one class gives NaN."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names]))
    rows = df.select(*keys, label, pairs.alias("p")).select(*keys, label, "p.feature", "p.value")
    ok = finite(F.col("value"))
    rows = rows.select(*keys, "feature", F.when(ok, F.col("value")).otherwise(F.lit(0.0)).alias("value"),
                       F.when(ok, F.col(label)).alias("_y"))
    count = lambda y: F.coalesce((F.col("_y") == y).cast("bigint"), F.lit(0))
    won = pairs_won(rows, [*keys, "feature"], "value", count(1), count(0))
    return won.select(*keys, "feature", share_won().alias("auc"))


def share_won() -> Column:
    """AUC of a ``pairs_won`` row, NaN with one class."""
    return F.coalesce(F.try_divide(F.col("wins"), F.col("pos").cast("double") * F.col("neg")), nan())


def cohens_d(df: DataFrame, names: list[str], keys: list[str] = ["dataset"],
             label: str = "y") -> DataFrame:
    """keys, feature, d: (mean of positives - negatives) / pooled sample SD over finite
    values; NaN with fewer than two rows in a class or without spread."""
    def part(n: str, y: int) -> Column:
        x = F.when(finite(F.col(n)) & (F.col(label) == y), F.col(n))
        return F.struct(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_samp(x).alias("v"))
    wide = df.groupBy(*keys).agg(*[
        F.struct(part(n, 1).alias("p"), part(n, 0).alias("q")).alias(n) for n in names])
    rows = wide.unpivot(keys, names, "feature", "s").select(*keys, "feature", "s.p", "s.q")
    degrees = F.col("p.n") + F.col("q.n") - 2
    pooled = F.sqrt(F.try_divide((F.col("p.n") - 1) * F.col("p.v") + (F.col("q.n") - 1) * F.col("q.v"), degrees))
    enough = (F.col("p.n") >= 2) & (F.col("q.n") >= 2)
    d = F.when(enough, F.try_divide(F.col("p.m") - F.col("q.m"), pooled))
    return rows.select(*keys, "feature", F.coalesce(d, nan()).alias("d"))


def separability(df: DataFrame, names: list[str], keys: list[str] = ["dataset"],
                 label: str = "y") -> DataFrame:
    """keys, feature, auc, sep (distance of the AUC from one half), d."""
    both = single_feature_auc(df, names, keys, label).join(cohens_d(df, names, keys, label), [*keys, "feature"])
    return both.select(*keys, "feature", "auc", F.abs(F.col("auc") - 0.5).alias("sep"), "d")


def comparison_table(profile: DataFrame, datasets: list[str], metric: str) -> DataFrame:
    """Features in rows, one column per dataset; a missing dataset stays null."""
    return profile.groupBy("feature").pivot("dataset", datasets).agg(F.first(metric))


def focus(profile: DataFrame, features: list[str] = C.FOCUS_FEATURES) -> DataFrame:
    return profile.filter(F.col("feature").isin(features))


def mean_separability(profile: DataFrame, balance: DataFrame) -> DataFrame:
    """Mean distance of the AUC from one half and mean absolute d over the features
    where they are defined, with the class counts."""
    means = profile.groupBy("dataset").agg(
        F.coalesce(F.avg(nan_to_null(F.col("sep"))), nan()).alias("mean_sep"),
        F.coalesce(F.avg(F.abs(nan_to_null(F.col("d")))), nan()).alias("mean_abs_d"))
    return means.join(balance, "dataset")


def class_balance(df: DataFrame, keys: list[str] = ["dataset"], label: str = "y") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("n_pos"),
                                 F.count_if(F.col(label) == 0).alias("n_neg"))


def drop_ignored(df: DataFrame, label: str = "y") -> DataFrame:
    return df.filter(F.col(label) != C.IGNORE_LABEL)
