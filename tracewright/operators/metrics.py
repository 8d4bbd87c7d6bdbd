"""Metrics, rankings and summaries of scored rows (y, proba and the keys of a fold)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright import constants as C
from tracewright.functions.arrays import nan
from tracewright.functions.text import time_text_truncated
from tracewright.operators.channels import pattern
from tracewright.operators.ordered import counts_below
from tracewright.operators.stats import nan_to_null


def decide(proba: Column, threshold: float = C.THRESHOLD) -> Column:
    return (proba >= threshold).cast("int")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(scored: DataFrame, keys: list[str], threshold: float = C.THRESHOLD) -> DataFrame:
    hit, y = decide(F.col("proba"), threshold) == 1, F.col("y") == 1
    return scored.groupBy(*keys).agg(
        F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"),
        F.count_if(~hit & ~y).alias("tn"), F.count_if(~hit & y).alias("fn"))


def threshold_metrics(counts: DataFrame) -> DataFrame:
    """Adds acc, bacc, f1, precision and recall to confusion counts. Balanced
    accuracy averages over the classes that occur."""
    tp, fp, tn, fn = (F.col(c) for c in C.COUNTS)
    classes = F.when(tp + fn > 0, 1).otherwise(0) + F.when(tn + fp > 0, 1).otherwise(0)
    return counts.withColumns({
        "acc": ratio(tp + tn, tp + fp + tn + fn),
        "bacc": ratio(ratio(tp, tp + fn) + ratio(tn, tn + fp), classes),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})


def _by_score(scored: DataFrame, keys: list[str]) -> DataFrame:
    """One row per distinct score of a key, with its class counts and those below."""
    return counts_below(scored, keys, "proba", {"pos": (F.col("y") == 1).cast("bigint"),
                                                "neg": (F.col("y") == 0).cast("bigint")})


def _area() -> Column:
    """ROC area over the rows of ``_by_score``."""
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / F.lit(2.0)))
    pairs = F.max(F.col("pos_total").cast("double") * F.col("neg_total"))
    return F.coalesce(F.try_divide(wins, pairs), nan())


def _average_precision() -> Column:
    tp = (F.col("pos_total") - F.col("pos_below")).cast("double")
    fp = F.col("neg_total") - F.col("neg_below")
    step = F.try_divide(F.col("pos").cast("double"), F.col("pos_total")) * F.try_divide(tp, tp + fp)
    return F.coalesce(F.when(F.max(F.col("neg_total")) > 0, F.sum(step)), nan())


def rank_metrics(scored: DataFrame, keys: list[str]) -> DataFrame:
    """roc_auc and pr_auc (average precision, step sum) per key; one class gives NaN."""
    return _by_score(scored, keys).groupBy(*keys).agg(
        _area().alias("roc_auc"), _average_precision().alias("pr_auc"))


def fold_metrics(scored: DataFrame, keys: list[str] = ["fold"],
                 threshold: float = C.THRESHOLD) -> DataFrame:
    """keys, the seven metrics, the four counts. The rows are read once: counts and
    areas come from the same table of distinct scores."""
    hit = F.col("proba") >= threshold
    count = lambda c, keep: F.coalesce(F.sum(F.when(keep, F.col(c))), F.lit(0)).cast("bigint")
    one = _by_score(scored, keys).groupBy(*keys).agg(
        count("pos", hit).alias("tp"), count("neg", hit).alias("fp"),
        count("neg", ~hit).alias("tn"), count("pos", ~hit).alias("fn"),
        _area().alias("roc_auc"), _average_precision().alias("pr_auc"))
    return threshold_metrics(one).select(*keys, *C.METRICS, *C.COUNTS)


def summary(metrics: DataFrame, keys: list[str] = [], names: list[str] = C.METRICS) -> DataFrame:
    """keys, metric, mean and population std over the folds, undefined folds left out."""
    rows = metrics.unpivot(keys, names, "metric", "value")
    value = nan_to_null(F.col("value"))
    return rows.groupBy(*keys, "metric").agg(
        F.coalesce(F.avg(value), nan()).alias("mean"), F.coalesce(F.stddev_pop(value), nan()).alias("std"))


def total_confusion(metrics: DataFrame, keys: list[str] = []) -> DataFrame:
    return metrics.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in C.COUNTS])


def worst_folds(metrics: DataFrame, key: str = "fold", metric: str = "f1", k: int = 5) -> DataFrame:
    return metrics.orderBy(metric, key).limit(k).select(key, "f1", "precision", "recall")


def hard_errors(scored: DataFrame, keys: list[str] = [], k: int = 5,
                threshold: float = C.THRESHOLD) -> DataFrame:
    """The k most confident errors of each kind: false positives by falling, false
    negatives by rising probability, file and ``row_idx`` breaking ties. Spark keeps only k rows
    per kind in every task before the shuffle."""
    pred = decide(F.col("proba"), threshold)
    wrong = scored.withColumn("y_pred", pred).filter(F.col("y") != F.col("y_pred"))
    kind = F.when(F.col("y") == 0, "false_positive").otherwise("false_negative")
    certainty = F.when(F.col("y") == 0, -F.col("proba")).otherwise(F.col("proba"))
    w = Window.partitionBy(*keys, "error_type").orderBy("_order", "source", "row_idx")
    return (wrong.withColumn("error_type", kind).withColumn("_order", certainty)
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select(*keys, "error_type", "rank", time_text_truncated(F.col("center_sec")).alias("window_center_time"),
                    F.col("y").alias("y_true"), "y_pred", "proba", F.col("source").alias("recording_file"), "row_idx"))


def hard_error_report(errors: DataFrame) -> DataFrame:
    """Columns of the error file; the probability as text with eight digits."""
    return errors.select("error_type", "window_center_time", "y_true", "y_pred",
                         F.format_string("%.8f", "proba").alias("y_proba"), "recording_file")


def accuracy_by_patient(metrics: DataFrame, key: str = "fold") -> DataFrame:
    return metrics.select(key, pattern(F.col(key)).alias("pattern"), "acc").orderBy("acc", key)


def paired(first: DataFrame, second: DataFrame, key: str = "fold", sort_by: str = "mean") -> DataFrame:
    """Accuracy of two representations for the patients in both, ordered by ``mean``,
    ``first``, ``second`` or ``patient``."""
    both = (first.select(key, F.col("acc").alias("acc_first"))
            .join(second.select(key, F.col("acc").alias("acc_second")), key)
            .withColumn("mean_acc", 0.5 * (F.col("acc_first") + F.col("acc_second")))
            .withColumn("pattern", pattern(F.col(key))))
    orders = {"mean": "mean_acc", "first": "acc_first", "second": "acc_second", "patient": key}
    return both.orderBy(orders[sort_by], key)


def unpaired(first: DataFrame, second: DataFrame, key: str = "fold") -> DataFrame:
    """Patients present in one representation only."""
    a, b = first.select(key), second.select(key)
    return (a.join(b, key, "left_anti").withColumn("only_in", F.lit("first"))
            .unionByName(b.join(a, key, "left_anti").withColumn("only_in", F.lit("second"))))


def metric_pairs(metrics: DataFrame, first: str, second: str,
                 names: list[str] = ["bacc", "roc_auc", "f1", "pr_auc"]) -> DataFrame:
    """metric, value of each representation; ``metrics`` has a column representation."""
    rows = metrics.unpivot(["representation"], names, "metric", "value")
    pick = lambda r: F.max(F.when(F.col("representation") == r, F.col("value")))
    return rows.groupBy("metric").agg(pick(first).alias("first"), pick(second).alias("second"))


def sweep_table(metrics: DataFrame, usage: DataFrame) -> DataFrame:
    """One row per n_shot: files used and skipped, summed counts, mean and std of every
    metric. ``metrics`` has one row per (n_shot, file), ``usage`` n_shot, n_files_used,
    n_files_skipped; an n_shot without usable files keeps its row."""
    sums = [F.sum(c).alias(f"{c}_sum") for c in C.COUNTS]
    stats = [s for m in C.METRICS for s in (F.avg(nan_to_null(F.col(m))).alias(m),
                                            F.stddev_pop(nan_to_null(F.col(m))).alias(f"{m}_std"))]
    made = usage.join(metrics.groupBy("n_shot").agg(*sums, *stats), "n_shot", "left")
    filled = {f"{c}_sum": F.coalesce(f"{c}_sum", F.lit(0)) for c in C.COUNTS}
    filled |= {n: F.coalesce(n, nan()) for m in C.METRICS for n in (m, f"{m}_std")}
    return made.withColumns(filled)
