"""Train and test splits by patient or by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright import constants as C
from tracewright.operators.channels import lookup


# --- leave one patient out --------------------------------------------------

def fold_table(rows: DataFrame, groups: list[str] = []) -> DataFrame:
    """One row per fold (a test patient): class counts of test and train.

    The train side of a fold is everything else of its group, so its counts are
    totals minus own counts; rows are never multiplied by the folds. With ``groups``
    (e.g. pattern) groups with fewer than two patients give no fold.
    """
    per = rows.groupBy(*groups, F.col("patient_id").alias("fold")).agg(
        F.count_if(F.col("y") == 1).alias("test_pos"), F.count_if(F.col("y") == 0).alias("test_neg"))
    totals = per.groupBy(*groups).agg(F.sum("test_pos").alias("_p"), F.sum("test_neg").alias("_n"),
                                      F.count(F.lit(1)).alias("_patients"))
    joined = per.join(totals, groups) if groups else per.join(F.broadcast(totals))  # one row
    return joined.filter(F.col("_patients") >= 2).select(
        *groups, "fold", "test_pos", "test_neg", (F.col("_p") - F.col("test_pos")).alias("train_pos"),
        (F.col("_n") - F.col("test_neg")).alias("train_neg"))


def split_fold(rows: DataFrame, patient: str) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of one fold."""
    return rows.filter(F.col("patient_id") != patient), rows.filter(F.col("patient_id") == patient)


def with_pattern_group(rows: DataFrame) -> DataFrame:
    """Adds ``pattern`` and keeps the patients of the within-pattern protocol."""
    member = {p: g for g, patients in C.PATTERN_GROUPS.items() for p in patients}
    return (rows.withColumn("pattern", lookup(F.col("patient_id"), member))
            .filter(F.col("pattern").isNotNull()))


def holdout(train_source: DataFrame, test_source: DataFrame,
            patient: str = C.HOLDOUT_PATIENT) -> tuple[DataFrame, DataFrame]:
    """All other patients of one dataset against this patient of another."""
    if set(train_source.columns) != set(test_source.columns):
        raise ValueError("train and test datasets have different columns")
    return (train_source.filter(F.col("patient_id") != patient),
            test_source.filter(F.col("patient_id") == patient))


def select_patients(rows: DataFrame, only: str | None = None, exclude: str | None = None) -> DataFrame:
    if only:
        rows = rows.filter(F.col("patient_id") == only)
    return rows.filter(F.col("patient_id") != exclude) if exclude else rows


def class_weight(pos: Column, neg: Column) -> Column:
    """Weight of a positive row: negatives / positives, 1 without positives."""
    return F.coalesce(F.try_divide(neg.cast("double"), pos.cast("double")), F.lit(1.0))


# --- few shots per file -----------------------------------------------------

def _first_rows(rows: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """First k rows per key with their rank. Every task keeps k rows per key before
    the shuffle, so a huge file does not gather in one task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k)


def shot_limits(rows: DataFrame, max_shots: int = C.MAX_SHOTS, file: str = "source") -> DataFrame:
    """file, n_shot, pos_cut, neg_cut, n_pos, n_neg, usable, reason.

    ``pos_cut`` is the row_idx of the n-th positive of the file, so a row trains iff
    its row_idx is not above its class's cut. A file is usable when both classes have
    n rows and the rest still holds both classes.
    """
    firsts = _first_rows(rows.select(file, "y", "row_idx"), [file, "y"], ["row_idx"], max_shots)
    cut = lambda y: F.max(F.when(F.col("y") == y, F.col("row_idx")))
    cuts = firsts.groupBy(file, F.col("_rank").cast("int").alias("n_shot")).agg(
        cut(1).alias("pos_cut"), cut(0).alias("neg_cut"))
    sizes = rows.groupBy(file).agg(F.count_if(F.col("y") == 1).alias("n_pos"),
                                   F.count_if(F.col("y") == 0).alias("n_neg"))
    shots = F.explode(F.sequence(F.lit(1), F.lit(max_shots)))
    n = F.col("n_shot")
    reason = (F.when((F.col("n_pos") < n) | (F.col("n_neg") < n), "too few rows")
              .when((F.col("n_pos") == n) | (F.col("n_neg") == n), "one class in test"))
    return (sizes.withColumn("n_shot", shots).join(cuts, [file, "n_shot"], "left")
            .withColumn("reason", reason).withColumn("usable", F.col("reason").isNull())
            .select(file, "n_shot", "pos_cut", "neg_cut", "n_pos", "n_neg", "usable", "reason"))


def few_shot_split(rows: DataFrame, n_shot: int, file: str = "source") -> DataFrame:
    """Rows of the usable files with ``is_train``: first n of each class in row order."""
    limits = (shot_limits(rows, n_shot, file).filter(F.col("usable") & (F.col("n_shot") == n_shot))
              .select(file, "pos_cut", "neg_cut"))
    cut = F.when(F.col("y") == 1, F.col("pos_cut")).otherwise(F.col("neg_cut"))
    return (rows.join(limits, file).withColumn("is_train", F.col("row_idx") <= cut)
            .drop("pos_cut", "neg_cut"))


def shot_usage(limits: DataFrame) -> DataFrame:
    """n_shot, n_files_used, n_files_skipped."""
    return limits.groupBy("n_shot").agg(F.count_if("usable").alias("n_files_used"),
                                        F.count_if(~F.col("usable")).alias("n_files_skipped"))


# --- seed rows of the test patient ------------------------------------------

def seed_rows(rows: DataFrame, k: int = C.SEED_ROWS, seed: int = C.RANDOM_SEED,
              draw: Column | None = None) -> DataFrame:
    """Up to k random rows per class and patient. ``draw`` replaces the seeded hash
    as the random order; file and ``row_idx`` break ties. ``row_idx`` may restart in every file."""
    key = row_key(rows)
    order = draw if draw is not None else F.xxhash64(*key, F.lit(seed))
    picked = _first_rows(rows.withColumn("_draw", order), ["patient_id", "y"], ["_draw", *key], k)
    return picked.drop("_rank", "_draw")


def row_key(rows: DataFrame) -> list[str]:
    """What identifies a row: patient, file (where there is one) and number."""
    return [c for c in ("patient_id", "source", "row_idx") if c in rows.columns]


def seeded_split(rows: DataFrame, seeds: DataFrame, patient: str,
                 seed_weight: float = C.SEED_WEIGHT) -> tuple[DataFrame, DataFrame]:
    """Train: the other patients (weight 1) and the patient's seed rows
    (``seed_weight``). Test: the patient's remaining rows."""
    train, test = split_fold(rows, patient)
    own = seeds.filter(F.col("patient_id") == patient)
    train = train.withColumn("weight", F.lit(1.0)).unionByName(
        own.select(*rows.columns).withColumn("weight", F.lit(float(seed_weight))))
    key = row_key(rows)
    return train, test.join(own.select(*key), key, "left_anti")


def seeded_fold_table(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """Fold table of the seeded protocol: seed counts move from test to train."""
    moved = seeds.groupBy(F.col("patient_id").alias("fold")).agg(
        F.count_if(F.col("y") == 1).alias("seed_pos"), F.count_if(F.col("y") == 0).alias("seed_neg"))
    t = fold_table(rows).join(moved, "fold")
    return t.select("fold", "seed_pos", "seed_neg",
                    (F.col("test_pos") - F.col("seed_pos")).alias("test_pos"),
                    (F.col("test_neg") - F.col("seed_neg")).alias("test_neg"),
                    (F.col("train_pos") + F.col("seed_pos")).alias("train_pos"),
                    (F.col("train_neg") + F.col("seed_neg")).alias("train_neg"))
