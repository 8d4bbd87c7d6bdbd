"""Why does one variant of a dataset separate the classes worse than another?"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tracewright import constants as C
from tracewright.operators import splits as S, stats as N


@dataclass(frozen=True)
class Diagnosis:
    profile: DataFrame      # dataset, feature, auc, sep, d
    balance: DataFrame      # dataset, n, n_pos, n_neg
    auc_table: DataFrame    # feature x dataset
    d_table: DataFrame
    focus: DataFrame
    means: DataFrame        # dataset, mean_sep, mean_abs_d, class counts


def separability_report(train: DataFrame, variants: dict[str, DataFrame], names: list[str] = C.FEATURES,
                        patient: str = C.HOLDOUT_PATIENT) -> Diagnosis:
    """Training rows of all other patients against variants of one patient's rows.
    Rows with the ignore label are dropped; a variant without rows gives none."""
    cols = ["patient_id", "y", *names]
    pooled = S.select_patients(train, exclude=patient).select(F.lit("TRAIN").alias("dataset"), *cols)
    for label, rows in variants.items():
        own = S.select_patients(rows, only=patient).select(F.lit(label).alias("dataset"), *cols)
        pooled = pooled.unionByName(own)
    pooled = N.drop_ignored(pooled)
    profile, balance = N.separability(pooled, names), N.class_balance(pooled)
    order = ["TRAIN", *variants]
    return Diagnosis(profile, balance, N.comparison_table(profile, order, "auc"),
                     N.comparison_table(profile, order, "d"), N.focus(profile),
                     N.mean_separability(profile, balance))
