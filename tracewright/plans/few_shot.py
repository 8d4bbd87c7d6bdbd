"""Few-shot sweep: one small model per file and n."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tracewright import constants as C
from tracewright.functions import forest
from tracewright.operators import metrics as M, splits as S
from tracewright.plans.model import BoostParams
from tracewright.plans.tables import materialize

BATCH_ROWS = 20_000


def few_shot_models(rows: DataFrame, names: list[str], max_shots: int, params: BoostParams, file: str) -> DataFrame:
    """file, n_shot, pos_cut, neg_cut and the model of every usable (file, n), fitted once on its at most 2 n
    training rows; every model is a group of its own."""
    limits = S.shot_limits(rows, max_shots, file).filter("usable").select(file, "n_shot", "pos_cut", "neg_cut")
    widest = limits.groupBy(file).agg(F.max("pos_cut").alias("_p"), F.max("neg_cut").alias("_n"))
    own = F.when(F.col("y") == 1, F.col("_p")).otherwise(F.col("_n"))
    shots = (rows.select(file, "row_idx", "y", *[F.col(n).cast("double").alias(n) for n in names]).join(widest, file)
             .filter(F.col("row_idx") <= own).drop("_p", "_n"))
    cut = F.when(F.col("y") == 1, F.col("pos_cut")).otherwise(F.col("neg_cut"))
    train = shots.join(limits, file).filter(F.col("row_idx") <= cut)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row_idx")
        y = part["y"].to_numpy(float)
        model, _ = forest.fit(part[names].to_numpy(float), y, forest.balanced(y), params.rounds, params.rate, params.depth,
                              params.row_share, params.column_share, params.max_bins, params.seed)
        return part[[file, "n_shot", "pos_cut", "neg_cut"]].iloc[:1].assign(model=[model.to_bytes()])

    made = train.groupBy(file, "n_shot").applyInPandas(
        fit, f"{file} string, n_shot int, pos_cut bigint, neg_cut bigint, model binary")
    return materialize(made, "few-shot-models")


def few_shot_scores(rows: DataFrame, names: list[str] = C.FEATURES, max_shots: int = C.MAX_SHOTS,
                    params: BoostParams = BoostParams(row_share=1.0), file: str = "source") -> DataFrame:
    """file, n_shot, row_idx, y, proba for the test rows of every usable (file, n).

    The models of a file (at most ``max_shots``) meet its rows batch by batch; a batch is a fixed range of
    row_idx, so a large file spreads over tasks and no task holds more than a batch.
    """
    models = few_shot_models(rows, names, max_shots, params, file)
    batch = F.floor(F.col("row_idx") / BATCH_ROWS).cast("bigint").alias("batch")
    tested = rows.select(file, "row_idx", "y", *[F.col(n).cast("double").alias(n) for n in names], batch)
    ready = models.join(tested.select(file, "batch").distinct(), file).withColumnsRenamed({file: "_file", "batch": "_batch"})

    def score(key, test: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        x, parts = test[names].to_numpy(float), []
        for m in own.sort_values("n_shot").itertuples():
            rest = (test["row_idx"] > np.where(test["y"] == 1, m.pos_cut, m.neg_cut)).to_numpy()
            p = forest.Forest.of(m.model).probability(x[rest])
            parts.append(test.loc[rest, [file, "row_idx", "y"]].assign(n_shot=int(m.n_shot), proba=p))
        cols = [file, "n_shot", "row_idx", "y", "proba"]
        return pd.concat(parts)[cols] if parts else pd.DataFrame(columns=cols)

    schema = f"{file} string, n_shot int, row_idx bigint, y int, proba double"
    return (tested.groupBy(file, "batch").cogroup(ready.groupBy("_file", "_batch"))
            .applyInPandas(score, schema))


def few_shot_sweep(rows: DataFrame, names: list[str] = C.FEATURES, max_shots: int = C.MAX_SHOTS,
                   params: BoostParams = BoostParams(row_share=1.0), file: str = "source") -> DataFrame:
    """One row per n: files used and skipped, summed counts, mean and std of the metrics."""
    scored = materialize(few_shot_scores(rows, names, max_shots, params, file), "few-shot")
    usage = S.shot_usage(S.shot_limits(rows, max_shots, file))
    return M.sweep_table(M.fold_metrics(scored, ["n_shot", file]), usage).orderBy("n_shot")
