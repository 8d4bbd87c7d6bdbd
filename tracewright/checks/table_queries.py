"""Queries on group statistics, splits, metrics and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracewright import constants as C
from tracewright.checks import views as V
from tracewright.checks.views import LINE_FEATURES, r, rs, sql
from tracewright.operators import metrics as M, splits as S, stats as N
from tracewright.operators.channels import pattern
from tracewright.session import scratch_path
from tracewright.sources import tables as B

DATASETS = ["TRAIN", "P58_F", "P58_O", "MISSING"]


def _round(df, *names, digits=6):
    return df.withColumns({n: r(n, digits) for n in names})


# --- statistics -------------------------------------------------------------

def zscore_by_patient(spark, sf):
    rows = V.line_rows(spark, sf).select("l_orderkey", "l_linenumber", "patient_id", *LINE_FEATURES)
    return _round(N.zscore(rows, LINE_FEATURES), *LINE_FEATURES)


def feature_stats(spark, sf):
    return _round(N.feature_stats(V.line_rows(spark, sf), LINE_FEATURES), "mean", "std")


def single_feature_auc(spark, sf):
    return _round(N.single_feature_auc(V.line_rows(spark, sf), LINE_FEATURES, ["dataset", "patient_id"]), "auc")


def cohens_d(spark, sf):
    return _round(N.cohens_d(V.line_rows(spark, sf), LINE_FEATURES, ["dataset", "patient_id"]), "d")


def _profile(spark, sf):
    return N.separability(V.line_rows(spark, sf), LINE_FEATURES)


def separability(spark, sf):
    return _round(_profile(spark, sf), "auc", "sep", "d")


def separability_wide(spark, sf):
    wide = N.comparison_table(_profile(spark, sf), DATASETS, "auc")
    return _round(wide, *DATASETS)


def separability_focus(spark, sf):
    return _round(N.focus(_profile(spark, sf), ["l_quantity", "l_tax"]), "auc", "sep", "d")


def separability_mean(spark, sf):
    rows = V.line_rows(spark, sf)
    return _round(N.mean_separability(_profile(spark, sf), N.class_balance(rows)), "mean_sep", "mean_abs_d")


def class_balance(spark, sf):
    return N.class_balance(V.scored(spark, sf), ["patient_id"])


def ignore_filter(spark, sf):
    ignored = F.when(F.col("row_idx") % 3 == 0, F.lit(C.IGNORE_LABEL)).otherwise(F.col("y"))
    return N.drop_ignored(V.scored(spark, sf).withColumn("y", ignored)).select("row_idx", "y")


# --- splits -----------------------------------------------------------------

def lopo_folds(spark, sf):
    return S.fold_table(V.embedding_rows(spark, sf)).withColumn(
        "pos_weight", r(S.class_weight(F.col("train_pos"), F.col("train_neg"))))


def pattern_folds(spark, sf):
    return S.fold_table(S.with_pattern_group(V.embedding_rows(spark, sf)), ["pattern"])


def holdout_split(spark, sf):
    """Two datasets with all rows; the second has other labels."""
    rows = V.embedding_rows(spark, sf).select("row_idx", "patient_id", "y")
    train, test = S.holdout(rows, rows.withColumn("y", 1 - F.col("y")))
    return train.withColumn("role", F.lit("train")).unionByName(test.withColumn("role", F.lit("test")))


def dataset_filter(spark, sf):
    rows = V.line_rows(spark, sf)
    both = S.select_patients(rows, exclude="P58").withColumn("part", F.lit("others")).unionByName(
        S.select_patients(rows, only="P58").withColumn("part", F.lit("own")))
    return both.groupBy("part", "patient_id").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_pos"))


def few_shot_counts(spark, sf):
    cuts = {c: F.coalesce(c, F.lit(-1).cast("bigint")) for c in ("pos_cut", "neg_cut")}
    return S.shot_limits(V.scored(spark, sf)).withColumns(cuts | {"reason": F.coalesce("reason", F.lit(""))}).drop("n_pos", "n_neg")


def few_shot_split(spark, sf):
    return S.few_shot_split(V.scored(spark, sf).select("source", "row_idx", "y"), 2)


def few_shot_usage(spark, sf):
    return S.shot_usage(S.shot_limits(V.scored(spark, sf)))


def _draw():
    return F.col("row_idx") * 7919 % 10007


def seed_rows(spark, sf):
    rows = V.embedding_rows(spark, sf).select("patient_id", "row_idx", "y")
    return S.seed_rows(rows, draw=_draw())


def seeded_folds(spark, sf):
    rows = V.embedding_rows(spark, sf).select("patient_id", "row_idx", "y")
    t = S.seeded_fold_table(rows, S.seed_rows(rows, draw=_draw()))
    return t.withColumn("pos_weight", r(S.class_weight(F.col("train_pos"), F.col("train_neg"))))


def seeded_weights(spark, sf):
    """Rows of every seeded fold: the others and the seeds train, the rest is tested. Row numbers
    restart in every file."""
    rows = _per_file(V.embedding_rows(spark, sf))
    seeds, out = S.seed_rows(rows, draw=_draw()), None
    for p in V.PATIENTS:
        train, test = S.seeded_split(rows, seeds, p)
        fold = train.withColumn("role", F.lit("train")).unionByName(
            test.withColumn("weight", F.lit(0.0)).withColumn("role", F.lit("test"))).withColumn("fold", F.lit(p))
        out = fold if out is None else out.unionByName(fold)
    return out


def _per_file(rows):
    """The rows with numbers that count from 0 in every file: ten windows in turn belong to a file."""
    return rows.select("patient_id", "source", F.expr("row_idx div 20").alias("row_idx"), "y")


# --- metrics ----------------------------------------------------------------

def _metrics(spark, sf):
    return M.fold_metrics(V.scored(spark, sf))


def _second(spark, sf):
    """Second representation: other scores, one patient fewer."""
    rows = V.scored(spark, sf).withColumn("proba", F.col("proba2")).filter("fold <> 'P20'")
    return M.fold_metrics(rows)


def fold_metrics(spark, sf):
    return _round(_metrics(spark, sf), *C.METRICS)


def roc_pr(spark, sf):
    """Per recording, where some have one class only."""
    rows = V.scored(spark, sf).withColumn("source", F.concat("source", F.lit("_"), F.expr("row_idx div 40 % 10")))
    return _round(M.rank_metrics(rows, ["source"]), "roc_auc", "pr_auc")


def fold_summary(spark, sf):
    return _round(M.summary(_metrics(spark, sf)), "mean", "std")


def aggregate_confusion(spark, sf):
    return M.total_confusion(_metrics(spark, sf))


def worst_folds(spark, sf):
    return _round(M.worst_folds(_round(_metrics(spark, sf), "f1", "precision", "recall")), "f1")


def hard_errors(spark, sf):
    return M.hard_errors(V.scored(spark, sf), ["fold"]).withColumn("proba", r("proba", 8))


def hard_errors_overall(spark, sf):
    return M.hard_errors(V.scored(spark, sf), k=7).withColumn("proba", r("proba", 8))


def _through_file(made: DataFrame, name: str) -> DataFrame:
    """The result as written to its file and read again."""
    path = scratch_path(made.sparkSession, name)
    B.write_csv(made, path, single_file=True)
    return B.read_csv(made, path)


def hard_error_file(spark, sf):
    return _through_file(hard_errors(spark, sf), "hard-errors")


def sweep_file(spark, sf):
    return _through_file(sweep_table(spark, sf), "sweep")


def holdout_file(spark, sf):
    return _through_file(metric_pairs(spark, sf), "hold-out")


def accuracy_by_patient(spark, sf):
    return _round(M.accuracy_by_patient(_metrics(spark, sf)), "acc")


def paired_representation(spark, sf):
    return _round(M.paired(_metrics(spark, sf), _second(spark, sf)), "acc_first", "acc_second", "mean_acc")


def unpaired_patients(spark, sf):
    return M.unpaired(_metrics(spark, sf), _second(spark, sf))


def metric_pairs(spark, sf):
    """Both representations over all patients pooled."""
    rows = V.scored(spark, sf)
    both = rows.withColumn("representation", F.lit("handcrafted")).unionByName(
        rows.withColumn("proba", F.col("proba2")).withColumn("representation", F.lit("embedding")))
    pairs = M.metric_pairs(M.fold_metrics(both, ["representation"]), "handcrafted", "embedding")
    return _round(pairs, "first", "second")


def sweep_table(spark, sf):
    """Few-shot sweep on the given scores: metrics of every file's test rows per n."""
    rows = V.scored(spark, sf)
    limits = S.shot_limits(rows)
    cut = F.when(F.col("y") == 1, F.col("pos_cut")).otherwise(F.col("neg_cut"))
    test = (rows.join(limits.filter("usable").select("source", "n_shot", "pos_cut", "neg_cut"), "source")
            .filter(F.col("row_idx") > cut))
    made = M.sweep_table(M.fold_metrics(test, ["n_shot", "source"]), S.shot_usage(limits))
    return _round(made, *C.METRICS, *[f"{m}_std" for m in C.METRICS])


def pattern_lookup(spark, sf):
    pid = F.when(F.col("row_idx") % 11 == 0, "P99").otherwise(F.col("patient_id"))
    return V.scored(spark, sf).select("row_idx", pattern(pid).alias("pattern"))


QUERIES = {f.__name__: f for f in (
    zscore_by_patient, feature_stats, single_feature_auc, cohens_d, separability, separability_wide,
    separability_focus, separability_mean, class_balance, ignore_filter, lopo_folds, pattern_folds,
    holdout_split, dataset_filter, few_shot_counts, few_shot_split, few_shot_usage, seed_rows, seeded_folds,
    seeded_weights, fold_metrics, roc_pr, fold_summary, aggregate_confusion, worst_folds, hard_errors,
    hard_errors_overall, accuracy_by_patient, paired_representation, unpaired_patients, metric_pairs,
    sweep_table, hard_error_file, sweep_file, holdout_file, pattern_lookup)}

NAN = "CAST('NaN' AS DOUBLE)"


def _auc(keys: str, source: str) -> str:
    """AUC per key of (value, y): wins of positives over negatives, ties one half."""
    return f"""
SELECT {keys}, CASE WHEN max(p) > 0 AND max(n) > 0
       THEN sum(pos * (below + neg / 2.0::DOUBLE)) / (max(p)::DOUBLE * max(n)) ELSE {NAN} END AS auc
FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {keys} ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
             sum(pos) OVER (PARTITION BY {keys}) AS p, sum(neg) OVER (PARTITION BY {keys}) AS n
      FROM (SELECT {keys}, value, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM {source} GROUP BY ALL))
GROUP BY {keys}"""


def _d(keys: str, source: str) -> str:
    return f"""
SELECT {keys}, CASE WHEN np >= 2 AND nq >= 2 AND ((np - 1) * vp + (nq - 1) * vq) > 0
       THEN (mp - mq) / sqrt(((np - 1) * vp + (nq - 1) * vq) / (np + nq - 2)) ELSE {NAN} END AS d
FROM (SELECT {keys}, count(*) FILTER (y = 1) AS np, count(*) FILTER (y = 0) AS nq,
             avg(value) FILTER (y = 1) AS mp, avg(value) FILTER (y = 0) AS mq,
             var_samp(value) FILTER (y = 1) AS vp, var_samp(value) FILTER (y = 0) AS vq FROM {source} GROUP BY {keys})"""


_LONG_PATIENT = f"""
SELECT dataset, patient_id, feature, value, y FROM (SELECT dataset, patient_id, y, {', '.join(LINE_FEATURES)} FROM line_rows)
UNPIVOT (value FOR feature IN ({', '.join(LINE_FEATURES)}))"""
_PROFILE = (f"SELECT dataset, feature, auc, abs(auc - 0.5) AS sep, d FROM ({_auc('dataset, feature', 'line_long')}) "
            f"JOIN ({_d('dataset, feature', 'line_long')}) USING (dataset, feature)")
_EMB = f"SELECT vec_id AS row_idx, {V.patient_sql('vec_id')} AS patient_id, CAST(label = 0 AS INTEGER) AS y FROM embeddings"
_GROUPS = "CASE WHEN patient_id IN ('P20', 'P36', 'P58', 'P73') THEN 'LPD' WHEN patient_id IN ('P48', 'P49', 'P54', 'P70') THEN 'GPD' END"
_PATTERN = ("CASE WHEN {0} IN ('P20', 'P28', 'P36', 'P58', 'P73') THEN 'LPD' WHEN {0} IN ('P48', 'P49', 'P54', 'P70') THEN 'GPD' "
            "WHEN {0} = 'P55' THEN 'LRDA' ELSE 'UNK' END")
_SEEDS = """
SELECT patient_id, row_idx, y FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, y ORDER BY row_idx * 7919 % 10007, row_idx) AS k FROM emb)
WHERE k <= 5"""
_LIMITS = """
SELECT source, n_shot, pos_cut, neg_cut, n_pos >= n_shot AND n_neg >= n_shot AND n_pos > n_shot AND n_neg > n_shot AS usable,
       CASE WHEN n_pos < n_shot OR n_neg < n_shot THEN 'too few rows' WHEN n_pos = n_shot OR n_neg = n_shot THEN 'one class in test' END AS reason
FROM (SELECT source, g.n_shot, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg,
             max(row_idx) FILTER (y = 1 AND k = g.n_shot) AS pos_cut, max(row_idx) FILTER (y = 0 AND k = g.n_shot) AS neg_cut
      FROM (SELECT *, row_number() OVER (PARTITION BY source, y ORDER BY row_idx) AS k FROM scored),
           (SELECT CAST(i AS INTEGER) AS n_shot FROM range(1, 21) t(i)) g GROUP BY 1, 2)"""


def _metrics_sql(keys: str, source: str) -> str:
    """Fold metrics of (keys, y, proba)."""
    return f"""
SELECT {keys}, (tp + tn) / (tp + fp + tn + fn)::DOUBLE AS acc,
       (coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) + coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0))
           / (CAST(tp + fn > 0 AS INTEGER) + CAST(tn + fp > 0 AS INTEGER)) AS bacc,
       coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1,
       coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS "precision", coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall,
       auc AS roc_auc, ap AS pr_auc, tp, fp, tn, fn
FROM (SELECT {keys}, count(*) FILTER (proba >= 0.5 AND y = 1) AS tp, count(*) FILTER (proba >= 0.5 AND y = 0) AS fp,
             count(*) FILTER (proba < 0.5 AND y = 0) AS tn, count(*) FILTER (proba < 0.5 AND y = 1) AS fn FROM {source} GROUP BY {keys})
JOIN ({_rank_sql(keys, source)}) USING ({keys})"""


def _rank_sql(keys: str, source: str) -> str:
    return f"""
SELECT {keys}, CASE WHEN max(p) > 0 AND max(n) > 0 THEN sum(pos * (neg_below + neg / 2.0::DOUBLE)) / (max(p)::DOUBLE * max(n)) ELSE {NAN} END AS auc,
       CASE WHEN max(p) > 0 AND max(n) > 0 THEN sum(pos / p::DOUBLE * (p - pos_below) / (p - pos_below + n - neg_below)::DOUBLE) ELSE {NAN} END AS ap
FROM (SELECT *, coalesce(sum(pos) OVER before, 0) AS pos_below, coalesce(sum(neg) OVER before, 0) AS neg_below,
             sum(pos) OVER (PARTITION BY {keys}) AS p, sum(neg) OVER (PARTITION BY {keys}) AS n
      FROM (SELECT {keys}, proba, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM {source} GROUP BY ALL)
      WINDOW before AS (PARTITION BY {keys} ORDER BY proba ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
GROUP BY {keys}"""


_M1 = _metrics_sql("fold", "scored")
_M2 = _metrics_sql("fold", "(SELECT fold, y, proba2 AS proba FROM scored WHERE fold <> 'P20')")
_ROUNDED = ", ".join(f'{rs(chr(34) + m + chr(34))} AS "{m}"' for m in C.METRICS)
_UNPIVOT = "UNPIVOT (value FOR metric IN (acc, bacc, f1, \"precision\", recall, roc_auc, pr_auc))"
_ERRORS = """
SELECT *, row_number() OVER (PARTITION BY {keys} error_type ORDER BY CASE WHEN y = 0 THEN -proba ELSE proba END, row_idx) AS rank
FROM (SELECT *, CASE WHEN y = 0 THEN 'false_positive' ELSE 'false_negative' END AS error_type, CAST(proba >= 0.5 AS INTEGER) AS y_pred,
             CAST(floor(center_sec) AS BIGINT) AS whole, CAST(floor((center_sec - floor(center_sec)) * 1000) AS BIGINT) AS ms
      FROM scored WHERE y <> CAST(proba >= 0.5 AS INTEGER))"""
_ERROR_COLS = f"""error_type, CAST(rank AS INTEGER) AS rank,
       printf('%02d:%02d:%02d.%03d', whole // 3600, whole // 60 % 60, whole % 60, ms) AS window_center_time,
       y AS y_true, y_pred, {rs('proba', 8)} AS proba, source AS recording_file, row_idx"""

ORACLE = {
    "zscore_by_patient": sql("SELECT l_orderkey, l_linenumber, patient_id, " + ", ".join(
        f"{rs(f'({n} - avg({n}) OVER p) / (stddev_pop({n}) OVER p + 1e-14)')} AS {n}" for n in LINE_FEATURES)
        + " FROM line_rows WINDOW p AS (PARTITION BY patient_id)", "line_rows"),
    "feature_stats": sql(f"SELECT feature, {rs('avg(value)')} AS mean, {rs('stddev_pop(value)')} AS std FROM line_long GROUP BY 1", "line_long"),
    "single_feature_auc": sql(f"SELECT dataset, patient_id, feature, {rs('auc')} AS auc FROM ({_auc('dataset, patient_id, feature', 'lp')})",
                              "line_rows", extra={"lp": _LONG_PATIENT}),
    "cohens_d": sql(f"SELECT dataset, patient_id, feature, {rs('d')} AS d FROM ({_d('dataset, patient_id, feature', 'lp')})",
                    "line_rows", extra={"lp": _LONG_PATIENT}),
    "separability": sql(f"SELECT dataset, feature, {rs('auc')} AS auc, {rs('sep')} AS sep, {rs('d')} AS d FROM prof", "line_long", extra={"prof": _PROFILE}),
    "separability_wide": sql("SELECT feature, " + ", ".join(
        f"{rs(f'max(auc) FILTER (dataset = {d!r})')} AS \"{d}\"" for d in DATASETS) + " FROM prof GROUP BY 1", "line_long", extra={"prof": _PROFILE}),
    "separability_focus": sql(f"SELECT dataset, feature, {rs('auc')} AS auc, {rs('sep')} AS sep, {rs('d')} AS d FROM prof "
                              "WHERE feature IN ('l_quantity', 'l_tax')", "line_long", extra={"prof": _PROFILE}),
    "separability_mean": sql(f"""SELECT dataset, mean_sep, mean_abs_d, n, n_pos, n_neg FROM
        (SELECT dataset, {rs('avg(sep)')} AS mean_sep, {rs('avg(abs(d))')} AS mean_abs_d FROM prof GROUP BY 1)
        JOIN (SELECT dataset, count(*) AS n, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg FROM line_rows GROUP BY 1)
        USING (dataset)""", "line_long", extra={"prof": _PROFILE}),
    "class_balance": sql("SELECT patient_id, count(*) AS n, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg FROM scored GROUP BY 1", "scored"),
    "ignore_filter": sql("SELECT row_idx, y FROM scored WHERE row_idx % 3 <> 0", "scored"),
    "lopo_folds": sql(f"""SELECT fold, test_pos, test_neg, train_pos, train_neg, {rs('coalesce(train_neg / nullif(train_pos, 0)::DOUBLE, 1)')} AS pos_weight
        FROM (SELECT patient_id AS fold, count(*) FILTER (y = 1) AS test_pos, count(*) FILTER (y = 0) AS test_neg,
                     (SELECT count(*) FROM emb o WHERE o.patient_id <> e.patient_id AND y = 1) AS train_pos,
                     (SELECT count(*) FROM emb o WHERE o.patient_id <> e.patient_id AND y = 0) AS train_neg
              FROM emb e GROUP BY 1)""", extra={"emb": _EMB}),
    "pattern_folds": sql("""SELECT pattern, patient_id AS fold, count(*) FILTER (y = 1) AS test_pos, count(*) FILTER (y = 0) AS test_neg,
            (SELECT count(*) FROM g o WHERE o.pattern = e.pattern AND o.patient_id <> e.patient_id AND y = 1) AS train_pos,
            (SELECT count(*) FROM g o WHERE o.pattern = e.pattern AND o.patient_id <> e.patient_id AND y = 0) AS train_neg
        FROM g e GROUP BY 1, 2""", extra={"emb": _EMB, "g": f"SELECT * FROM (SELECT *, {_GROUPS} AS pattern FROM emb) WHERE pattern IS NOT NULL"}),
    "holdout_split": sql("""SELECT row_idx, patient_id, y, 'train' AS role FROM emb WHERE patient_id <> 'P58'
        UNION ALL SELECT row_idx, patient_id, 1 - y, 'test' FROM emb WHERE patient_id = 'P58'""", extra={"emb": _EMB}),
    "dataset_filter": sql("""SELECT CASE WHEN patient_id = 'P58' THEN 'own' ELSE 'others' END AS part, patient_id, count(*) AS n,
        CAST(sum(y) AS BIGINT) AS n_pos FROM line_rows GROUP BY 1, 2""", "line_rows"),
    "few_shot_counts": sql("""SELECT source, n_shot, coalesce(pos_cut, -1) AS pos_cut, coalesce(neg_cut, -1) AS neg_cut, usable,
        coalesce(reason, '') AS reason FROM lim""", "scored", extra={"lim": _LIMITS}),
    "few_shot_split": sql("""SELECT source, row_idx, y, k <= 2 AS is_train
        FROM (SELECT *, row_number() OVER (PARTITION BY source, y ORDER BY row_idx) AS k FROM scored) JOIN lim USING (source)
        WHERE usable AND n_shot = 2""", "scored", extra={"lim": _LIMITS}),
    "few_shot_usage": sql("""SELECT n_shot, count(*) FILTER (usable) AS n_files_used, count(*) FILTER (NOT usable) AS n_files_skipped
        FROM lim GROUP BY 1""", "scored", extra={"lim": _LIMITS}),
    "seed_rows": sql("SELECT patient_id, row_idx, y FROM seeds", extra={"emb": _EMB, "seeds": _SEEDS}),
    "seeded_folds": sql(f"""SELECT *, {rs('coalesce(train_neg / nullif(train_pos, 0)::DOUBLE, 1)')} AS pos_weight
        FROM (SELECT fold, sp AS seed_pos, sn AS seed_neg, p - sp AS test_pos, n - sn AS test_neg,
                     (SELECT count(*) FROM emb WHERE y = 1 AND patient_id <> fold) + sp AS train_pos,
                     (SELECT count(*) FROM emb WHERE y = 0 AND patient_id <> fold) + sn AS train_neg
              FROM (SELECT patient_id AS fold, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM emb GROUP BY 1)
              JOIN (SELECT patient_id AS fold, count(*) FILTER (y = 1) AS sp, count(*) FILTER (y = 0) AS sn FROM seeds GROUP BY 1) USING (fold))""",
                        extra={"emb": _EMB, "seeds": _SEEDS}),
    "seeded_weights": sql("""SELECT fold, patient_id, source, row_idx, y,
            CASE WHEN patient_id <> fold THEN 1.0::DOUBLE WHEN k > 5 THEN 0.0::DOUBLE ELSE 15.0::DOUBLE END AS weight,
            CASE WHEN patient_id <> fold OR k <= 5 THEN 'train' ELSE 'test' END AS role
        FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, y ORDER BY row_idx * 7919 % 10007, source, row_idx) AS k
              FROM (SELECT patient_id, patient_id || '_rec' || (row_idx // 10 % 2) AS source, row_idx // 20 AS row_idx, y FROM emb)),
             (SELECT DISTINCT patient_id AS fold FROM emb)""", extra={"emb": _EMB}),
    "fold_metrics": sql(f"SELECT fold, {_ROUNDED}, tp, fp, tn, fn FROM m", "scored", extra={"m": _M1}),
    "roc_pr": sql(f"SELECT source, {rs('auc')} AS roc_auc, {rs('ap')} AS pr_auc FROM r", "scored",
                  extra={"s": "SELECT source || '_' || (row_idx // 40 % 10) AS source, y, proba FROM scored", "r": _rank_sql("source", "s")}),
    "fold_summary": sql(f"""SELECT metric, {rs('avg(value) FILTER (NOT isnan(value))')} AS mean, {rs('stddev_pop(value) FILTER (NOT isnan(value))')} AS std
        FROM (SELECT * FROM m {_UNPIVOT}) GROUP BY 1""", "scored", extra={"m": _M1}),
    "aggregate_confusion": sql("SELECT " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in C.COUNTS) + " FROM m", "scored", extra={"m": _M1}),
    "worst_folds": sql(f"""SELECT fold, f1, "precision", recall FROM (SELECT fold, {_ROUNDED} FROM m) ORDER BY f1, fold LIMIT 5""", "scored", extra={"m": _M1}),
    "hard_errors": sql(f"SELECT fold, {_ERROR_COLS} FROM e WHERE rank <= 5", "scored", extra={"e": _ERRORS.format(keys="fold,")}),
    "hard_errors_overall": sql(f"SELECT {_ERROR_COLS} FROM e WHERE rank <= 7", "scored", extra={"e": _ERRORS.format(keys="")}),
    "accuracy_by_patient": sql(f"SELECT fold, {_PATTERN.format('fold')} AS pattern, {rs('acc')} AS acc FROM m", "scored", extra={"m": _M1}),
    "paired_representation": sql(f"""SELECT fold, {rs('m.acc')} AS acc_first, {rs('n.acc')} AS acc_second, {rs('0.5::DOUBLE * (m.acc + n.acc)')} AS mean_acc,
        {_PATTERN.format('fold')} AS pattern FROM m JOIN n USING (fold)""", "scored", extra={"m": _M1, "n": _M2}),
    "unpaired_patients": sql("""SELECT fold, 'first' AS only_in FROM m WHERE fold NOT IN (SELECT fold FROM n)
        UNION ALL SELECT fold, 'second' FROM n WHERE fold NOT IN (SELECT fold FROM m)""", "scored", extra={"m": _M1, "n": _M2}),
    "metric_pairs": sql(f"""SELECT metric, {rs("max(value) FILTER (rep = 'a')")} AS first, {rs("max(value) FILTER (rep = 'b')")} AS second
        FROM (SELECT * FROM m {_UNPIVOT}) WHERE metric IN ('bacc', 'roc_auc', 'f1', 'pr_auc') GROUP BY 1""", "scored",
        extra={"b": "SELECT 'a' AS rep, y, proba FROM scored UNION ALL SELECT 'b', y, proba2 FROM scored", "m": _metrics_sql("rep", "b")}),
    "sweep_table": sql("SELECT n_shot, n_files_used, n_files_skipped, " + ", ".join(
        f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}_sum" for c in C.COUNTS) + ", " + ", ".join(
        f'{rs(f"coalesce({agg}({chr(34)}{m}{chr(34)}) FILTER (NOT isnan({chr(34)}{m}{chr(34)})), {NAN})")} AS "{m}{suffix}"'
        for m in C.METRICS for agg, suffix in (("avg", ""), ("stddev_pop", "_std"))) + """
        FROM (SELECT n_shot, count(*) FILTER (usable) AS n_files_used, count(*) FILTER (NOT usable) AS n_files_skipped FROM lim GROUP BY 1)
        LEFT JOIN m USING (n_shot) GROUP BY 1, 2, 3""", "scored", extra={
            "lim": _LIMITS,
            "t": """SELECT n_shot, source, y, proba FROM (SELECT *, row_number() OVER (PARTITION BY source, y ORDER BY row_idx) AS k FROM scored)
                    JOIN lim USING (source) WHERE usable AND k > n_shot""",
            "m": _metrics_sql("n_shot, source", "t")}),
    "pattern_lookup": sql(f"SELECT row_idx, {_PATTERN.format('p')} AS pattern FROM (SELECT row_idx, CASE WHEN row_idx % 11 = 0 THEN 'P99' ELSE patient_id END AS p FROM scored)", "scored"),
}
ORACLE |= {"hard_error_file": ORACLE["hard_errors"], "sweep_file": ORACLE["sweep_table"], "holdout_file": ORACLE["metric_pairs"]}
