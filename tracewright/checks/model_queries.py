"""Queries that train models or run whole extractions, at the published settings. Only what does not depend on
a model has SQL; the tests
check them against sequential code on small fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracewright import constants as C
from tracewright.checks import views as V
from tracewright.checks.views import r, rs
from tracewright.operators.cleaning import PredictionWeights
from tracewright.operators import features as X, metrics as M, segments as S, windows as W
from tracewright.operators.quantiles import quantile_rows, summaries
from tracewright.plans import (boosting as B, evaluate as E, extract as P, few_shot as FS, model as L, relabel as RL,
                               task_models as T)
from tracewright.plans.tables import materialize
from tracewright.session import scratch_path
from tracewright.sources.tables import embedding_columns, read_dataset, read_embeddings

# all three rules are on; the channels of these signals are independent, so the limits are low
LIMITS = P.Detection(correlation=0.05, correlation_share=0.5, prediction=-0.5, prediction_share=0.4)
RATES = P.Rates(source=256.0, chunk_len=V.CHUNK)
CANONICAL = ["Fp1", "Fp2", "F7", "T7", "C3", "Pz", "O1", "O2"]
CHANNELS = ["EEG Fp1", "EEG Fp2", "EEG F7", "EEG T3", "EEG C3", "EEG Pz", "EEG O1", "EEG O2"]


PREDICTIONS = PredictionWeights.of(
    (k, a, b, ((i * 5 + j * 3 + k * 7) % 11 - 3) / 10.0) for k in range(6)
    for i, a in enumerate(CANONICAL) for j, b in enumerate(CANONICAL) if i != j)


def handcrafted(spark, sf) -> DataFrame:
    """16 features of every embedding row, with patient, file and label."""
    rows = V.embedding_rows(spark, sf).withColumn("x", F.col("emb").cast("array<double>")).drop("emb")
    return materialize(X.window_features(rows, V.FS), "handcrafted")


def embedded(spark, sf) -> tuple[DataFrame, list[str]]:
    rows = read_embeddings(V.embedding_rows(spark, sf), 64)
    wide, names = embedding_columns(rows, 64)
    return materialize(wide, "embedded"), names


def gbt_lopo(spark, sf):
    return E.leave_one_out(handcrafted(spark, sf)).metrics()


def gbt_importance(spark, sf):
    return L.importance_summary(E.leave_one_out(handcrafted(spark, sf)).importances)


def gbt_seeded(spark, sf):
    return E.seeded(handcrafted(spark, sf)).metrics()


def gbt_patterns(spark, sf):
    done = E.within_patterns(handcrafted(spark, sf))
    parts = [e.metrics().withColumn("pattern", F.lit(g)) for g, e in sorted(done.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gbt_holdout(spark, sf):
    """Both representations on all rows."""
    tables = ((handcrafted(spark, sf), E.HANDCRAFTED), (V.embedding_rows(spark, sf), E.EMBEDDING))
    first, second = (E.hold_out(d, d, rep) for d, rep in tables)
    return E.compare_hold_out(first, second, ("handcrafted", "embedding"))


def gbt_paired(spark, sf):
    emb, names = embedded(spark, sf)
    first = E.leave_one_out(handcrafted(spark, sf)).metrics()
    second = E.leave_one_out(emb, names, normalize=False).metrics()
    return M.paired(first, second)


def few_shot_sweep(spark, sf):
    return FS.few_shot_sweep(handcrafted(spark, sf))


def _sizes(metrics, keys):
    return metrics.select(*keys, (F.col("tp") + F.col("fn")).alias("n_pos"), (F.col("fp") + F.col("tn")).alias("n_neg"))


def gbt_lopo_sizes(spark, sf):
    """Rows of both classes that the folds of a real run scored."""
    return _sizes(E.leave_one_out(handcrafted(spark, sf)).metrics(), ["fold"])


def gbt_seeded_sizes(spark, sf):
    return _sizes(E.seeded(handcrafted(spark, sf)).metrics(), ["fold"])


def gbt_importance_sums(spark, sf):
    """Importances of a fold: one for each feature, together 1."""
    found = E.leave_one_out(handcrafted(spark, sf)).importances
    return found.groupBy("fold").agg(F.count_distinct("feature").alias("n"), F.round(F.sum("importance"), 6).alias("total"))


GRID = [f"g{j}" for j in range(8)]


def gbt_first_split(spark, sf):
    """The first split of the first tree of every fold, on all rows: eight embedding columns in steps of 1/16."""
    rows = V.embedding_rows(spark, sf).select("patient_id", "source", "row_idx", "y", *[
        F.floor(F.col("emb")[j].cast("double") * 16).cast("double").alias(n) for j, n in enumerate(GRID)])
    params = L.BoostParams(rounds=1, depth=1, row_share=1.0, column_share=1.0, train_rows=None)
    models = B.fit_folds(rows, T.no_seeds(rows), GRID, params)
    nodes = B.tree_nodes(models, GRID).filter("tree = 0")
    left, right = (nodes.filter(F.col("node") == i).select("fold", F.col("value").alias(n))
                   for i, n in ((1, "left_value"), (2, "right_value")))
    root = nodes.filter("node = 0 AND feature IS NOT NULL").select("fold", "feature", "threshold")
    return root.join(left, "fold").join(right, "fold").select("fold", "feature", r("threshold", 6).alias("bound"),
                                                             r("left_value", 6).alias("left_value"), r("right_value", 6).alias("right_value"))


def gbt_all_rows(spark, sf):
    """Leave-one-out with models of ten rounds that see all rows of their folds."""
    params = L.BoostParams(rounds=10, rate=0.3, train_rows=None)
    return E.leave_one_out(handcrafted(spark, sf), params=params).metrics()


def feature_summaries(spark, sf):
    """Rows behind the quantile summary of every feature, and whether its median is one to a twentieth of the rows."""
    rows = handcrafted(spark, sf)
    found = quantile_rows(summaries(rows, C.FEATURES, size=512, fan_in=4), [0.5])
    ranks = found.select(F.col("name").alias("_name"), "value")
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("v")) for n in C.FEATURES])).alias("e"))
    known = long.select("e.name", "e.v").filter(~F.isnan("v")).join(ranks, F.col("name") == F.col("_name"))
    n, slack = F.count(F.lit(1)), F.count(F.lit(1)) / 20 + 1
    near = (F.count_if(F.col("v") < F.col("value")) <= n / 2 + slack) & (F.count_if(F.col("v") <= F.col("value")) >= n / 2 - slack)
    return known.groupBy("name").agg(n.alias("n_rows"), near.alias("median_near"))


def few_shot_coverage(spark, sf):
    """Rows that the models of every file and n scored."""
    return FS.few_shot_scores(handcrafted(spark, sf)).groupBy("source", "n_shot").agg(
        F.count_distinct("row_idx").alias("n_rows"), F.sum("y").alias("n_pos"))


def signals(spark, sf) -> DataFrame:
    """The recordings as raw 256 Hz signals with raw channel names."""
    name = F.element_at(F.array(*[F.lit(c) for c in CHANNELS]), F.substring("channel", 2, 1).cast("int") + 1)
    return V.chunks(spark, sf).withColumn("channel", name)


def signal_annotations(spark, sf) -> DataFrame:
    """Two segments and, by the label of every chunk, marks."""
    e = V.table(spark, sf, "embeddings").filter("vec_id % 8 = 0").select(
        F.expr("vec_id div 80").alias("recording_id"), (F.expr("(vec_id div 8) % 10")).alias("chunk"), "label")
    kind = F.col("label") % 3
    own = e.select("recording_id", (F.col("chunk") + 10).alias("ord"), (F.col("chunk") * 0.25 + 0.1).alias("onset_sec"),
                   F.when(kind == 0, "*").when(kind == 1, "-").otherwise("remark").alias("description"))
    fixed = F.explode(F.array(*[F.struct(F.lit(o).cast("bigint").alias("ord"), F.lit(t).alias("onset_sec"), F.lit(d).alias("description"))
                                for o, t, d in ((0, 0.05, "Note : PD_START"), (1, 1.31, "PD_STOP "), (2, 1.34, "NON_PD_START"), (30, 2.44, "NON_PD_STOP"))]))
    marks = e.filter("chunk = 0").select("recording_id", fixed.alias("a")).select("recording_id", "a.*")
    return own.unionByName(marks)


def signal_weights(spark, sf) -> DataFrame:
    """Bad set of the report, replaced by the mean of the other channels."""
    names = signals(spark, sf).select(F.trim(F.replace("channel", F.lit("EEG "), F.lit(""))).alias("src_channel")).distinct()
    return names.filter("src_channel <> 'C3'").select(
        F.lit("C3").alias("bad_set"), F.lit("C3").alias("bad_channel"), "src_channel", F.lit(1 / 7).alias("w"))


def signal_report(spark, sf) -> DataFrame:
    ids = signals(spark, sf).select("recording_id").distinct().filter("recording_id % 2 = 0")
    return ids.select("recording_id", F.lit("correlation").alias("category"), F.lit("C3").alias("channel"))


def extract_annotated(spark, sf):
    return P.annotation_features(signals(spark, sf), RATES, signal_annotations(spark, sf),
                                 signal_report(spark, sf), signal_weights(spark, sf))


def recordings(spark, sf) -> DataFrame:
    """File names of four patients."""
    ids = signals(spark, sf).select("recording_id").distinct()
    return ids.withColumn("file_name", F.format_string("P%d_rec_%d.edf", 20 + F.col("recording_id") % 4, "recording_id"))


def _dataset(spark, sf) -> DataFrame:
    rows = extract_annotated(spark, sf)
    return materialize(P.feature_dataset(rows, recordings(spark, sf)), "dataset")


def dataset_windows(spark, sf):
    """Windows of the feature dataset: patient, file, number, label and time."""
    return _dataset(spark, sf).select("patient_id", "source", "row_idx", "y", r("time_sec", 6).alias("time_sec"))


def signals_to_metrics(spark, sf):
    """From raw signals and marks to the metrics of every patient."""
    return E.leave_one_out(_dataset(spark, sf)).metrics()


def _crops(spark, sf):
    segs = S.build_segments(signal_annotations(spark, sf))
    return P.clean_crops(signals(spark, sf), RATES, segs, signal_weights(spark, sf), PREDICTIONS, LIMITS)


def extract_sliding(spark, sf):
    return P.sliding_features(_crops(spark, sf), RATES, signal_annotations(spark, sf))


def extract_events(spark, sf):
    return P.event_features(_crops(spark, sf), RATES, signal_annotations(spark, sf))


def _stored_windows(spark, sf) -> DataFrame:
    """Windows of 80 samples with their samples, stored when two thirds of the marks were known."""
    cut = W.slide_chunks(V.chunks(spark, sf), V.CHUNK, 80, 20).withColumn("onset_sec", F.col("s") / F.lit(V.FS))
    path = scratch_path(spark, "stored-windows")
    RL.store_windows(cut, signal_annotations(spark, sf).filter("ord % 3 <> 0"), path)
    return read_dataset(spark, path)


def _relabelled(spark, sf) -> RL.Relabelled:
    there = V.chunks(spark, sf).select("recording_id").distinct().filter("recording_id % 5 <> 4")
    return RL.relabel(_stored_windows(spark, sf), signal_annotations(spark, sf), there, 1.25)


def relabelled_windows(spark, sf):
    w = _relabelled(spark, sf).windows
    return w.select(F.col("recording_id").cast("bigint").alias("recording_id"), "channel", "s", F.size("x").cast("bigint").alias("n"),
                    r(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 8).alias("total"), "label")


def changed_marks(spark, sf):
    return _relabelled(spark, sf).changed.withColumn("recording_id", F.col("recording_id").cast("bigint"))


QUERIES = {f.__name__: f for f in (
    relabelled_windows, changed_marks, gbt_lopo, gbt_importance, gbt_seeded, gbt_patterns, gbt_holdout, gbt_paired, few_shot_sweep,
    gbt_first_split, gbt_all_rows, feature_summaries, gbt_lopo_sizes, gbt_seeded_sizes, gbt_importance_sums, few_shot_coverage,
    extract_annotated, extract_sliding, extract_events, dataset_windows, signals_to_metrics)}

_ROWS = f"""(SELECT vec_id AS row_idx, {V.patient_sql('vec_id')} AS fold, CAST(label = 0 AS INTEGER) AS y,
    {V.patient_sql('vec_id')} || '_rec' || (vec_id // 10 % 2) AS source FROM embeddings)"""
_MARKS = """
SELECT vec_id // 80 AS recording_id, ((vec_id // 8) % 10) * 0.25::DOUBLE + 0.1::DOUBLE AS t, ((vec_id // 8) % 10 + 10) % 3 <> 0 AS old
FROM embeddings WHERE vec_id % 8 = 0 AND label % 3 = 0"""
ORACLE = {
    "relabelled_windows": V.sql(f"""SELECT recording_id, channel, s, count(*) AS n, {rs('sum(v)', 8)} AS total,
            CAST(EXISTS (SELECT 1 FROM fresh f WHERE f.recording_id = w.recording_id AND f.t >= s / 64.0::DOUBLE AND f.t <= s / 64.0::DOUBLE + 1.25::DOUBLE) AS INTEGER) AS label
        FROM (SELECT *, max(idx) OVER (PARTITION BY recording_id, channel) + 1 AS n FROM samples) w, range(0, 561, 20) g(s)
        WHERE idx >= s AND idx < s + 80 AND s + 80 <= n AND recording_id % 5 <> 4 GROUP BY 1, 2, 3""", "samples", extra={"fresh": _MARKS}),
    "changed_marks": V.sql("""SELECT recording_id, count(*) AS n_read, count(*) FILTER (old) AS n_stored FROM fresh
        WHERE recording_id % 5 <> 4 AND recording_id IN (SELECT recording_id FROM samples GROUP BY recording_id HAVING max(idx) >= 79)
        GROUP BY 1 HAVING count(*) <> count(*) FILTER (old)""", "samples", extra={"fresh": _MARKS}),
    "feature_summaries": "SELECT name, (SELECT count(*) FROM embeddings) AS n_rows, true AS median_near FROM (SELECT unnest(["
                         + ", ".join(f"'{n}'" for n in C.FEATURES) + "]) AS name)",
    "gbt_first_split": f"""
        WITH e AS (SELECT {V.patient_sql('vec_id')} AS p, CAST(label = 0 AS INTEGER) AS y, embedding FROM embeddings),
        v AS (SELECT p, y, j - 1 AS j, floor(CAST(embedding[j] AS DOUBLE) * 16) AS v FROM e, range(1, 9) t(j)),
        f AS (SELECT a.p AS fold, (sum(n) - sum(pos)) / sum(pos) AS w FROM (SELECT DISTINCT p FROM e) a
              JOIN (SELECT p, count(*) AS n, sum(y) AS pos FROM e GROUP BY p) b ON a.p <> b.p GROUP BY a.p),
        grid AS (SELECT DISTINCT fold, w, j, v FROM v, f),
        s AS (SELECT g.fold, g.j, g.v, coalesce(sum(CASE WHEN y = 1 THEN -0.5 * w WHEN y = 0 THEN 0.5 END), 0) AS g,
                     coalesce(sum(CASE WHEN y = 1 THEN 0.25 * w WHEN y = 0 THEN 0.25 END), 0) AS h
              FROM grid g LEFT JOIN v ON v.j = g.j AND v.v = g.v AND v.p <> g.fold GROUP BY g.fold, g.j, g.v),
        c AS (SELECT fold, j, v, lead(v) OVER o AS nxt, sum(g) OVER o AS gl, sum(h) OVER o AS hl,
                     sum(g) OVER a AS gt, sum(h) OVER a AS ht
              FROM s WINDOW o AS (PARTITION BY fold, j ORDER BY v), a AS (PARTITION BY fold, j)),
        k AS (SELECT *, round(gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1), 9) AS gain
              FROM c WHERE nxt IS NOT NULL AND hl >= 1 AND ht - hl >= 1),
        best AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY gain DESC, j, v) AS i FROM k WHERE gain > 1e-9)
        SELECT fold, 'g' || j AS feature, {rs('(v + nxt) / 2', 6)} AS bound, {rs('-0.05 * gl / (hl + 1)', 6)} AS left_value,
               {rs('-0.05 * (gt - gl) / (ht - hl + 1)', 6)} AS right_value FROM best WHERE i = 1""",
    "dataset_windows": f"""
        WITH e AS (SELECT vec_id // 80 AS recording_id, (vec_id // 8) % 10 AS chunk, label FROM embeddings WHERE vec_id % 8 = 0),
        n AS (SELECT recording_id, min(n) * 80 // 256 AS n FROM (SELECT vec_id // 80 AS recording_id, vec_id % 8 AS ch, count(*) * 64 AS n
              FROM embeddings GROUP BY 1, 2) GROUP BY 1),
        w AS (SELECT recording_id, chunk * 0.25::DOUBLE + 0.1::DOUBLE AS t, CAST(label % 3 = 0 AS INTEGER) AS y, n FROM e JOIN n USING (recording_id)
              WHERE label % 3 < 2)
        SELECT 'P' || (20 + recording_id % 4) AS patient_id, 'P' || (20 + recording_id % 4) || '_rec_' || recording_id || '.edf' AS source,
               row_number() OVER (PARTITION BY recording_id ORDER BY t) - 1 AS row_idx, y, {rs('t', 6)} AS time_sec
        FROM w WHERE round_even(t * 80, 0) - 40 >= 0 AND round_even(t * 80, 0) + 40 <= n""",
    "gbt_lopo_sizes": f"SELECT fold, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg FROM {_ROWS} GROUP BY 1",
    "gbt_seeded_sizes": f"""SELECT fold, p - least(p, 5) AS n_pos, n - least(n, 5) AS n_neg
        FROM (SELECT fold, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM {_ROWS} GROUP BY 1)""",
    "gbt_importance_sums": f"SELECT DISTINCT fold, CAST(16 AS BIGINT) AS n, CAST(1 AS DOUBLE) AS total FROM {_ROWS}",
    "few_shot_coverage": f"""SELECT source, CAST(k AS INTEGER) AS n_shot, p + n - 2 * k AS n_rows, p - k AS n_pos
        FROM (SELECT source, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM {_ROWS} GROUP BY 1), range(1, 21) r(k)
        WHERE p > k AND n > k""",
}
