"""Statistics, metrics and rankings against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import metrics as M, stats as N

NAN, INF = float("nan"), float("inf")


def auc(x, y):
    pos, neg = [v for v, t in zip(x, y) if t == 1], [v for v, t in zip(x, y) if t == 0]
    if not pos or not neg:
        return NAN
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def average_precision(p, y):
    if len(set(y)) < 2:
        return NAN
    total, before = sum(y), 0.0
    out = 0.0
    for t in sorted(set(p), reverse=True):
        tp = sum(1 for a, b in zip(p, y) if a >= t and b == 1)
        n = sum(1 for a in p if a >= t)
        out += (tp / total - before) * tp / n
        before = tp / total
    return out


def same(a, b):
    return (np.isnan(a) and np.isnan(b)) or a == pytest.approx(b)


def test_auc_and_effect_size(spark):
    rng = np.random.default_rng(1)
    rows = []
    for d in ("a", "b"):
        for _ in range(150):
            rows.append((d, float(rng.normal()) * 10 ** float(rng.integers(-6, 6)), float(rng.integers(0, 5)), 7.0, int(rng.integers(0, 2))))
    rows += [("a", NAN, INF, 7.0, 1), ("a", -INF, NAN, 7.0, 0), ("one", 1.0, 2.0, 3.0, 1), ("one", 2.0, 2.0, 3.0, 1),
             ("few", 1.0, 2.0, 1.0, 1), ("few", 2.0, 3.0, 1.0, 0), ("none", NAN, NAN, INF, 1), ("none", NAN, 1.0, 1.0, 0)]
    df = spark.createDataFrame(rows, "dataset string, f double, g double, h double, y int")
    got = {(r.dataset, r.feature): r for r in N.separability(df, ["f", "g", "h"]).collect()}
    assert len(got) == 15
    for d in {r[0] for r in rows}:
        for j, name in enumerate("fgh", 1):
            own = [(r[j], r[4]) for r in rows if r[0] == d and np.isfinite(r[j])]
            x, y = [v for v, _ in own], [t for _, t in own]
            assert same(got[d, name].auc, auc(x, y)), (d, name)
            p, q = np.array([v for v, t in own if t == 1]), np.array([v for v, t in own if t == 0])
            want = NAN
            if len(p) >= 2 and len(q) >= 2:
                pooled = np.sqrt(((len(p) - 1) * p.var(ddof=1) + (len(q) - 1) * q.var(ddof=1)) / (len(p) + len(q) - 2))
                want = (p.mean() - q.mean()) / pooled if pooled else NAN
            assert same(got[d, name].d, want), (d, name)
    flipped = df.withColumn("f", -F.col("f"))
    a, b = ({r.dataset: r.auc for r in N.single_feature_auc(x, ["f"]).collect()} for x in (df, flipped))
    assert a["a"] + b["a"] == pytest.approx(1.0)
    means = {r.dataset: r for r in N.mean_separability(N.separability(df, ["f", "g", "h"]), N.class_balance(df)).collect()}
    assert np.isnan(means["one"].mean_sep) and means["a"].n == 152


def test_zscore(spark):
    rows = [("p", 1.0, 5.0, 1.0), ("p", 3.0, 5.0, NAN), ("q", 10.0, 1.0, 2.0), ("q", 14.0, 2.0, 4.0)]
    got = N.zscore(spark.createDataFrame(rows, "patient_id string, a double, b double, c double"), ["a", "b", "c"]).orderBy("patient_id", "a").collect()
    assert [r.a for r in got] == pytest.approx([-1, 1, -1, 1])
    assert [got[0].b, got[1].b] == [0.0, 0.0]
    assert np.isnan(got[0].c) and np.isnan(got[1].c) and got[3].c == pytest.approx(1.0)


def scored(spark, rows):
    return spark.createDataFrame(rows, "fold string, row_idx bigint, y int, proba double")


def test_fold_metrics(spark):
    rng = np.random.default_rng(2)
    rows = [("mixed", i, int(rng.integers(0, 2)), float(rng.integers(0, 12)) / 11) for i in range(80)]
    rows += [("tied", i, i % 2, 0.5) for i in range(6)] + [("pos", i, 1, i / 4) for i in range(5)]
    rows += [("neg", i, 0, i / 4) for i in range(5)] + [("quiet", i, i % 2, 0.1 * i / 10) for i in range(8)]
    got = {r.fold: r for r in M.fold_metrics(scored(spark, rows)).collect()}
    for fold in got:
        y = np.array([r[2] for r in rows if r[0] == fold])
        p = np.array([r[3] for r in rows if r[0] == fold])
        hit = p >= 0.5
        tp, fp, tn, fn = (int(np.sum(v)) for v in (hit & (y == 1), hit & (y == 0), ~hit & (y == 0), ~hit & (y == 1)))
        r = got[fold]
        assert (r.tp, r.fp, r.tn, r.fn) == (tp, fp, tn, fn)
        assert r.acc == pytest.approx((tp + tn) / len(y))
        recalls = [a / b for a, b in ((tp, tp + fn), (tn, tn + fp)) if b]
        assert r.bacc == pytest.approx(np.mean(recalls))
        assert r.precision == pytest.approx(tp / (tp + fp) if tp + fp else 0)
        assert r.recall == pytest.approx(tp / (tp + fn) if tp + fn else 0)
        assert r.f1 == pytest.approx(2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0)
        assert same(r.roc_auc, auc(p, y)) and same(r.pr_auc, average_precision(list(p), list(y)))
    table = M.fold_metrics(scored(spark, rows))
    stats = {r.metric: r for r in M.summary(table).collect()}
    defined = [r.roc_auc for r in got.values() if not np.isnan(r.roc_auc)]
    assert stats["roc_auc"].mean == pytest.approx(np.mean(defined)) and stats["roc_auc"].std == pytest.approx(np.std(defined))
    assert M.total_confusion(table).first().tp == sum(r.tp for r in got.values())
    worst = [r.fold for r in M.worst_folds(table, k=2).collect()]
    assert worst == sorted(got, key=lambda f: (got[f].f1, f))[:2]


def test_hard_errors_order_and_plan(spark):
    rows = [(i, i % 2, p, float(i), f"f{i}") for i, p in enumerate([0.9, 0.2, 0.9, 0.1, 0.6, 0.2, 0.4, 0.7, 0.5])]
    df = spark.createDataFrame(rows, "row_idx bigint, y int, proba double, center_sec double, source string")
    errors = M.hard_errors(df, k=2)
    assert [(r.error_type, r.rank, r.row_idx) for r in errors.orderBy("error_type", "rank").collect()] == [
        ("false_negative", 1, 3), ("false_negative", 2, 1), ("false_positive", 1, 0), ("false_positive", 2, 2)]
    line = M.hard_error_report(errors.filter("error_type = 'false_positive' and rank = 1")).first()
    assert (line.y_proba, line.window_center_time, line.recording_file) == ("0.90000000", "00:00:00.000", "f0")
    assert "WindowGroupLimit" in errors._jdf.queryExecution().executedPlan().toString()


def test_paired_orders_and_unpaired(spark):
    schema = "fold string, acc double"
    a = spark.createDataFrame([("P1", 0.9), ("P20", 0.1), ("P3", 0.5)], schema)
    b = spark.createDataFrame([("P1", 0.2), ("P20", 0.8), ("P4", 0.5)], schema)
    order = lambda by: [r.fold for r in M.paired(a, b, sort_by=by).collect()]
    assert order("first") == ["P20", "P1"] and order("second") == ["P1", "P20"] and order("patient") == ["P1", "P20"]
    assert order("mean") == ["P20", "P1"]
    assert M.paired(a, b).first().pattern == "LPD"
    assert {(r.fold, r.only_in) for r in M.unpaired(a, b).collect()} == {("P3", "first"), ("P4", "second")}


def test_sweep_without_usable_files(spark):
    usage = spark.createDataFrame([(1, 0, 3)], "n_shot int, n_files_used bigint, n_files_skipped bigint")
    empty = M.fold_metrics(spark.createDataFrame([], "n_shot int, source string, y int, proba double"), ["n_shot", "source"])
    row = M.sweep_table(empty, usage).first()
    assert row.tp_sum == 0 and np.isnan(row.acc) and np.isnan(row.acc_std)


@pytest.mark.parametrize("spread", [1e-9, 1e9])
def test_value_ranges_are_even_for_any_spread(spark, spread):
    from tracewright.operators import ordered as O
    n = 200_000
    df = spark.range(n).selectExpr("'k' as k", f"1 + {spread} * (pmod(id * 7919, {n}) / {n}.0d) as v", "cast(id % 3 = 0 as int) as y")
    stored = O.counts_by_value(df, ["k"], "v", {"pos": F.col("y"), "neg": 1 - F.col("y")})
    sizes = [r["count"] for r in stored.groupBy("_bucket").count().collect()]
    assert sum(sizes) == stored.count() and len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8
    won = O.pairs_won(df, ["k"], "v", F.col("y"), 1 - F.col("y")).first()
    pos, neg = -(-n // 3), n - -(-n // 3)
    assert (won.pos, won.neg) == (pos, neg) and abs(won.wins / (pos * neg) - 0.5) < 0.01
