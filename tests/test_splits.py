"""Splits against sequential code."""

import numpy as np
from pyspark.sql import functions as F

from tracewright.operators import splits as S

SCHEMA = "patient_id string, source string, row_idx bigint, y int"


def rows_of(seed=0):
    rng = np.random.default_rng(seed)
    out, i = [], 0
    for p, files in (("P1", 2), ("P2", 1), ("P3", 3)):
        for f in range(files):
            for _ in range(int(rng.integers(3, 30))):
                out.append((p, f"{p}_{f}", i, int(rng.random() < 0.4)))
                i += 1
    return out


def test_folds_partition_rows(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA)
    for r in S.fold_table(df).collect():
        test = [x for x in rows if x[0] == r.fold]
        train = [x for x in rows if x[0] != r.fold]
        assert (r.test_pos, r.test_neg) == (sum(x[3] for x in test), sum(1 - x[3] for x in test))
        assert (r.train_pos, r.train_neg) == (sum(x[3] for x in train), sum(1 - x[3] for x in train))
        a, b = S.split_fold(df, r.fold)
        assert a.count() == len(train) and b.count() == len(test)
    assert S.fold_table(df.filter("patient_id = 'P1'")).count() == 0


def test_pattern_groups_need_two_patients(spark):
    df = spark.createDataFrame([("P20", "a", 0, 1), ("P36", "b", 1, 0), ("P48", "c", 2, 1), ("P28", "d", 3, 1)], SCHEMA)
    got = S.fold_table(S.with_pattern_group(df), ["pattern"]).collect()
    assert sorted((r.pattern, r.fold) for r in got) == [("LPD", "P20"), ("LPD", "P36")]


def sequential_shots(rows, source, n):
    own = [r for r in rows if r[1] == source]
    pos, neg = [r[2] for r in own if r[3] == 1], [r[2] for r in own if r[3] == 0]
    if len(pos) < n or len(neg) < n:
        return "too few rows", None
    train = set(pos[:n]) | set(neg[:n])
    if len({r[3] for r in own if r[2] not in train}) < 2:
        return "one class in test", None
    return None, train


def test_few_shot(spark):
    rows = rows_of(1) + [("P9", "P9_0", 10_000 + i, i % 2) for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    limits = {(r.source, r.n_shot): r for r in S.shot_limits(df).collect()}
    files = sorted({r[1] for r in rows})
    assert len(limits) == 20 * len(files)
    for f in files:
        for n in range(1, 21):
            reason, _ = sequential_shots(rows, f, n)
            assert limits[f, n].reason == reason and limits[f, n].usable == (reason is None)
    for n in (1, 3):
        got = {}
        for r in S.few_shot_split(df, n).collect():
            got.setdefault(r.source, {})[r.row_idx] = r.is_train
        for f in files:
            _, train = sequential_shots(rows, f, n)
            assert (f in got) == (train is not None)
            if train:
                assert {i for i, t in got[f].items() if t} == train
                assert len(got[f]) == sum(r[1] == f for r in rows)


def test_limits_keep_few_rows_per_task(spark):
    plan = S.shot_limits(spark.range(1000).select(F.lit("f").alias("source"), F.col("id").alias("row_idx"), (F.col("id") % 2).cast("int").alias("y")))
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()


def test_seeds(spark):
    rows = rows_of(2) + [("P9", "P9_0", 900 + i, int(i < 3)) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    seeds = S.seed_rows(df)
    got = seeds.collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, S.seed_rows(df.repartition(5)).collect()))
    for p in ("P1", "P2", "P3", "P9"):
        for y in (0, 1):
            assert sum(r.patient_id == p and r.y == y for r in got) == min(5, sum(r[0] == p and r[3] == y for r in rows))
    train, test = S.seeded_split(df, seeds, "P9")
    own = {r.row_idx for r in got if r.patient_id == "P9"}
    t = train.collect()
    assert {r.row_idx for r in t if r.weight == 15.0} == own and {r.patient_id for r in t if r.weight == 1.0} == {"P1", "P2", "P3"}
    assert {r.row_idx for r in test.collect()} == {r[2] for r in rows if r[0] == "P9"} - own
    table = {r.fold: r for r in S.seeded_fold_table(df, seeds).collect()}
    assert table["P9"].test_neg == 22 and table["P9"].seed_pos == 3


def test_seeds_with_row_numbers_that_restart(spark):
    rows = [(p, f"{p}_{f}", i, int((i + f) % 3 == 0)) for p in ("P1", "P2") for f in range(3) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    seeds = S.seed_rows(df)
    picked = [(r.patient_id, r.source, r.row_idx) for r in seeds.collect()]
    assert len(set(picked)) == 20
    assert {(s[-1], i) for p, s, i in picked if p == "P1"} != {(s[-1], i) for p, s, i in picked if p == "P2"}
    _, test = S.seeded_split(df, seeds, "P1")
    table = {r.fold: r for r in S.seeded_fold_table(df, seeds).collect()}
    assert test.count() == 50 == table["P1"].test_pos + table["P1"].test_neg


def test_holdout_and_weights(spark):
    df = spark.createDataFrame(rows_of(), SCHEMA)
    train, test = S.holdout(df, df, "P2")
    assert {r.patient_id for r in train.collect()} == {"P1", "P3"} and {r.patient_id for r in test.collect()} == {"P2"}
    w = spark.createDataFrame([(2, 6), (0, 6)], "p int, n int").select(S.class_weight(F.col("p"), F.col("n")).alias("w"))
    assert [r.w for r in w.collect()] == [3.0, 1.0]
