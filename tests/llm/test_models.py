import math
import random
import tempfile
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from text_fixtures import documents, empty, prose, table

from tracewright.llm import lm, ordinal, raking
from tracewright.llm.common import words
from tracewright.plans.tables import shuffles_deleted


def is_held_out(d):
    return d is None or zlib.crc32(str(d).encode()) % 7 == 2


def plain_model(rows, least=(2, 2)):
    """Back-off model with dictionaries."""
    def cut(t):
        return (t.encode().lower().split() if t else []) + [None]
    c1, c2, c3 = Counter(), Counter(), Counter()
    texts = [cut(t) for d, t in rows if not is_held_out(d)]
    for ws in texts:
        c1.update(ws)
        c2.update(zip(ws, ws[1:]))
    k2 = {g: n for g, n in c2.items() if n >= least[0]}
    for ws in texts:
        c3.update(g for g in zip(ws, ws[1:], ws[2:]) if g[:2] in k2 and g[1:] in k2)
    k3 = {g: n for g, n in c3.items() if n >= least[1]}
    total, types = sum(c1.values()), len(c1)

    def p1(w):
        return (c1.get(w, 0) + 1) / (total + types + 1)

    def order(kept, all_counts, context, lower):
        d = lm.discounts(*[sum(n == i for n in all_counts.values()) for i in (1, 2, 3, 4)])
        p = {g: (n - d[min(n, 3) - 1]) / context(g) for g, n in kept.items()}
        a, b = defaultdict(float), defaultdict(float)
        for g, x in p.items():
            a[g[:-1]] += x
            b[g[:-1]] += lower(g[1:])
        return p, {c: max(1 - a[c], 1e-6) / max(1 - b[c], 1e-6) for c in a}

    p2, bow1 = order(k2, c2, lambda g: c1[g[0]], lambda g: p1(g[0]))
    p3, bow2 = order(k3, c3, lambda g: c2[g[:2]], lambda g: p2[g])
    out = []
    for d, t in rows:
        ws, score, base = cut(t), 0.0, 0.0
        for i, w in enumerate(ws):
            base += math.log10(p1(w))
            if i >= 2 and (*ws[i - 2:i], w) in p3:
                score += math.log10(p3[(*ws[i - 2:i], w)])
                continue
            if i >= 2:
                score += math.log10(bow2.get(tuple(ws[i - 2:i]), 1.0))
            if i and (ws[i - 1], w) in p2:
                score += math.log10(p2[ws[i - 1], w])
                continue
            if i:
                score += math.log10(bow1.get((ws[i - 1],), 1.0))
            score += math.log10(p1(w))
        out.append((d, is_held_out(d), len(ws), sum(c1.get(w, 0) > 0 for w in ws), total, base, score))
    return out


def chain(rng, n):
    """Words that depend on the one before."""
    out = ["w0"]
    for _ in range(n):
        out.append(f"w{(7 * int(out[-1][1:]) + rng.randrange(3)) % 60}")
    return " ".join(out)


# small shards and chunks, so that contexts and levels lie in several files
SMALL = lm.TrieRule(shard_words=16, shard_grams=40, chunk_tokens=300, memo_words=50)


@pytest.mark.parametrize("rule", [lm.TrieRule(), SMALL, lm.TrieRule(least=(2, 2)), lm.TrieRule(least=(3, 2), shard_grams=97)])
def test_language_model(spark, rule):
    rng = random.Random(6)
    rows = documents(30) + [(500 + i, chain(rng, rng.randrange(5, 120)), "en", "s") for i in range(60)]
    rows += [(700 + i, "the " * 40 + f"x{i} the end", "en", "s") for i in range(25)]        # one hot context
    got = lm.train_and_score(table(spark, rows), rule).collect()
    want = plain_model([(d, t) for d, t, _, _ in rows], rule.least)
    assert len(got) == len(rows)
    key = lambda x: (str(x[0]), x[2], x[5])
    for g, w in zip(sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key),
                    sorted(want, key=key)):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert abs(g[6] - w[6]) <= 0.04 * w[2]             # quantised
    held = [r for r in got if r.held_out and r.doc_id and 500 <= r.doc_id < 700]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_without_training_rows(spark):
    assert lm.train_and_score(empty(spark)).count() == 0
    row = lm.train_and_score(table(spark, [(None, "a b a b", "en", "s")])).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (True, 5, 0, 0, 0.0, 0.0)


def labelled(n, seed):
    rng = random.Random(seed)
    bad = ["scum", "idiot", "vile1", "vile2"]
    rows, labels = [], []
    for i in range(n):
        ws = prose(rng, rng.randrange(30, 150)).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(1 + i % 4):
                ws.insert(rng.randrange(len(ws)), rng.choice(bad) + rng.choice(["", ",", "."]))
        rows.append((i, " ".join(ws), "en", "s"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_ordinal_on_held_out_rows(spark):
    rows, labels = labelled(900, 1)
    known = [x for x in labels if x[0] < 600] + [(3, 1, None), (None, 1, 1), (99999, 0, 1)]
    extra = [r for r in documents() if r[0] is None or not r[1]]
    got = ordinal.severity(table(spark, rows + extra), spark.createDataFrame(known, LABELS)).toPandas()
    assert len(got) == len(rows) + len(extra)
    new = got[(got["doc_id"] >= 600) & (got["doc_id"] < 900)]
    truth = new["doc_id"] % 5 == 0
    assert new["toxic"][truth].mean() >= 0.9 and new["toxic"][~truth].mean() < 0.01
    assert ((got["severity"] - got["p_mild"] - got["p_severe"]).abs() < 1e-12).all()
    assert (got["p_mild"] >= got["p_severe"]).all() and set(got["grade"]) == {0, 1, 2}
    assert not got["toxic"][got["doc_id"].isna()].any()


def test_ordinal_model_recovers_weights():
    rng = np.random.default_rng(0)
    keys = np.arange(1, 41, dtype=np.uint64)
    true = np.where(keys <= 4, 2.5, 0.0)
    rows, grades = [], []
    for _ in range(3000):
        x = keys[rng.random(40) < 0.25]
        z = true[x.astype(int) - 1].sum() + rng.logistic()
        rows.append(x)
        grades.append(int(z > 3) + int(z > 6))
    m = ordinal.fit(rows, np.array(grades), ordinal.FitRule(l1=5e-3))
    weight = dict(zip(m.keys.tolist(), m.weights))
    assert all(abs(weight[k] - 2.5) < 0.4 for k in (1, 2, 3, 4)) and m.thresholds[0] < m.thresholds[1]
    assert all(abs(weight.get(k, 0.0)) < 0.3 for k in range(5, 41))


def newton(x, target, l2, steps=60):
    """Weights and thresholds of the cumulative-link model, by Newton steps on the dense system."""
    n, width = x.shape
    levels = target.shape[1]
    design = [np.hstack([x, -np.eye(levels)[np.full(n, k)]]) for k in range(levels)]
    v, ridge = np.concatenate([np.zeros(width), np.arange(levels, dtype=float)]), np.diag([l2] * width + [0.0] * levels)
    for _ in range(steps):
        grad, hess = ridge @ v, ridge.copy()
        for k, d in enumerate(design):
            p = 1 / (1 + np.exp(-d @ v))
            grad = grad + d.T @ (p - target[:, k]) / n
            hess = hess + (d * (p * (1 - p))[:, None]).T @ d / n
        v = v - np.linalg.solve(hess, grad)
    return v[:width], v[width:]


def test_ordinal_fit_against_dense_newton():
    rng = np.random.default_rng(5)
    x = (rng.random((300, 6)) < 0.4).astype(float)
    score = x @ [1.5, -1.0, 0.8, 0.0, 0.4, -0.3] + rng.logistic(size=300)
    target = np.stack([score > 0.4, score > 1.6], 1).astype(float)
    row, col = np.nonzero(x)
    w, th = ordinal._solve(col, row, 300, 6, target, np.array([0.0, 1.0]), 0.0, 0.01, 4000)
    want_w, want_th = newton(x, target, 0.01)
    assert np.allclose(w, want_w, atol=1e-4) and np.allclose(th, want_th, atol=1e-4) and th[0] < th[1]


def test_ordinal_scores_against_plain_sums(spark):
    """All rows of a table, with repeated ids and null texts, from the model's own weights by plain sums."""
    docs, labels = labelled(300, 8)
    rows = docs + [(docs[0][0], docs[1][1], "en", "s"), (9001, None, "en", "s"), (None, docs[2][1], "en", "s")]
    given, marks = table(spark, rows), spark.createDataFrame(labels, LABELS)
    model = ordinal.train(given, marks)
    again = ordinal.train(given.repartition(5), marks)
    assert np.array_equal(model.keys, again.keys) and np.allclose(model.weights, again.weights)
    weight = dict(zip(model.keys.tolist(), model.weights.tolist()))
    want = []
    for d, text, *_ in rows:
        s = sum(weight.get(k, 0.0) for k in ordinal.features(text).tolist())
        p = [1 / (1 + np.exp(t - s)) for t in model.thresholds]
        want.append((-1 if d is None else d, round(p[0], 9), round(p[1], 9)))
    got = [(-1 if r.doc_id is None else r.doc_id, round(r.p_mild, 9), round(r.p_severe, 9)) for r in ordinal.severity(given, marks).collect()]
    assert sorted(got) == sorted(want)


def test_ordinal_with_nothing_to_learn(spark):
    rows, _ = labelled(20, 2)
    none = spark.createDataFrame([], LABELS)
    got = ordinal.severity(table(spark, rows), none).toPandas()
    assert len(got) == 20 and not got["toxic"].any() and got["severity"].nunique() == 1
    assert ordinal.severity(empty(spark), none).count() == 0
    one = spark.createDataFrame([(i, 1, 0) for i in range(20)], LABELS)
    assert not ordinal.severity(table(spark, rows), one).toPandas()["toxic"].any()


def plain_rake(cells, targets, sweeps=400):
    """cells: frame with the dimensions and w."""
    f = cells["w"].astype(float).copy()
    total = f.sum()
    for _ in range(sweeps):
        for d, goal in targets.items():
            have = f.groupby(cells[d]).transform("sum")
            f = f * cells[d].map(goal) * total / have.where(have > 0, 1.0)
    return f


def tempered(cells, d, power):
    w = cells.groupby(d)["w"].sum() ** power
    return (w / w.sum()).to_dict()


@pytest.mark.parametrize("given", [False, True])
def test_raking(spark, given):
    shares = {"source": {"=s0": 0.5, "=s1": 0.3, "=s2": 0.2, "null": 0.1, "=nowhere": 1.0},
              "lang": {"=en": 0.6, "=de": 0.4, "null": 0.05, "=fr": 0.05}} if given else {}
    rule = raking.Mix(source=0.5, lang=0.6, topic=0.7, shares=shares, tolerance=1e-7, sweeps=300)
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.choice([30, 80, 1100][:2 + (i % 40 == 0)])), rng.choice(["en", "de", "en", "fr", None]),
             rng.choice(["s0", "s0", "s1", "s2", None])) for i in range(900)]
    rows += [r for r in documents() if not r[1]] + [rows[3]]
    got = raking.mixture(table(spark, rows), rule).toPandas()
    assert len(got) == len(rows)
    for c in ("source", "lang"):
        got[c] = got[c].map(lambda v: "null" if v is None else f"={v}")
    cells = got[got["n_tokens"] > 0].groupby(["source", "lang", "topic"], as_index=False).agg(
        w=("n_tokens", "sum"), factor=("factor", "first"))
    targets = {}
    for d, power in (("source", 0.5), ("lang", 0.6), ("topic", 0.7)):
        if d in shares:
            part = {v: shares[d].get(v, 0.0) for v in cells[d].unique()}
            targets[d] = {v: x / sum(part.values()) for v, x in part.items()}
        else:
            targets[d] = tempered(cells, d, power)
    want = plain_rake(cells, targets)
    scale = want.sum() / (cells["w"] * cells["factor"]).sum()
    assert np.allclose(cells["w"] * cells["factor"] * scale, want, rtol=2e-3, atol=1e-6 * want.sum())
    assert got["probability"].max() == pytest.approx(1.0) and (got["probability"] <= 1 + 1e-9).all()
    assert (got["probability"][got["n_tokens"] == 0] == 0).all() and not got["selected"][got["n_tokens"] == 0].any()
    assert (got.loc[got["probability"] >= 1 - 1e-12, "selected"]).all()


def test_sample_has_the_target_shares(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 50), "en" if rng.random() < 0.7 else "de", "big" if rng.random() < 0.6 else f"s{i % 5}")
            for i in range(6000)]
    rule = raking.Mix(source=0.5, lang=0.5, topic=1.0)
    docs = table(spark, rows)
    kept = raking.keep_sample(docs, rule)
    assert kept.dtypes == docs.dtypes
    share = kept.toPandas()["lang"].value_counts(normalize=True)
    now = pd.Series([r[2] for r in rows]).value_counts(normalize=True) ** 0.5
    assert abs(share["en"] - (now / now.sum())["en"]) < 0.03
    chosen = {r.doc_id for r in raking.mixture(docs, rule).filter("selected").collect()}
    assert chosen == {r.doc_id for r in kept.collect()}


def test_raking_awkward_tables(spark):
    got = raking.mixture(table(spark)).toPandas()          # targets that cannot be met
    assert len(got) == len(documents()) and got["factor"].max() <= 10.0
    assert raking.mixture(empty(spark)).count() == 0 and raking.keep_sample(empty(spark)).count() == 0


@pytest.mark.parametrize("trim", [1e6, 7.7, 6.0])
def test_raking_inside_the_bound(spark, trim):
    """Without a bound one cell needs the factor 7.858; others make up for it at 7.7, and at 6 a known error remains."""
    cells = spark.createDataFrame([("a", "en", "t", 900.0), ("a", "de", "t", 10.0), ("b", "en", "t", 50.0), ("b", "de", "t", 90.0)],
                                  "source string, lang string, topic string, weight double")
    rule = raking.Mix(source=1.0, topic=1.0, shares={"lang": {"de": 0.2, "en": 0.8}}, tolerance=2e-5, sweeps=120, trim=trim)
    fit = raking.cell_factors(cells, rule)
    f = {(r.source, r.lang): r.factor for r in fit.factors.collect()}
    de, a, b = 10 * f["a", "de"] + 90 * f["b", "de"], 900 * f["a", "en"] + 10 * f["a", "de"], 50 * f["b", "en"] + 90 * f["b", "de"]
    assert max(f.values()) <= trim and fit.largest == max(f.values())
    assert a == pytest.approx(910, rel=1e-4) and b == pytest.approx(140, rel=1e-4)
    if trim > 7:
        assert de == pytest.approx(210, rel=1e-3) and max(fit.errors.values()) < 1e-4
        # raking keeps the odds ratio r: x (x - 70) = r (910 - x) (210 - x) for the weight x of the cell
        r = 10 * 50 / (900 * 90)
        x = max(np.roots([1 - r, -70 + 1120 * r, -910 * 210 * r]))
        assert f["a", "de"] == pytest.approx(min(x / 10, trim), abs=0.02)
    else:
        assert fit.errors["lang"] == pytest.approx((210 - de) / 1050, abs=1e-6) and 0.009 < fit.errors["lang"] < 0.011


def test_rows_without_id_have_draws_of_their_own(spark):
    rng = random.Random(4)
    rows = [(None, prose(rng, 50), rng.choice(["en", "en", "en", "de"]), "s") for _ in range(400)]
    rule = raking.Mix(source=1.0, topic=1.0, shares={"lang": {"=en": 0.5, "=de": 0.5}})
    got = raking.mixture(table(spark, rows), rule).toPandas()
    part = got[got["lang"] == "en"]["selected"].mean()
    assert 0.15 < part < 0.55 and "draw_key" not in got.columns
    assert raking.keep_sample(table(spark, rows), rule).count() == got["selected"].sum()


def test_raking_bounds_what_the_driver_gets(spark, monkeypatch):
    monkeypatch.setattr(raking, "NARROW_CELLS", 3)
    with pytest.raises(ValueError):
        raking.mixture(table(spark))


def test_trie_tables_go_when_they_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lm, "scratch_path", lambda _, name: f"file://{tmp_path}/{name}")
    rows = table(spark)
    assert lm.train_and_score(rows).count() == rows.count()
    assert (tmp_path / "pairs").exists() and not (tmp_path / "numbers").exists()


def test_trie_shuffles_go_with_their_stage(spark, tmp_path):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    # Spark's own folders: the test session names none
    top = Path(spark.sparkContext.getConf().get("spark.local.dir", tempfile.gettempdir()))
    shuffles = lambda: {str(f) for f in top.glob("blockmgr-*/*/shuffle_*.data")}
    before, setting = shuffles(), spark.conf.get(key, None)
    rows = table(spark).select("doc_id", "text", (F.col("doc_id") % 7 != 2).alias("train"))
    with shuffles_deleted(spark):
        lm.train(rows, str(tmp_path), lm.TrieRule())
    for _ in range(50):                                  # files go in the background
        if not shuffles() - before:
            break
        time.sleep(0.2)
    assert not shuffles() - before
    assert spark.conf.get(key, None) == setting
    lm.train_and_score(table(spark)).count()
    assert spark.conf.get(key, None) == setting


def test_words_of_a_batch():
    texts = ["A  b\tC", None, "", " \n", "\x0b\x0cx\r", "É a b c d\x1fe ", "z" * 300, " \x85 q"]
    found, edges = lm._split_words(pa.array(texts).slice(1))
    got = [found[a:b].to_pylist() for a, b in zip(edges[:-1], edges[1:])]
    assert got == [words(t) for t in texts[1:]]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    for limit in (1, 5, 10 ** 6):
        assert [t for p in lm._pieces(batch, limit) for t in p.column("text").to_pylist()] == texts
