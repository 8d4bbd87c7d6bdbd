"""Whole extractions and evaluations against sequential code on small signals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import ANNOTATIONS, chunk_rows
from test_cleaning import extended, hazen
from test_features import expected
from test_stats import auc, same
from tracewright import constants as C
from tracewright.functions import kernels as K
from tracewright.functions import forest
from tracewright.operators import segments as S
from tracewright.plans import boosting, diagnose as D, evaluate as E, extract as P, few_shot as FS, model as L

RATES = P.Rates(source=100.0, chunk_len=50)
NAMES = ["EEG Fp1", "EEG T3", "EEG C3", "EEG O1", "EEG Pz"]
CLEAN = ["Fp1", "T7", "C3", "O1", "Pz"]
N = 900


def signals(scale=None):
    rng = np.random.default_rng(11)
    out = {(r, c): np.cumsum(rng.normal(size=N)) * 1e-5 for r in range(2) for c in NAMES}
    if scale:
        out[scale[0], scale[1]] = out[scale[0], scale[1]] * 1000
    return out


def annotations(spark):
    rows = [(r, i, t, d) for r in range(2) for i, (t, d) in enumerate(
        [(0.3, "*"), (1.0, "NON_PD_START"), (1.7, "-"), (2.25, "*"), (3.0, "-"), (3.52, "Note : NON_PD_STOP"), (4.0, "Note : PD_START"),
         (4.1 + r, "*"), (5.0, "Note : * "), (6.4, "PD_STOP "), (8.8, "*")])]
    return spark.createDataFrame(rows, ANNOTATIONS), rows


def fir(x, taps):
    return np.convolve(extended(x, len(taps) // 2, "reflect"), taps, "valid")


def polyphase(x, up, down, taps):
    """Reflect far enough, put zeros between the samples, filter, keep every down-th."""
    k = len(taps) // 2 // up + 1
    ext = extended(x, k, "reflect")
    fine = np.zeros(len(ext) * up)
    fine[::up] = ext
    y = np.convolve(fine, taps)[len(taps) // 2:][k * up:k * up + len(x) * up]
    return y[::down]


def test_annotation_features(spark):
    x = signals()
    a, rows = annotations(spark)
    report = spark.createDataFrame([(1, "ransac", "T3"), (1, "correlation", "C3"), (1, "deviation", "XX"), (0, "hf_noise", "O1")],
                                   "recording_id bigint, category string, channel string")
    w = {("C3", "Fp1"): 0.5, ("C3", "O1"): 0.1, ("T3", "Pz"): 0.9}
    weights = spark.createDataFrame([("C3,T3", b, s, v) for (b, s), v in w.items()],
                                    "bad_set string, bad_channel string, src_channel string, w double")
    got = P.annotation_features(chunk_rows(spark, x, 50), RATES, a, report, weights).collect()
    old = [n.removeprefix("EEG ") for n in NAMES]
    taps = P.filter_and_resample_taps(RATES)
    want = {}
    for r in range(2):
        m = {c: polyphase(x[r, n], 4, 5, taps) for c, n in zip(old, NAMES)}
        if r == 1:
            m["C3"], m["T3"] = 0.5 * m["Fp1"] + 0.1 * m["O1"], 0.9 * m["Pz"]
        mean = sum(m.values()) / len(m)
        kept = 0
        for _, _, t, d in [q for q in rows if q[0] == r]:
            c = int(np.round(t * 80))
            if d in ("*", "-") and c - 40 >= 0 and c + 40 <= len(mean):
                for ch in old:
                    want[r, kept, ch] = (t, int(d == "*"), expected((m[ch] - mean)[c - 40:c + 40], 80.0))
                kept += 1
    assert {(g.recording_id, g.row_idx, g.channel) for g in got} == set(want) and len(got) == len(want)
    for g in got:
        t, label, feats = want[g.recording_id, g.row_idx, g.channel]
        assert (g.center_sec, g.label) == (t, label)
        assert np.allclose([g[n] for n in C.FEATURES], feats, rtol=1e-6, atol=1e-14)


def test_rejects_of_the_annotation_plan(spark):
    x, (a, _) = signals(), annotations(spark)
    report = spark.createDataFrame([], "recording_id bigint, category string, channel string")
    weights = spark.createDataFrame([], "bad_set string, bad_channel string, src_channel string, w double")
    rates = spark.createDataFrame([(0, 100.0), (1, 256.0)], "recording_id bigint, sfreq double")
    made = P.annotation_rows(chunk_rows(spark, x, 50), RATES, a, report, weights, rates)
    assert [(r.recording_id, r.reason) for r in made.rejected.collect()] == [(1, "sampling rate 256.0")]
    assert {r.recording_id for r in made.rows.select("recording_id").distinct().collect()} == {0}


def sequential_crops(x, segs, weights):
    """Clean every crop; deviation is the only active detector."""
    out = {}
    band, rs = K.bandpass_taps(0.5, 40.0, 100.0), K.resample_taps(4, 5)
    for r, k, start, stop, kind in segs:
        lo, hi = max(0.0, start - 20), min((N - 1) / 100, stop + 20)
        cut = slice(int(np.round(lo * 100)), int(np.round(hi * 100)) + 1)
        m = {c: fir(x[r, n][cut], band) for c, n in zip(CLEAN, NAMES)}
        spread = {c: 0.7413 * (hazen(v, .75) - hazen(v, .25)) for c, v in m.items()}
        v = np.array(list(spread.values()))
        sd = 0.7413 * (hazen(v, .75) - hazen(v, .25))
        bad = [c for c in CLEAN if abs(spread[c] - hazen(v, .5)) / sd > 5.3]
        for b in bad:
            m[b] = sum(weights[b, s] * m[s] for (q, s) in weights if q == b)
        mean = sum(m.values()) / len(m)
        out[r, k] = (start, lo, stop, {c: polyphase(v - mean, 4, 5, rs) for c, v in m.items()}, bad)
    return out


@pytest.fixture(scope="module")
def crops(spark):
    x = signals((1, "EEG T3"))
    a, rows = annotations(spark)
    segs = S.build_segments(a)
    w = {("T7", s): v for s, v in zip(["Fp1", "C3", "O1", "Pz"], [0.5, -0.2, 0.3, 0.1])}
    weights = spark.createDataFrame([("T7", b, s, v) for (b, s), v in w.items()],
                                    "bad_set string, bad_channel string, src_channel string, w double")
    made = P.clean_crops(chunk_rows(spark, x, 50), RATES, segs, weights, limits=P.Detection(deviation=5.3, correlation=0.0))
    return made, sequential_crops(x, [tuple(s) for s in segs.collect()], w), a, rows, segs


def test_crops(crops):
    made, want, *_ = crops
    assert made.rejected.count() == 0
    got = {}
    for b in made.bad.collect():
        got.setdefault((b.recording_id, b.segment_id), []).append(b.channel)
    assert got == {k: v[4] for k, v in want.items() if v[4]} and any(k[0] == 1 for k in got)


def test_sliding_features(spark, crops):
    made, seq, a, rows, _ = crops
    got = P.sliding_features(made, RATES, a).collect()
    want = {}
    for (r, k), (start, lo, stop, m, _) in seq.items():
        first = int(np.round((start - lo) * 80))
        last = first + int(np.round((stop - start) * 80))
        marks = [t for q, _, t, d in rows if q == r and d.removeprefix("Note : ").strip() == "*"]
        for c, v in m.items():
            core = v[first:last]
            for s in range(0, len(core) - 80 + 1, 20):
                on = start + s / 80
                want[r, k, s, c] = (on, int(any(on <= t <= on + 1 for t in marks)), expected(core[s:s + 80], 80.0))
    assert {(g.recording_id, g.segment_id, g.s, g.channel) for g in got} == set(want) and len(got) == len(want)
    assert {g.label for g in got} == {0, 1}
    for g in got:
        on, label, feats = want[g.recording_id, g.segment_id, g.s, g.channel]
        assert (g.onset_sec, g.label) == (on, label)
        assert np.allclose([g[n] for n in C.FEATURES], feats, rtol=1e-6, atol=1e-14)


def test_event_features(spark, crops):
    made, seq, a, rows, _ = crops
    got = P.event_features(made, RATES, a).collect()
    want = {}
    for (r, k), (start, lo, stop, m, _) in seq.items():
        for q, o, t, d in rows:
            d = d.removeprefix("Note : ").strip()
            c = int(np.round((t - lo) * 80))
            if q == r and d in ("*", "-") and start <= t < stop and c - 40 >= 0 and c + 40 <= len(m["C3"]):
                for ch, v in m.items():
                    want[r, k, o, ch] = (t, int(d == "*"), expected(v[c - 40:c + 40], 80.0))
    assert {(g.recording_id, g.segment_id, g.ord, g.channel) for g in got} == set(want) and len(got) == len(want)
    for g in got:
        t, label, feats = want[g.recording_id, g.segment_id, g.ord, g.channel]
        assert (g.center_sec, g.label) == (t, label)
        assert np.allclose([g[n] for n in C.FEATURES], feats, rtol=1e-6, atol=1e-14)


@pytest.mark.parametrize("average", [True, False])
def test_feature_dataset(spark, crops, average):
    made, _, a, *_ = crops
    rows = P.sliding_features(made, RATES, a)
    names = spark.createDataFrame([(0, "P20_GHB_1.edf"), (1, "p36_x.edf"), (2, "P9_none.edf")], "recording_id bigint, file_name string")
    got = P.feature_dataset(rows, names, average).collect()
    own = rows.collect()
    windows = {}
    for r in own:
        windows.setdefault((r.recording_id, r.onset_sec, r.segment_id, r.s), []).append(r)
    place = {}
    for rec in (0, 1):
        for i, k in enumerate(sorted(k for k in windows if k[0] == rec)):
            place[rec, i] = windows[k]
    assert len(got) == (len(place) if average else len(own))
    for g in got:
        rec = {"P20_GHB_1.edf": 0, "p36_x.edf": 1}[g.source]
        assert g.patient_id == ("P20", "P36")[rec]
        group = [r for r in place[rec, g.row_idx] if average or r.channel == g.channel]
        assert g.y == group[0].label and g.time_sec == group[0].onset_sec and g.segment_id == group[0].segment_id
        assert np.allclose([g[n] for n in C.FEATURES], [np.mean([r[n] for r in group]) for n in C.FEATURES], rtol=1e-5, atol=1e-12)
    counts = {r.source: r for r in P.dataset_counts(P.feature_dataset(rows, names, average)).collect()}
    assert {s: c.n_windows for s, c in counts.items()} == {n: sum(k[0] == i for k in place) for i, n in ((0, "P20_GHB_1.edf"), (1, "p36_x.edf"))}


def test_flat_channels_and_prediction_after_the_others(spark):
    x = signals()
    x[0, "EEG T3"] = np.zeros(N)
    a, _ = annotations(spark)
    w = spark.createDataFrame([("T7", "T7", s, 0.25) for s in ("Fp1", "C3", "O1", "Pz")],
                              "bad_set string, bad_channel string, src_channel string, w double")
    guess = P.G.PredictionWeights.of((0, c, s, 1.0) for c in CLEAN for s in CLEAN if c != s)
    made = P.clean_crops(chunk_rows(spark, x, 50), RATES, S.build_segments(a), w, guess,
                         P.Detection(deviation=1e9, correlation=0.0, prediction=-2.0))
    assert {(r.recording_id, r.channel) for r in made.bad.collect()} == {(0, "T7")} and made.rejected.count() == 0


def by_key(rows, keys, value):
    return {tuple(r[k] for k in keys): r[value] for r in rows}


@pytest.mark.parametrize("in_rows", [True, False])
def test_two_rates_in_one_run(spark, in_rows):
    """Recordings of 100 and 128 Hz together give what each gives alone; one of 90 Hz and one without a rate are listed."""
    rng = np.random.default_rng(12)
    of = {0: (100.0, 50), 1: (128.0, 64), 2: (90.0, 45), 3: (None, 50)}
    x = {(r, c): np.cumsum(rng.normal(size=int(9 * (f or 100)) - r)) * 1e-5 for r, (f, _) in of.items() for c in NAMES}
    parts = {r: chunk_rows(spark, {k: v for k, v in x.items() if k[0] == r}, n) for r, (_, n) in of.items()}
    chunks = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    recs = spark.createDataFrame([(r, f) for r, (f, _) in of.items()] + [(2, 80.0)], "recording_id bigint, sfreq double")
    table = P.RateTable((100.0, 128.0), 0.5)
    report = spark.createDataFrame([(1, "ransac", "T3")], "recording_id bigint, category string, channel string")
    columns = "bad_set string, bad_channel string, src_channel string, w double"
    weights = spark.createDataFrame([("T3", "T3", "Pz", 1.0)], columns)
    given = {"signals": chunks.join(recs.filter("sfreq <> 80 OR sfreq IS NULL"), "recording_id")} if in_rows else {"signals": chunks, "recordings": recs}
    made = P.clean_recordings(rates=table, report=report, weights=weights, **given)
    got = by_key(made.chunks.collect(), ["recording_id", "channel", "chunk"], "x")
    want = {}
    for r in (0, 1):
        one = P.clean_recordings(parts[r], P.Rates(of[r][0], of[r][1]), report, weights)
        want |= by_key(one.chunks.collect(), ["recording_id", "channel", "chunk"], "x")
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-15) for k in want)
    assert all(len(v) <= table.out_len for v in got.values())
    reasons = {r.recording_id: r.reason for r in made.rejected.collect()}
    assert reasons == {2: "sampling rate 90.0" if in_rows else "sampling rate unknown", 3: "sampling rate unknown"}

    rows = [(r, i, t, d) for r in of for i, (t, d) in enumerate([(1.0, "NON_PD_START"), (2.25, "*"), (5.0, "NON_PD_STOP")])]
    marks = spark.createDataFrame(rows, ANNOTATIONS)
    segs, none = S.build_segments(marks), spark.createDataFrame([], columns)
    limits = P.Detection(deviation=1e9, correlation=0.0)
    crops = P.clean_crops(rates=table, segments=segs, weights=none, limits=limits, **given)
    key = ["recording_id", "segment_id", "s", "channel"]
    got = by_key(P.sliding_features(crops, table, marks).collect(), key, "rms")
    want = {}
    for r in (0, 1):
        rates = P.Rates(of[r][0], of[r][1])
        one = P.clean_crops(parts[r], rates, segs, none, limits=limits)
        want |= by_key(P.sliding_features(one, rates, marks).collect(), key, "rms")
    assert set(got) == set(want) and len({k[0] for k in got}) == 2 and all(np.isclose(got[k], want[k]) for k in want)
    assert {r.recording_id for r in crops.rejected.collect()} == {2, 3}


def test_rates_that_do_not_fit(spark):
    with pytest.raises(ValueError):
        P.RateTable((100.0, 128.0), 0.3)
    chunks = chunk_rows(spark, {(0, "EEG Fp1"): np.ones(10)}, 5)
    with pytest.raises(ValueError):
        P.clean_recordings(chunks, P.RateTable((100.0,), 0.5), None, None)
    with pytest.raises(Exception, match="no rule for the rate"):
        P.G.resample_rates(chunks.withColumn("sfreq", F.lit(7.0)), P.RateTable((100.0,), 0.05, 80.0).changes()).collect()


def test_positions_instead_of_weights(spark):
    """Weights and predictions from positions in a whole extraction; a crop too short for the rule is listed."""
    x = signals()
    x[0, "EEG T3"] = np.zeros(N)
    a, _ = annotations(spark)
    at = P.GEO.sphere_positions()
    rule = P.GEO.SubsetPredictions.of(at, share=0.8, draws=8)
    made = P.clean_crops(chunk_rows(spark, x, 50), RATES, S.build_segments(a), at, rule,
                         P.Detection(deviation=1e9, correlation=0.0, prediction=-2.0))
    assert {(r.recording_id, r.channel) for r in made.bad.collect()} == {(0, "T7")} and made.rejected.count() == 0
    assert {(r.recording_id, "channels in a subset" in r.reason) for r in made.warnings.collect()} == {(0, True)}
    ends = spark.createDataFrame([(r, 0, 0.5, "PD_START") for r in range(2)] + [(r, 1, 1.5, "PD_STOP") for r in range(2)], ANNOTATIONS)
    short = {k: v[:300] for k, v in signals().items()}
    made = P.clean_crops(chunk_rows(spark, short, 50), RATES, S.build_segments(ends), at, rule, P.Detection(deviation=1e9, correlation=0.0))
    assert [(r.recording_id, r.reason) for r in made.warnings.orderBy("recording_id").collect()] == [(r, "shorter than a window of 5 s") for r in range(2)]


def test_recordings_that_cannot_be_cleaned_are_rejected(spark):
    x = signals()
    report = spark.createDataFrame([(1, "ransac", "T3")], "recording_id bigint, category string, channel string")
    columns = "bad_set string, bad_channel string, src_channel string, w double"
    for weights, reason in (([], "no weights for T3"), ([("T3", "T3", "Cz", 1.0)], "no source Cz")):
        made = P.clean_recordings(chunk_rows(spark, x, 50), RATES, report, spark.createDataFrame(weights, columns))
        assert [(r.recording_id, r.reason) for r in made.rejected.collect()] == [(1, reason)]
        assert {r.recording_id for r in made.chunks.select("recording_id").distinct().collect()} == {0}
    doubled = x | {(0, "Fp1 "): x[0, "EEG Fp1"]}
    made = P.clean_recordings(chunk_rows(spark, doubled, 50), RATES, report, spark.createDataFrame([("T3", "T3", "Pz", 1.0)], columns))
    assert [(r.recording_id, r.reason) for r in made.rejected.collect()] == [(0, "channel given twice: Fp1")]
    doubled = x | {(0, "T7"): x[0, "EEG T3"]}
    a, _ = annotations(spark)
    crops = P.clean_crops(chunk_rows(spark, doubled, 50), RATES, S.build_segments(a), spark.createDataFrame([], columns),
                          limits=P.Detection(deviation=1e9, correlation=0.0))
    assert {(r.recording_id, r.reason) for r in crops.rejected.collect()} == {(0, "channel given twice: T7")}
    assert {r.recording_id for r in crops.chunks.select("recording_id").distinct().collect()} == {1}
    rates = spark.createDataFrame([(0, 100.0), (1, 256.0)], "recording_id bigint, sfreq double")
    crops = P.clean_crops(chunk_rows(spark, x, 50), RATES, S.build_segments(a), spark.createDataFrame([], columns),
                          limits=P.Detection(deviation=1e9, correlation=0.0), recordings=rates)
    assert {(r.recording_id, r.reason) for r in crops.rejected.collect()} == {(1, "sampling rate 256.0")}
    assert {r.recording_id for r in crops.chunks.select("recording_id").distinct().collect()} == {0}
    assert "Join" not in P.clean_crops(chunk_rows(spark, x, 50), RATES, S.build_segments(a), spark.createDataFrame([], columns)
                                       ).spans._jdf.queryExecution().executedPlan().toString()


def test_crop_without_weights_is_rejected(spark):
    x = signals((1, "EEG T3"))
    a, _ = annotations(spark)
    none = spark.createDataFrame([], "bad_set string, bad_channel string, src_channel string, w double")
    made = P.clean_crops(chunk_rows(spark, x, 50), RATES, S.build_segments(a), none,
                         limits=P.Detection(deviation=5.3, correlation=0.0))
    out = {(r.recording_id, r.segment_id) for r in made.rejected.collect()}
    kept = {(r.recording_id, r.segment_id) for r in made.chunks.select(*P.CROP).distinct().collect()}
    assert {r for r, _ in out} == {1} and {r for r, _ in kept} >= {0} and not out & kept


# --- evaluation -------------------------------------------------------------

FEATS = ["f", "g"]
QUICK = L.BoostParams(rounds=4, rate=0.5, depth=2, max_bins=16, row_share=1.0, column_share=1.0, train_rows=None)
TASKS = L.BoostParams(rounds=40, rate=0.3, depth=2, column_share=1.0, train_rows=1000)


def fit_and_score(x, y, scored, rounds, rate, depth, column_share, seed):
    model, _ = forest.fit(x, y.astype(float), forest.balanced(y), rounds, rate, depth, 1.0, column_share, 256, seed)
    return model.probability(scored)


def labelled_rows(spark, patients=("P20", "P36", "P58"), n=40, nan=False):
    rng = np.random.default_rng(3)
    rows = []
    for j, p in enumerate(patients):
        for i in range(n):
            y = int(rng.random() < 0.4)
            rows.append((p, f"{p}_f{i % 2}", j * 1000 + i, y, float(y + 0.1 * rng.normal()) * (j + 1), NAN if nan and i % 5 == 0 else float(rng.normal())))
    return spark.createDataFrame(rows, "patient_id string, source string, row_idx bigint, y int, f double, g double"), rows


NAN = float("nan")


@pytest.mark.parametrize("params", [QUICK, TASKS])
def test_leave_one_out(spark, params):
    df, rows = labelled_rows(spark)
    done = E.leave_one_out(df, FEATS, params=params)
    scored = done.scored.collect()
    assert sorted(r.row_idx for r in scored) == sorted(r[2] for r in rows)
    assert all(r.fold == r.patient_id for r in scored)
    for m in done.metrics().collect():
        own = [(r.proba, r.y) for r in scored if r.fold == m.fold]
        assert same(m.roc_auc, auc([p for p, _ in own], [y for _, y in own])) and m.roc_auc > 0.95
    imp = {(r.fold, r.feature): r.importance for r in done.importances.collect()}
    assert len(imp) == 6 and all(imp[p, "f"] > imp[p, "g"] for p in ("P20", "P36", "P58"))
    assert [r.feature for r in L.importance_summary(done.importances).collect()] == ["f", "g"]


@pytest.mark.parametrize("params", [QUICK, TASKS])
def test_undefined_features_and_seeds(spark, params):
    df, rows = labelled_rows(spark, nan=True)
    done = E.seeded(df, FEATS, params)
    scored = done.scored.collect()
    per = {p: sum(r.fold == p for r in scored) for p in ("P20", "P36", "P58")}
    assert per == {p: 30 for p in per}                # five rows of each class left the test side
    assert all(0 <= r.proba <= 1 for r in scored)
    assert done.importances.count() == 6


@pytest.mark.parametrize("params", [QUICK, TASKS])
def test_within_patterns_and_holdout(spark, params):
    df, _ = labelled_rows(spark, ("P20", "P36", "P48", "P58"))
    done = E.within_patterns(df, FEATS, params)
    assert list(done) == ["LPD"] and {r.fold for r in done["LPD"].scored.collect()} == {"P20", "P36", "P58"}
    ignored = df.withColumn("y", F.when(F.col("row_idx") % 10 == 0, -1).otherwise(F.col("y")))
    rep = E.Representation("hand", FEATS, True)
    out = E.hold_out(df, ignored, rep, params=params)
    assert out.scored.count() == 36 and out.metrics().first().fold == "P58"
    with pytest.raises(ValueError):
        E.hold_out(df, df.drop("source"), E.Representation("hand", FEATS), params=QUICK)
    vectors = df.select("patient_id", "source", "row_idx", F.col("y").alias("label"), F.array("f", "g").alias("emb"))
    other = E.hold_out(vectors, vectors, E.EMBEDDING, params=params)
    pairs = {r.metric: r for r in E.compare_hold_out(out, other, ("hand", "embedding")).collect()}
    assert set(pairs) == {"bacc", "roc_auc", "f1", "pr_auc"} and pairs["roc_auc"].second > 0.9
    assert sorted(r.feature for r in other.importances.collect()) == ["f0", "f1"]


def vector_rows(df):
    return df.select("patient_id", "source", "row_idx", F.col("y").alias("label"), F.array("f", "g").alias("emb"))


def probabilities(done):
    return {r.row_idx: r.proba for r in done.scored.collect()}


@pytest.mark.parametrize("rep", [E.Representation("hand", FEATS, True), E.EMBEDDING])
def test_holdout_trains_on_all_rows(spark, rep):
    """More rows than a task may hold: the model is that of all of them; up to that many, that of one task on all of them."""
    df, rows = labelled_rows(spark, ("P20", "P36", "P58"))
    df = df if rep.features else vector_rows(df)
    fitted = lambda n: probabilities(E.hold_out(df, df, rep, params=L.BoostParams(
        rounds=3, rate=0.3, depth=2, row_share=1.0, column_share=1.0, train_rows=n)))
    whole = fitted(None)
    assert len(whole) == 40 and all(fitted(n) == pytest.approx(whole) for n in (30, 80))


def test_leave_one_out_trains_on_all_rows(spark):
    df, rows = labelled_rows(spark)
    fitted = lambda n: probabilities(E.leave_one_out(df, FEATS, params=L.BoostParams(
        rounds=3, rate=0.3, depth=2, row_share=1.0, column_share=1.0, train_rows=n)))
    whole = fitted(None)
    assert len(whole) == 120 and fitted(40) == pytest.approx(whole)


def boosting_rows(spark, nan=True):
    rng = np.random.default_rng(8)
    n = 300
    x = rng.normal(size=(n, 3)).round(1)
    if nan:
        x[rng.random(x.shape) < 0.15] = NAN
    y = (np.nan_to_num(x[:, 0], nan=1.0) + x[:, 1] ** 2 - 1 + 0.4 * rng.normal(size=n) > 0)
    y = np.where(np.isnan(y), 0, y).astype(int)
    who = [f"P{i % 4}" for i in range(n)]
    df = spark.createDataFrame([(who[i], f"{who[i]}_f", i, int(y[i]), *map(float, x[i])) for i in range(n)],
                               "patient_id string, source string, row_idx bigint, y int, a double, b double, c double")
    return df.repartition(5), x, y, np.array(who)


@pytest.mark.parametrize("flush", [2, 10])
def test_boosting_on_all_rows_equals_the_model_of_one_task(spark, monkeypatch, flush):
    monkeypatch.setattr(boosting, "FLUSH_ROUNDS", flush)
    df, x, y, who = boosting_rows(spark)
    params = L.BoostParams(rounds=5, rate=0.3, depth=3, row_share=1.0, column_share=1.0, train_rows=None)
    folds = spark.createDataFrame([("all", [])], "fold string, seeds array<array<double>>")
    (r,) = boosting.fit_folds(df, folds, ["a", "b", "c"], params).collect()
    want, gains = forest.fit(x, y.astype(float), forest.balanced(y), 5, 0.3, 3, 1.0, 1.0, 256, 0)
    assert np.allclose(forest.Forest.of(r.model).margin(x), want.margin(x)) and np.allclose(r.importances, gains)
    # all folds at once, with a seed row of its own in one of them; cuts are those of all rows
    monkeypatch.setattr(forest, "_bins", lambda part, bins, whole=x, plain=forest._bins: (
        plain(np.concatenate([part, whole]), bins)[0][:len(part)], plain(whole, bins)[1]))
    seed = [0.3, -0.2, 1.1, 1.0, 15.0]
    folds = spark.createDataFrame([(f"P{i}", [seed] if i == 1 else []) for i in range(4)], "fold string, seeds array<array<double>>")
    for r in boosting.fit_folds(df, folds, ["a", "b", "c"], params).collect():
        own = who != r.fold
        xs, ys, w = x[own], y[own].astype(float), np.ones(own.sum())
        if r.fold == "P1":
            xs, ys, w = np.concatenate([xs, [seed[:3]]]), np.append(ys, 1.0), np.append(w, 15.0)
        want, _ = forest.fit(xs, ys, forest.balanced(ys, w), 5, 0.3, 3, 1.0, 1.0, 256, 0)
        assert np.allclose(forest.Forest.of(r.model).margin(x), want.margin(x)), r.fold


def test_boosting_draws_rows_and_columns(spark):
    df, x, y, _ = boosting_rows(spark)
    params = L.BoostParams(rounds=12, rate=0.3, depth=2, row_share=0.5, column_share=0.7, train_rows=None)
    folds = spark.createDataFrame([("all", [])], "fold string, seeds array<array<double>>")
    first, again = (boosting.fit_folds(df.repartition(n), folds, ["a", "b", "c"], params).first() for n in (2, 7))
    p = forest.Forest.of(first.model).probability(x)
    assert np.allclose(p, forest.Forest.of(again.model).probability(x)) and auc(list(p), list(y)) > 0.85
    share = boosting._uniform(np.arange(10000) * 7919, 42, 3)
    assert 0.48 < (share < 0.5).mean() < 0.52
    none = boosting.fit_folds(df.filter("false"), folds, ["a", "b", "c"], params).first()
    assert np.allclose(forest.Forest.of(none.model).margin(x), 0)


def test_boosting_in_small_blocks(spark, monkeypatch):
    df, x, *_ = boosting_rows(spark)
    params = L.BoostParams(rounds=3, rate=0.3, depth=2, row_share=0.7, column_share=1.0, train_rows=None)
    folds = spark.createDataFrame([(f"P{i}", []) for i in range(4)], "fold string, seeds array<array<double>>")
    fitted = lambda: {r.fold: forest.Forest.of(r.model).margin(x) for r in boosting.fit_folds(df, folds, ["a", "b", "c"], params).collect()}
    whole = fitted()
    monkeypatch.setattr(boosting, "BLOCK_BYTES", 7 * 35)          # seven rows
    monkeypatch.setattr(boosting, "FLUSH_ROUNDS", 1)
    assert {f: pytest.approx(m) for f, m in whole.items()} == fitted()


def test_few_shot_sweep(spark, monkeypatch):
    df, rows = labelled_rows(spark, n=60)
    params = L.BoostParams(rounds=6, rate=0.3, depth=3, row_share=1.0)
    monkeypatch.setattr(FS, "BATCH_ROWS", 16)          # several batches per file
    got = {(r.source, r.n_shot, r.row_idx): r.proba for r in FS.few_shot_scores(df, FEATS, 5, params).collect()}
    want = {}
    for f in sorted({r[1] for r in rows}):
        own = sorted((r for r in rows if r[1] == f), key=lambda r: r[2])
        for n in range(1, 6):
            train = [r for y in (0, 1) for r in [q for q in own if q[3] == y][:n]]
            rest = [r for r in own if r not in train]
            if sum(r[3] for r in train) < n or len({r[3] for r in rest}) < 2:
                continue
            train.sort(key=lambda r: r[2])
            arr = lambda rs: np.array([[r[4], r[5]] for r in rs])
            p = fit_and_score(arr(train), np.array([r[3] for r in train]), arr(rest), 6, 0.3, 3, 0.8, 42)
            want |= {(f, n, r[2]): v for r, v in zip(rest, p)}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    table = FS.few_shot_sweep(df, FEATS, 5, params).collect()
    assert [r.n_shot for r in table] == [1, 2, 3, 4, 5] and table[4].roc_auc > 0.9
    assert table[0].acc_std is not None


def recursive_tree(x, g, h, depth, rate):
    """One tree by trying every split between neighbouring values of every column, undefined ones on either side."""
    best = (1e-9, None, None, None)
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    for side in (False, True):
        for j in range(x.shape[1] if depth else 0):
            v = x[:, j]
            values = np.unique(v[~np.isnan(v)])
            cuts = [] if side else [-np.inf]
            for t in [*cuts, *(values[:-1] + values[1:]) / 2, np.inf]:
                left = (v < t) | (np.isnan(v) & (not side))
                if h[left].sum() >= 1 and h[~left].sum() >= 1:
                    gain = score(left) + score(~left) - score(left | True)
                    if gain > best[0] + 1e-9:
                        best = (gain, j, t, side)
    if best[1] is None:
        return lambda q: np.full(len(q), -rate * g.sum() / (h.sum() + 1))
    _, j, t, side = best
    where = lambda q: (q[:, j] < t) | (np.isnan(q[:, j]) & (not side))
    left = where(x)
    parts = [recursive_tree(x[m], g[m], h[m], depth - 1, rate) for m in (left, ~left)]
    return lambda q: np.where(where(q), parts[0](q), parts[1](q))


def test_forest_against_recursive_trees():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 3)).round(1)
    x[rng.random(x.shape) < 0.1] = NAN
    y = (np.nan_to_num(x[:, 0]) + 0.5 * rng.normal(size=120) > 0).astype(float)
    w = forest.balanced(y)
    model, gains = forest.fit(x, y, w, 8, 0.3, 3, 1.0, 1.0, 256, 0)
    margin, new = np.zeros(120), rng.normal(size=(50, 3))
    total = np.zeros(50)
    for _ in range(8):
        p = 1 / (1 + np.exp(-margin))
        tree = recursive_tree(x, w * (p - y), w * p * (1 - p), 3, 0.3)
        margin, total = margin + tree(x), total + tree(new)
    assert np.allclose(model.margin(x), margin) and np.allclose(model.margin(new), total)
    assert gains.sum() == pytest.approx(1.0) and gains.argmax() == 0
    assert np.allclose(forest.Forest.of(model.to_bytes()).margin(new), total)


def test_single_pair_gives_no_split():
    x = np.array([[0.0], [1.0]])
    assert np.allclose(fit_and_score(x, np.array([0, 1]), x, 10, 0.3, 4, 1.0, 1), 0.5)   # children too light


def test_undefined_values_go_where_they_fit():
    x = np.array([[NAN]] * 5 + [[1.0]] * 5 + [[9.0]] * 5)
    p = fit_and_score(x, np.array([1] * 5 + [0] * 5 + [1] * 5), np.array([[NAN], [1.0], [9.0]]), 20, 0.3, 1, 1.0, 1)
    assert p[0] > 0.7 and p[1] < 0.3 and p[2] > 0.7             # right, with the large values


def test_undefined_values_alone():
    x = np.array([[NAN], [NAN], [NAN], [NAN], [NAN], [1.0], [1.0], [1.0], [1.0], [1.0]])
    p = fit_and_score(x, np.array([0] * 5 + [1] * 5), np.array([[NAN], [5.0]]), 20, 0.3, 2, 1.0, 1)
    assert p[0] < 0.3 and p[1] > 0.7


def test_separability_report(spark):
    df, _ = labelled_rows(spark)
    out = D.separability_report(df, {"one": df, "none": df.filter("false")}, FEATS)
    table = {r.feature: r for r in out.auc_table.collect()}
    assert table["f"].one > 0.99 and table["f"].none is None and table["f"].TRAIN > 0.8
    assert {r.dataset for r in out.balance.collect()} == {"TRAIN", "one"}


def test_histograms_in_blocks(monkeypatch):
    """Blocks of columns give the same model, and a fit holds little beside the rows."""
    import tracemalloc
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20_000, 32))
    x[rng.random(x.shape) < 0.01] = np.nan
    y = (rng.random(len(x)) < 0.2).astype(float)

    def fit():
        return forest.fit(x, y, forest.balanced(y), 2, 0.1, 3, 0.8, 0.8, 256, 1)

    tracemalloc.start()
    model, gains = fit()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * x.nbytes
    monkeypatch.setattr(forest, "BLOCK_CELLS", 1 << 30)
    whole, all_gains = fit()
    assert model.to_bytes() == whole.to_bytes() and (gains == all_gains).all()
