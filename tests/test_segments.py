"""Segments against the sequential rule, and events and crops at their edges."""

import random

from helpers import ANNOTATIONS
from tracewright.operators import segments as S


def sequential(rows):
    """One pass over sorted annotations with one open segment."""
    out, open_seg = [], None
    for rec, order, t, d in sorted(rows, key=lambda r: (r[2], r[1])):
        d = d.removeprefix("Note : ").strip()
        kind = d.rsplit("_", 1)[0]
        if d in ("PD_START", "NON_PD_START"):
            open_seg = (kind, t)
        elif d in ("PD_STOP", "NON_PD_STOP"):
            if open_seg and open_seg[0] == kind:
                out.append((open_seg[1], t, kind))
            open_seg = None
    return out


def built(spark, rows, **kw):
    df = S.build_segments(spark.createDataFrame(rows, ANNOTATIONS), **kw)
    return {(r.recording_id, r.segment_id): (r.seg_start, r.seg_stop, r.seg_type) for r in df.collect()}


def test_random_sequences_match_sequential_rule(spark):
    rng = random.Random(7)
    texts = ["PD_START", "Note : PD_STOP", "NON_PD_START ", "NON_PD_STOP", "*", "Note : note"]
    rows = []
    for rec in range(12):
        for i in range(60):           # coarse times give many ties, gaps give empty buckets
            t = float(rng.choice([0, 1, 2, 5000, 5001, 90000, rng.randrange(200000)]))
            rows.append((rec, i, t, rng.choice(texts)))
    want = {(rec, i): s for rec in range(12) for i, s in enumerate(sequential([r for r in rows if r[0] == rec]))}
    for bucket in (1.0, 3600.0, 1e9):
        assert built(spark, rows, bucket_sec=bucket) == want


def test_listed_cases(spark):
    cases = {
        0: ["PD_START", "NON_PD_START", "NON_PD_STOP"],            # later START wins
        1: ["PD_START", "NON_PD_STOP", "PD_STOP"],                 # wrong STOP clears
        2: ["PD_START"],                                           # never closed
        3: ["PD_START", "*", "Note : something", "PD_STOP"],       # others do not matter
        4: ["PD_STOP", "PD_START", "PD_STOP", "PD_STOP"],
    }
    rows = [(r, i, float(i), d) for r, ds in cases.items() for i, d in enumerate(ds)]
    assert built(spark, rows) == {(0, 0): (1.0, 2.0, "NON_PD"), (3, 0): (0.0, 3.0, "PD"), (4, 0): (1.0, 2.0, "PD")}
    left = S.unclosed_segments(spark.createDataFrame(rows, ANNOTATIONS)).collect()
    assert [(r.recording_id, r.onset_sec, r.seg_type) for r in left] == [(2, 0.0, "PD")]


def test_events_half_open(spark):
    rows = [(0, 0, 10.0, "PD_START"), (0, 1, 10.0, "*"), (0, 2, 19.9, "Note : - "), (0, 3, 20.0, "PD_STOP"),
            (0, 4, 20.0, "*"), (0, 5, 9.9, "*")]
    a = spark.createDataFrame(rows, ANNOTATIONS)
    got = S.events_in_segments(a, S.build_segments(a), bucket_sec=4.0).collect()
    assert sorted((r.ord, r.label) for r in got) == [(1, 1), (2, 0)]


def test_crops_are_clipped_and_flagged(spark):
    segs = spark.createDataFrame([(0, 0, 5.0, 30.0, "PD"), (0, 1, 50.0, 60.0, "PD")],
                                 "recording_id bigint, segment_id bigint, seg_start double, seg_stop double, seg_type string")
    recs = spark.createDataFrame([(0, 100.0)], "recording_id bigint, rec_end_sec double")
    got = {r.segment_id: r for r in S.padded_crops(segs, recs).collect()}
    assert (got[0].crop_start, got[0].crop_stop, got[0].left_pad, got[0].reduced_padding) == (0.0, 50.0, 5.0, True)
    assert (got[1].crop_start, got[1].crop_stop, got[1].reduced_padding) == (30.0, 80.0, False)
