import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from text_fixtures import documents, empty, prose, table, words

import corpus_pipeline
from tracewright.plans.tables import materialize
from tracewright.llm import components, exact_dedup, similar, simhash


def plain_groups(rows):
    groups = defaultdict(list)
    for d, t, _, _ in rows:
        groups[t or ""].append(d)
    return groups


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("runs, fan_in", [(64, 8), (1, 2), (7, 3)])
def test_exact_groups(spark, keep, runs, fan_in):
    rows = documents()
    groups = plain_groups(rows)
    got = exact_dedup.exact_groups(table(spark), keep, runs, fan_in).collect()
    assert len(got) == len(rows)
    sha = {hashlib.sha256((t or "").encode()).hexdigest(): t or "" for _, t, _, _ in rows}
    for r in got:
        ids = groups[sha[r.text_sha256]]
        some = [d for d in ids if d is not None]
        best = (min if keep == "min" else max)(some) if some else None
        assert (r.keep_id, r.group_size) == (best, len(ids)) and (not r.kept or r.doc_id == best)
    assert sorted(r.text_sha256 for r in got if r.kept) == sorted(sha)              # one row of every text


def test_exact_repeated_rows(spark):
    rows = [(5, "t", "en", "s"), (5, "t", "en", "s"), (3, "t", "en", "s"), (None, "u", "en", "s"), (None, "u", "en", "s"), (None, None, "en", "s"),
            (9, "", "en", "s")]
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.exact_groups(table(spark, rows), "max").collect())
    assert got == [("3", "5", 3, False), ("5", "5", 3, False), ("5", "5", 3, True), ("9", "9", 2, True), ("None", "9", 2, False),
                   ("None", "None", 2, False), ("None", "None", 2, True)]
    assert exact_dedup.keep_one(table(spark, rows), "max").count() == 3


def test_exact_rounds_move_no_rows(spark):
    rows = exact_dedup.digests(table(spark)).selectExpr(
        "seq % 4 as run", *exact_dedup.KEY, "struct(true as o, doc_id, seq) as best", "1L as group_size")
    level = exact_dedup._Runs(exact_dedup.merge_round(rows, 1, "max").repartition(8, "digest"), 8)
    again = exact_dedup.merge_round(level.rows(), 2, "max")
    assert again.count() > 0
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    before = {t.name for t in spark.catalog.listTables()}
    level.drop()
    assert before - {t.name for t in spark.catalog.listTables()} == {level._name}


def test_exact_keep_one(spark):
    docs = table(spark)
    out = exact_dedup.keep_one(docs, "max")
    assert out.dtypes == docs.dtypes
    want = sorted((str(max((d for d in ids if d is not None), default=None)), t) for t, ids in plain_groups(documents()).items())
    assert sorted((str(r.doc_id), r.text or "") for r in out.collect()) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_empty(spark):
    assert exact_dedup.exact_groups(empty(spark)).count() == 0
    assert exact_dedup.keep_one(empty(spark)).count() == 0
    assert simhash.components(empty(spark)).count() == 0
    assert similar.keep_one_of_similar(empty(spark)).count() == 0


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(5, 5)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 300)],
                                   [(7 * i % 50, 11 * i % 50) for i in range(30)] + [(-9, 49), (60, 61)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in components.connected_components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e if e[0] != e[1]}
    for a, b in edges:
        if a != b:
            a, b = find(parent, a), find(parent, b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(parent, x) for x in parent}


def plain_fingerprint(text, size):
    ws = words(text)
    if not ws:
        return 0
    shingles = [" ".join(ws[i:i + size]) for i in range(max(1, len(ws) - size + 1))]
    h = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], np.uint64)
    return sum(1 << i for i in range(64) if 2 * int(((h >> np.uint64(i)) & np.uint64(1)).sum()) > len(h))


def test_simhash_components(spark):
    rows = documents()
    rng = np.random.default_rng(2)
    import random
    base = prose(random.Random(8), 4000, 10 ** 6).split()
    for k in range(6):                                 # long texts with one word changed
        ws = list(base)
        ws[int(rng.integers(4000))] = "other"
        rows.append((300 + k, " ".join(ws), "en", "s0"))
    got = simhash.components(table(spark, rows)).collect()
    fps = [plain_fingerprint(t, 3) for _, t, _, _ in rows]
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, (d, _, _, _) in enumerate(rows):
        if d is not None:
            least[find(parent, i)].append(d)
    want = sorted(str((d, f"{fps[i]:016x}", min(least[find(parent, i)], default=None))) for i, (d, _, _, _) in enumerate(rows))
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got) == want
    assert len({r.component_id for r in got if r.doc_id and 300 <= r.doc_id < 306}) < 6


@pytest.mark.parametrize("bits, radius", [(12, 2), (12, 3), (16, 4)])
def test_ball_links(spark, bits, radius):
    values = sorted({int(x) for x in np.random.default_rng(bits).integers(0, 1 << bits, 120)})
    got = simhash.ball_links(spark.createDataFrame([(v,) for v in values], "fp long"), bits, radius).collect()
    assert all(r.a < r.b and (r.a ^ r.b).bit_count() <= radius for r in got)
    parent, mine = {v: v for v in values}, {v: v for v in values}
    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= radius:
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    for r in got:
        x, y = find(mine, r.a), find(mine, r.b)
        mine[max(x, y)] = min(x, y)
    assert all(find(parent, v) == find(mine, v) for v in values)


def jaccard(a, b, size=5):
    def cut(t):
        ws = words(t)
        return {" ".join(ws[i:i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set()
    x, y = cut(a), cut(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def test_similar_documents(spark):
    import random
    rng = random.Random(4)
    rows = documents()
    bases = []
    for k in range(40):                                # a base and a copy with one word in 80 changed
        ws = prose(rng, 240, 10 ** 6).split()
        other = [w if i % 80 != 40 else f"new{k}" for i, w in enumerate(ws)]
        bases.append((1000 + 2 * k, 1001 + 2 * k))
        rows += [(1000 + 2 * k, " ".join(ws), "en", "s0"), (1001 + 2 * k, " ".join(other), "en", "s0")]
    hot = prose(rng, 240, 10 ** 6).split()             # one large group of near copies
    for k in range(150):
        ws = list(hot)
        ws[rng.randrange(240)] = f"hot{k}"
        rows.append((2000 + k, " ".join(ws), "en", "s0"))
    docs = table(spark, rows)
    out = similar.keep_one_of_similar(docs)
    assert out.dtypes == docs.dtypes
    kept = [r.doc_id for r in out.collect()]
    text = {d: t for d, t, _, _ in rows}
    assert sum(b in kept for _, b in bases) <= 2 and all(a in kept for a, _ in bases)      # recall
    assert sum(2000 <= (d or 0) < 2150 for d in kept) <= 3
    gone = set(text) - set(kept)
    for d in gone:                                     # nothing goes without a similar document that is linked
        assert any(jaccard(text[d], text[e]) >= 0.8 for e in text if e != d), d
    assert kept.count(220) <= 1 and 213 in kept and 214 in kept


def test_links_are_verified(spark):
    rows = [r for r in documents() if r[0] is not None and r[0] < 200]
    keyed = table(spark, rows).selectExpr("xxhash64(doc_id, text) as k", "doc_id", "text")
    ids = {r.k: r.text for r in keyed.collect()}
    _, links = similar.similar_links(keyed)
    pairs = [(ids[r.a], ids[r.b]) for r in links.collect()]
    assert pairs and all(jaccard(a, b) >= 0.8 for a, b in pairs)


def test_near_dedup_goes_through_the_balls(spark, monkeypatch):
    """The pipeline's step sends every text through ball hashing, and the exact check follows."""
    import random
    rng = random.Random(9)
    ws = prose(rng, 4000, 10 ** 6).split()
    rows = [(1, " ".join(ws), "en", "s0"), (2, " ".join([*ws[:2000], "other", *ws[2001:]]), "en", "s0"),
            (3, prose(rng, 200), "en", "s0"), (4, "", "en", "s0"), (5, None, "en", "s0")]
    docs = table(spark, rows)
    pairs = similar.fingerprint_pairs(docs.selectExpr("doc_id as k", "text")).collect()
    assert sorted((r.a, r.b) for r in pairs) == [(1, 2), (4, 5)]      # texts without words have fingerprint zero
    seen = []
    monkeypatch.setattr(similar, "components", lambda d: seen.append(d.count()) or simhash.components(d))
    kept = corpus_pipeline.near(spark, docs, "").collect()
    assert seen == [5] and sorted(r.doc_id for r in kept) == [1, 3, 4, 5]


def similar_groups(texts):
    """Groups (as sets of keys) over all pairs of similarity 0.8 or more."""
    cut = {}
    for k, t in texts.items():
        ws = words(t)
        cut[k] = {" ".join(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()
    keys = [k for k in cut if cut[k]]
    parent = {k: k for k in keys}
    for i, a in enumerate(keys):
        for b in keys[:i]:
            common = len(cut[a] & cut[b])
            if 5 * common >= 4 * (len(cut[a]) + len(cut[b]) - common):
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    return {k: find(parent, k) for k in keys}


@pytest.mark.parametrize("rule", [similar.Similar(), similar.Similar(apart=0), similar.Similar(apart=10 ** 9),
                                  similar.Similar(apart=0, block=3)])
def test_groups_against_all_pairs_at_the_threshold(spark, rule):
    import random
    rng = random.Random(11)
    texts = []
    for k in range(60):                                # pairs of similarity 0.80 to 0.85
        ws = prose(rng, 184 + k, 10 ** 6).split()
        other, at = list(ws), 5
        while True:
            tried = list(other)
            tried[at] = f"new{k}"
            if jaccard(" ".join(ws), " ".join(tried)) < 0.8:
                break
            other, at = tried, at + 7
        texts += [" ".join(ws), " ".join(other)]
    close = [jaccard(texts[i], texts[i + 1]) for i in range(0, 120, 2)]
    assert all(0.8 <= c <= 0.85 for c in close)
    for k in range(20):                                # one set within the other: 4 shingles of 5
        ws = prose(rng, 9, 10 ** 6).split()
        texts += [" ".join(ws), " ".join(ws[:-1])]
    for k in range(10):                                # a chain: neighbours are similar, its ends are not
        ws = prose(rng, 240, 10 ** 6).split()
        for step in range(6):
            texts.append(" ".join(ws))
            for i in (10 + 40 * step // 6 * 5, 20 + 40 * step // 6 * 5):
                ws[i] = f"step{step}"
    hot = prose(rng, 100, 10 ** 6).split()             # many copies, of which only some are similar
    for k in range(120):
        ws = list(hot)
        for i in rng.sample(range(100), rng.randrange(1, 4)):
            ws[i] = f"hot{k}"
        texts.append(" ".join(ws))
    docs = table(spark, [(i, t, "en", "s0") for i, t in enumerate(texts)])
    keyed = docs.selectExpr("doc_id as k", "doc_id", "text")
    want = similar_groups(dict(enumerate(texts)))
    _, links = similar.similar_links(keyed, rule)
    parent = {k: k for k in want}
    for r in links.collect():
        x, y = find(parent, r.a), find(parent, r.b)
        parent[max(x, y)] = min(x, y)
    assert {k: find(parent, k) for k in want} == want
    kept = {r.doc_id for r in similar.keep_one_of_similar(docs, rule).collect()}
    assert kept == set(want.values())


def test_components_of_few_rounds_and_of_stars(spark, monkeypatch):
    """A graph of stars is done as it is; a bounded number of rounds gives every node one component it is joined to."""
    written = []
    monkeypatch.setattr(components, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    stars = spark.createDataFrame([(1, b) for b in range(2, 30)] + [(50, 40), (51, 40), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(stars).collect()}
    assert got == {b: 1 for b in range(1, 30)} | {40: 40, 50: 40, 51: 40} and written == ["edges"]
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    rows = components.connected_components(chain, rounds=1).collect()
    assert sorted(r.node for r in rows) == list(range(61)) and written == ["edges"] * 3
    assert all(0 <= r.component <= r.node for r in rows) and len({r.component for r in rows}) > 1
