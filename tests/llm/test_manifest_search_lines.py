import hashlib
import random
from collections import Counter, defaultdict
from math import floor, log

import pytest
from pyspark.sql import functions as F
from text_fixtures import documents, empty, lower, prose, table

from tracewright.llm import line_dedup, merkle, strata


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_manifest(rows):
    """Leaf, subroot and proof (list of (place, others)) of every row, and the root, by plain lists."""
    def up(hs):
        levels = [hs]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, i):
        out = []
        for hs in levels[:-1]:
            run = hs[i // 8 * 8:i // 8 * 8 + 8]
            out.append((i % 8, run[:i % 8] + run[i % 8 + 1:]))
            i //= 8
        return out

    langs = defaultdict(list)
    for d, text, lang, source in rows:
        values = (d, source, lang, None if text is None else len(text))
        leaf = sha("".join(map(field, (*values, text))))
        langs[lang].append((d is not None, d or 0, leaf, sha("".join(map(field, (*values, None if text is None else lower(text)))))))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: up([r[2] for r in sorted(langs[x])]) for x in order}
    top = up([trees[x][-1][0] for x in order])
    out = []
    for j, x in enumerate(order):
        for i, (has, d, leaf, changed) in enumerate(sorted(langs[x])):
            out.append((d if has else None, leaf, changed, trees[x][-1][0], path(trees[x], i) + path(top, j)))
    return out, top[-1][0] if order else None


def climb(leaf, path):
    for place, others in path:
        leaf = sha("".join([*others[:place], leaf, *others[place:]]))
    return leaf


@pytest.mark.parametrize("extra", [0, 1300])
def test_manifest(spark, extra):
    rows = documents() + [(990, "Capital Letters", None, "s0")] + [(1000 + i, f"Text {i}", "en" if i < 1200 else f"l{i % 11}", "s0") for i in range(extra)]
    want, root = plain_manifest(rows)
    docs = table(spark, rows)
    got = merkle.audit(docs, F.col("doc_id") % 2 == 0).collect()
    plain = sorted((str(d), leaf, subroot, sha("".join(x for _, o in path for x in o)),
                    climb(changed if d is not None and d % 2 == 0 else leaf, path)) for d, leaf, changed, subroot, path in want)
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.proof_sha256, r.folded_root) for r in got) == plain
    assert {r.root for r in got} == {root} and all(r.verified == (r.folded_root == root) for r in got)
    assert any(r.verified for r in got) and not all(r.verified for r in got)
    manifest = merkle.build(docs)
    proofs = merkle.proofs(manifest).collect()
    assert len(proofs) == len(rows)
    assert all(merkle.fold(r.leaf, r.path) == r.root == root for r in proofs)
    logs = defaultdict(list)
    for r in merkle.log_rows(manifest).collect():
        logs[r.key].append((r.position, r.digest))
    for lang in {r[2] for r in rows}:
        key = "" if lang is None else "=" + lang
        leaves = sorted((d is not None, d or 0, sha("".join(map(field, (d, s, x, None if t is None else len(t), t)))))
                        for d, t, x, s in rows if x == lang)
        whole = merkle.append_log([x[2] for x in leaves], merkle.height(len(leaves)))
        assert sorted(logs[key]) == list(enumerate(whole))


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 511, 512, 513, 700])
def test_positions(n):
    h = merkle.height(n)
    log = merkle.append_log([str(i) for i in range(n)], h)
    levels = [[str(i) for i in range(n)]]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
    assert len(log) == sum(map(len, levels)) and len(levels) == h + 1
    for k, hs in enumerate(levels):
        assert [log[merkle.position(k, i, n)] for i in range(len(hs))] == hs


def plain_lines(rows):
    held = defaultdict(set)
    for d, text, _, _ in rows:
        who = (d is None, 0 if d is None else d, "" if d is not None else text or "")
        for line in (text or "").split("\n"):
            key = lower(line.strip(" \t\n\v\f\r"))
            if len(key) >= 10:
                held[key].add(who)
    out = []
    for d, text, _, _ in rows:
        who = (d is None, 0 if d is None else d, "" if d is not None else text or "")
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(k := lower(x.strip(" \t\n\v\f\r"))) < 10
                or (who == min(held[k]) if d is not None else all(w[0] for w in held[k]) and len(held[k]) == 1)]
        out.append((str(d), len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out)


@pytest.mark.parametrize("partitions", [1, 8, 60])
def test_line_dedup(spark, partitions):
    rng = random.Random(5)
    rows = documents()
    hot = "This line is in nearly every document"
    rows += [(3000 + i, "\n".join([hot, prose(rng, 5), f"  {hot.upper()}\t", "short", prose(rng, 3, 30), hot, ""]), "en", "s0")
             for i in range(300)]
    rows += [(2 ** 63 - 1, hot + "\nown line of the last", "en", "s0"), (-5, "one line that is only here\n\n" + hot.lower(), None, None)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = line_dedup.deduplicate(table(spark, rows))
        assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in got.collect()) == plain_lines(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_line_bitmaps(spark):
    rows = [(1, "a common line of both\nx", "en", "s"), (2, "first own line here\nA common line of both \nlast own line", "en", "s")]
    (r,) = line_dedup.keep_bitmaps(table(spark, rows)).collect()
    assert (r.d, r.lost, r.last) == (2, 1, 1) and list(line_dedup.bits(r.keep, 2)) == [True, False]
    assert line_dedup.apply_bitmap(rows[1][1], r.last, r.keep) == ["first own line here", "last own line"]


def test_line_dedup_of_rows_without_id(spark):
    rows = [(None, "the very same line\none", "en", "s"), (None, "the very same line\none", "en", "s"), (4, "the very same line", "en", "s")]
    got = sorted((str(r.doc_id), r.n_dropped) for r in line_dedup.deduplicate(table(spark, rows)).collect())
    assert got == [("4", 0), ("None", 1), ("None", 1)]
    got = [r.n_dropped for r in line_dedup.deduplicate(table(spark, rows[:2])).collect()]
    assert got == [0, 0]                                      # equal texts without id are one document


def plain_search(docs, items, k=20):
    def cut(t):
        return "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in lower(t)).split(" ")

    rows = [(d, Counter(x for x in cut(t) if x)) for d, t, _, _ in docs]
    rows = [(d, c) for d, c in rows if c]
    total, length = len(rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(w for _, c in rows for w in c)
    out = []
    wanted = defaultdict(Counter)
    for item, text in set(items):
        wanted[item].update(x for x in cut(text) if x)
    for item, q in wanted.items():
        scores = []
        for j, (d, c) in enumerate(rows):
            m = 75 + 25 * sum(c.values()) * total // length
            s = sum(n * floor(1000 * log((2 * total + 2) / (2 * df[w] + 1))) * (10 ** 9 * c[w] // (1000 * c[w] + 12 * m))
                    for w, n in q.items() if w in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard, block, wave", [(8192, 512, 32), (7, 2, 3)])
def test_search(spark, monkeypatch, shard, block, wave):
    monkeypatch.setattr(strata, "ITEM_BLOCK", block)
    monkeypatch.setattr(strata, "FIRST_WAVE", wave)
    rng = random.Random(9)
    rows = documents() + [(4000 + i, prose(rng, 30, 60), "en", "s0") for i in range(80)]       # many ties in m
    rows += [(5000 + i, "tied words of one kind", "en", "s0") for i in range(40)]
    items = [(1, prose(rng, 12, 60)), (2, "Tied WORDS, tied; of-one kind"), (3, "Straße É w5x w6x w7x w7x"), (4, None), (5, ""),
             (6, "noneofthesewords"), (None, "w1x w2x"), (1, "w3x"), (2, "Tied WORDS, tied; of-one kind"),
             (7, rows[70][1])]
    index = strata.build_index(table(spark, rows), shard)
    asked = spark.createDataFrame([(i, t, 0, "x") for i, t in items], "item_id long, text string, rank int, term string")
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in strata.search(index, asked).collect()), key=str)
    assert got == plain_search(rows, [(i, t) for i, t in items if t])


def test_index_shards_hold_a_bounded_number_of_words(spark, monkeypatch):
    """Long documents make more shards, a shard comes in batches of terms, and results stay the same."""
    monkeypatch.setattr(strata, "TERM_BATCH", 5)
    rng = random.Random(10)
    rows = [(i, prose(rng, 60, 90), "en", "s0") for i in range(50)] + [(None, prose(rng, 60, 90), "en", "s0")]
    items = [(1, prose(rng, 12, 90)), (2, prose(rng, 5, 90))]
    index = strata.build_index(table(spark, rows), shard_words=300)
    heads = index.filter("term is null").collect()
    assert len(heads) > 4 and sum(r.n_docs for r in heads) == 51
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in strata.search(index, asked).collect()), key=str)
    assert got == plain_search(rows, items)


def test_search_visits_fewer_strata_than_there_are():
    import numpy as np
    m, held = np.arange(75, 175), np.full(100, 50)
    runs = np.array([(s, 9 if s == 40 else 1, 50) for s in range(100)], "<i4")
    term = strata._Term(runs.tobytes(), np.arange(5000).astype("<u2").tobytes(), m)
    score, found = strata.rank_shard(np.stack([m, held], 1), [(term, 3)], 20, 0)
    assert set(found) == set(range(2000, 2050)) and (score > 0).sum() < 500


def test_empty_tables(spark):
    assert merkle.audit(empty(spark), F.lit(True)).count() == 0
    assert merkle.log_rows(merkle.build(empty(spark))).count() == 0
    assert line_dedup.deduplicate(empty(spark)).count() == 0
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert strata.search(strata.build_index(empty(spark)), items).count() == 0
    assert strata.search(strata.build_index(table(spark)), items.limit(0)).count() == 0
    nothing = table(spark, [(1, None, None, None), (2, "", "en", "s"), (3, " .,\n", "en", "s")])
    assert strata.search(strata.build_index(nothing), items).count() == 0
