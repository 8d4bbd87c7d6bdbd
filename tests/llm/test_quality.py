from collections import Counter, defaultdict

import pytest
from oracle_check import TABLES, differences
from text_fixtures import WORD, documents, empty, table

from tracewright.llm import line_quality
from tracewright.llm.queries import ORACLE


def plain(rows, limits):
    texts_of, host_texts = defaultdict(set), defaultdict(set)
    for d, t, _, s in rows:
        for line in (t or "").split("\n"):
            if WORD.search(line):
                k = normal(line)
                texts_of[s, k].add(t)
                host_texts[s].add(t)
    out = {}
    for d, t, _, s in rows:
        t = t or ""
        ws = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows = [tuple(ws[i:i + 8]) for i in range(len(ws) - 7)]
        n = Counter(windows)
        covered = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(8)}
        gone = [x for x in lines if len(texts_of[s, normal(x)]) > limits.documents
                and len(texts_of[s, normal(x)]) > limits.share * len(host_texts[s])]
        removed = sum(len(WORD.findall(x)) for x in gone)
        failed = len(ws) < 20 or 100 * len(covered) > 30 * len(ws)
        kept = not failed and len(ws) - removed >= limits.left * len(ws)
        text = "\n".join(x for x in t.split("\n") if x not in gone)
        out[d, t] = (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)),
                     len(covered), failed, removed, kept, text)
    return out


def normal(line):
    import re
    return re.sub("[0-9]", "0", re.sub(r"[\x20\x09-\x0D]+", " ", line)).strip(" ").lower()


LIMITS = [line_quality.LineLimits(), line_quality.LineLimits(documents=5, share=0.01, left=0.7)]


@pytest.mark.parametrize("limits", LIMITS)
def test_judge(spark, limits):
    rows = documents()
    want = plain(rows, limits)
    got = line_quality.judge(table(spark), limits).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    for (d, _), w in want.items():
        if d is not None:
            r = by_id[d]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed,
                    r.removed_words, r.kept) == w[:8], d
    assert sum(r.doc_id is None for r in got) == 2


@pytest.mark.parametrize("limits", LIMITS)
def test_keep_good(spark, limits):
    rows = documents()
    docs = table(spark)
    out = line_quality.keep_good(docs, limits)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    want = plain(rows, limits)
    expected = sorted((str(d), want[d, t or ""][8], g, s) for d, t, g, s in rows if want[d, t or ""][7])
    got = sorted((str(r.doc_id), r.text, r.lang, r.source) for r in out.collect())
    assert str(got) == str(expected)
    assert all(r.n_chars == len(r.text) for r in out.collect())
    if limits.left == 0.7:
        assert any(len(w[8]) < len(t) for (d, t), w in want.items() if w[7])


def test_copies_do_not_make_lines_frequent(spark):
    text = "\n".join(" ".join(f"{c}{i}" for i in range(9)) for c in "abcde")
    rows = [(i, text, "en", "s") for i in range(60)]
    assert line_quality.judge(table(spark, rows)).filter("not kept").count() == 0


def test_empty(spark):
    assert line_quality.judge(empty(spark)).count() == 0
    assert line_quality.keep_good(empty(spark)).count() == 0


def test_oracle_on_awkward_rows(spark):
    import duckdb
    rows = [r for i, r in enumerate(documents()) if r[0] is not None and r[0] != 220]
    con = duckdb.connect()
    frame = table(spark, rows).select("doc_id", "text", "lang", "source").toPandas()
    con.register("documents", frame)
    got = line_quality.judge(table(spark, rows)).toPandas()
    assert differences(got, con.execute(ORACLE["op1_line_frequency"]).df()) is None and TABLES


def test_no_python(spark):
    plan = line_quality.judge(table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
