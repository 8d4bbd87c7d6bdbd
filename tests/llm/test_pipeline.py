from collections import defaultdict

from text_fixtures import documents, empty, table

import corpus_pipeline
from tracewright.llm import line_quality, raking
from tracewright.llm.queries import ORACLE, QUERIES


def test_stages(spark, tmp_path):
    """Every stage on what the one before kept; each against what it is made of."""
    docs = table(spark)
    columns, before = docs.columns, {(r.doc_id, r.text) for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "source mixture", "packing"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        kept_ids = ({r.doc_id for r in line_quality.judge(docs).filter("kept").collect()} if i == 0 else
                    {r.doc_id for r in raking.mixture(docs).filter("selected").collect()} if i == 3 else None)
        out = stage(spark, docs, "")
        assert out.columns == columns
        path = str(tmp_path / str(i))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        if kept_ids is not None:
            assert {d for d, _ in rows} == kept_ids
        if i == 1:                                              # one row of every text, the largest id
            groups = defaultdict(list)
            for d, t in before:
                groups[t].append(d)
            assert sorted(rows) == sorted((max(ids), t) for t, ids in groups.items())
        if i == 2:
            assert before - set(rows) and sum(100 <= d < 104 for d, _ in rows) < 4
        if i:
            assert set(rows) <= before and len(rows) == len(set(rows))
        before = set(rows)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in packed} == {d for d, _ in before}
    assert all(r.offset + r.length <= 4096 for r in packed)


def test_run(spark, tmp_path):
    table(spark).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def test_stages_on_an_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), "").count() == 0


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)] and set(ORACLE) <= set(QUERIES)
