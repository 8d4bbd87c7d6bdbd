"""Catalogue, reports, datasets and rejects."""

import pytest
from pyspark.sql import functions as F

from tracewright.operators.channels import channels_to_interpolate
from tracewright.plans.tables import materialize
from tracewright.sources import catalogue as CAT, report as R, tables as B

REPORT = """header text
[1/4] P20_A.edf
  total: 3
    deviation   : [np.str_('F8'), 'Pz']
    hf_noise    : ['O1', 'Pz']
    correlation : []
    ransac      : ['T6', broken
    ransac      : ['T6']
[2/4] P21_B.edf
[3/4] P22_C.edf
    deviation   : ['Fp1']
    deviation   : ['Fp2']
    correlation : [1, "C3"]
    hf_noise    : None
[4/4] P20_A.edf
    hf_noise    : ['O2']
    ransac : ['Fz',]
not a header [5/5] P30.edf
"""


def test_report_rules(spark):
    got = {r.recording_id: r for r in R.parse_reports(spark.createDataFrame([("r", REPORT)], "report_id string, value string")).collect()}
    lists = {k: (v.deviation, v.hf_noise, v.correlation, v.ransac) for k, v in got.items()}
    assert lists == {
        "P20_A": ([], ["O2"], [], ["Fz"]),            # the later block replaces the earlier one
        "P21_B": ([], [], [], []),
        "P22_C": (["Fp1"], [], ["1", "C3"], []),      # the first line of a category wins
    }
    first = REPORT.split("[4/4]")[0]
    row = {r.recording_id: r for r in R.parse_reports(spark.createDataFrame([("r", first)], "report_id string, value string")).collect()}["P20_A"]
    assert (row.deviation, row.hf_noise, row.ransac) == (["F8", "Pz"], ["O1", "Pz"], ["T6"])


def test_malformed_list_is_empty(spark):
    bad = "['A', B]", "['A' 'B'", "['A', ['B']]", "['A',, 'B']", "[np.str_('A')", "['A', 'B'] tail"
    texts = [(str(i), f"[1/1] P1_x.edf\n deviation : {b}\n") for i, b in enumerate(bad)]
    got = R.parse_reports(spark.createDataFrame(texts, "report_id string, value string")).collect()
    assert len(got) == len(bad) and all(r.deviation == [] for r in got)


def test_report_file_and_interpolation_sets(spark, tmp_path):
    (tmp_path / "report.txt").write_text(REPORT)
    rows = R.report_rows(R.parse_reports(R.read_reports(spark, str(tmp_path / "report.txt"))))
    got = {r.recording_id: (r.interpolate, r.hf_only) for r in channels_to_interpolate(rows).collect()}
    assert got == {"P20_A": (["Fz"], ["O2"]), "P22_C": (["1", "C3", "Fp1"], [])}
    present = spark.createDataFrame([("P22_C", "C3"), ("P20_A", "Cz")], "recording_id string, channel string")
    got = {r.recording_id: r.interpolate for r in channels_to_interpolate(rows, present).collect()}
    assert got == {"P20_A": [], "P22_C": ["C3"]}


def test_one_report_read_by_several_tasks(spark, tmp_path):
    """Lines of one file over many splits give what the whole text gives, with blocks and repeated recordings across splits."""
    parts = [REPORT.replace("P20_A", f"P20_{i % 7}").replace("P22_C", f"P22_{i}").replace("C3", f"C{i}") for i in range(40)]
    (tmp_path / "long.txt").write_text("no block yet\n  ransac : ['Q1']\n" + "\n".join(parts) + "\n" + "tail\n" * 400)
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "short.txt").write_text(REPORT)
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    try:
        for k, v in zip(keys, ("700", "1")):
            spark.conf.set(k, v)
        lines = materialize(R.read_report_lines(spark, str(tmp_path / "*.txt")), "lines")
        assert lines.filter(F.col("report_id").contains("long")).select("split").distinct().count() > 10
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)
    value = lambda df: sorted((r.report_id.rsplit("/", 1)[1], r.recording_id, r.deviation, r.hf_noise, r.correlation, r.ransac) for r in df.collect())
    got, want = value(R.parse_report_lines(lines)), value(R.parse_reports(R.read_reports(spark, str(tmp_path / "*.txt"))))
    assert got == want and len(got) > 50


def test_catalogue_names(spark, tmp_path):
    names = ["P20_a.edf", "p20_x.edf", "X20_.edf", "P28_b.edf", "P7_c.edf", "P_1.edf", "P20.edf", "note.txt"]
    for n in names:
        (tmp_path / n).write_text("content")
    files = CAT.list_files(spark, str(tmp_path), "*.edf")
    assert sorted(r.file_name for r in files.collect()) == sorted(n for n in names if n.endswith(".edf"))
    assert {(r.file_name, r.patient) for r in CAT.recording_catalogue(files).collect()} == {("P20_a.edf", 20), ("P7_c.edf", 7)}
    assert {(r.file_name, r.patient_id) for r in CAT.patient_index(files).collect()} == {
        ("P20_a.edf", "P20"), ("p20_x.edf", "P20"), ("P28_b.edf", "P28"), ("P7_c.edf", "P7")}
    assert {r.file_name for r in CAT.unparsed_files(files).collect()} == {"X20_.edf", "P_1.edf", "P20.edf"}
    with pytest.raises(ValueError):
        CAT.require_rows(CAT.patient_index(files.filter("false")), "no files")


def test_embedding_reader(spark):
    df = spark.createDataFrame([([1.0, 2.0], 1), ([3.0, 4.0], 0)], "embeddings array<float>, labels int")
    rows = B.read_embeddings(df, 2)
    assert B.embedding_width(rows) == 2
    wide, names = B.embedding_columns(rows, 2)
    assert names == ["f0", "f1"] and [(r.f0, r.f1, r.y) for r in wide.collect()] == [(1.0, 2.0, 1), (3.0, 4.0, 0)]
    with pytest.raises(Exception, match="embedding of size 2"):
        B.read_embeddings(df, 3).collect()
    with pytest.raises(KeyError):
        B.read_embeddings(df.drop("labels"))
    both = df.withColumn("X", F.array(F.lit(9.0)))
    assert B.read_embeddings(both).first().emb == [9.0]


def test_datasets_with_different_layouts(spark, tmp_path):
    a = spark.createDataFrame([("P1", 1.5, 0.1)], "patient_id string, center_sec double, rms double")
    b = spark.createDataFrame([("P2", 2.5, 1.0, 0.2)], "patient_id string, onset_sec double, window_sec double, rms double")
    B.write_dataset(a, str(tmp_path / "a"))
    B.write_dataset(b, str(tmp_path / "b"))
    rows = B.as_event_onset(B.read_dataset(spark, str(tmp_path / "a"), str(tmp_path / "b"))).orderBy("patient_id").collect()
    assert [(r.patient_id, r.time_sec, r.window_sec) for r in rows] == [("P1", 1.5, None), ("P2", 2.5, 1.0)]
    B.write_csv(a, str(tmp_path / "c"), single_file=True)
    assert len(list((tmp_path / "c").glob("*.csv"))) == 1


def test_crop_is_pushed_to_the_scan(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("chunk"), F.array(F.lit(1.0)).alias("x")).write.parquet(str(tmp_path / "s"))
    df = B.crop(spark.read.parquet(str(tmp_path / "s")), 10, 205, 399)
    assert [r.chunk for r in df.orderBy("chunk").collect()] == list(range(20, 40))
    assert "PushedFilters: [IsNotNull(chunk), GreaterThanOrEqual(chunk,20), LessThanOrEqual(chunk,39)]" in (
        df._jdf.queryExecution().executedPlan().toString())


def test_stage_tables_are_deleted_when_asked(spark):
    from tracewright.plans.tables import discard, materialize
    table = materialize(spark.range(5), "numbers")
    assert table.count() == 5
    discard(table)
    with pytest.raises(Exception):
        spark.read.parquet(table.stage_path)
