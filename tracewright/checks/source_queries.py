"""Queries on catalogues, names, reports, rejects and dataset round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracewright.checks import views as V
from tracewright.checks.views import r, rs, sql
from tracewright.functions import text as T
from tracewright.operators import channels as CH, features as X, segments as S, windows as W
from tracewright.sources import catalogue as CAT, report as R, tables as B
from tracewright.plans.tables import materialize
from tracewright.session import scratch_path

RAW_CHANNELS = ["EEG Fp1", "EEG T3 ", " EEG T5", "Cz", "EEG EKG", "T8", "EEG EEG O1", "Pz ", "A1", "EEG T6", "fp2"]


def files(spark, sf) -> DataFrame:
    """One file name per customer: upper and lower case ids, names without id, patient 28."""
    k = F.col("c_custkey")
    name = (F.when(k % 7 == 0, F.concat(F.lit("p"), k % 40, F.lit("_A_"), k)).when(k % 7 == 1, F.concat(F.lit("X"), k))
            .when(k % 7 == 2, F.concat(F.lit("P28_"), k)).otherwise(F.concat(F.lit("P"), k % 60, F.lit("_GHB_"), k)))
    return V.table(spark, sf, "customer").select(F.concat(name, F.lit(".edf")).alias("file_name"))


def catalogue(spark, sf):
    return CAT.recording_catalogue(files(spark, sf))


def patient_index(spark, sf):
    return CAT.patient_index(files(spark, sf))


def files_per_patient(spark, sf):
    return CAT.files_per_patient(files(spark, sf))


def channel_names(spark, sf):
    k = F.col("ps_key")
    raw = F.element_at(F.array(*[F.lit(c) for c in RAW_CHANNELS]), (k % len(RAW_CHANNELS) + 1).cast("int"))
    return V.table(spark, sf, "part").select(F.col("p_partkey").alias("ps_key")).select(
        F.expr("ps_key div 8").alias("recording_id"), k.alias("pos"), raw.alias("channel"))


def channel_clean(spark, sf):
    return channel_names(spark, sf).select("pos", T.clean_channel(F.col("channel")).alias("cleaned"),
                                           CH.rename_channel(F.col("channel")).alias("renamed"))


def channel_set(spark, sf):
    return CH.resolve_channels(channel_names(spark, sf)).select("recording_id", "pos", "channel", "ch_ord")


def time_text(spark, sf):
    a = V.annotations(spark, sf)
    return a.select("ord", T.time_text(F.col("onset_sec")).alias("rounded"),
                    T.time_text_truncated(F.col("onset_sec")).alias("cut"))


def reports(spark, sf) -> DataFrame:
    """One report per document: a block with four categories (quoted names, unwrapped
    names, empty, malformed or missing lists), a bare block, and in every third report a
    second block of the first recording."""
    d = F.col("doc_id")
    deviation = (F.when(d % 5 == 0, "    deviation   : [np.str_('C1'), 'C2']\n").when(d % 5 == 1, "    deviation   : []\n")
                 .when(d % 5 == 2, "    deviation   : ['C3, 'C4']\n").when(d % 5 == 3, '    deviation   : ["Fp1"]\n')
                 .otherwise(""))
    again = F.when(d % 3 == 0, F.concat(F.lit("[3/3] P"), d, F.lit("_A.edf\n  deviation: ['Z9']\n"))).otherwise("")
    text = F.concat(
        F.lit("Channel detection\n\n[1/3] P"), d, F.lit("_A.edf\n"), deviation,
        F.lit("    hf_noise    : ['C"), d % 8, F.lit("']\n    correlation : ['C"), d % 3, F.lit("', 'C5']\n"),
        F.when(d % 2 == 0, "    ransac      : ['O1',]\n").otherwise("    ransac      : []\n"),
        F.lit("    deviation   : ['XX']\n[2/3] P"), d, F.lit("_B.edf   \n  total: 3\n"), again)
    return V.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("report_id"), text.alias("value"))


def report_channels(spark, sf):
    p = R.parse_reports(reports(spark, sf))
    return p.select("report_id", "recording_id", *[
        F.concat_ws(",", c).alias(c) for c in ("deviation", "hf_noise", "correlation", "ransac")])


def report_lines(spark, sf):
    """The reports as text files, read line by line over splits."""
    path = scratch_path(spark, "reports")
    reports(spark, sf).select("value").write.text(path)
    p = R.parse_report_lines(materialize(R.read_report_lines(spark, path), "lines"))
    return p.select("recording_id", *[F.concat_ws(",", c).alias(c) for c in ("deviation", "hf_noise", "correlation", "ransac")])


def report_interpolation(spark, sf):
    """Lists per recording, limited to channels C0 to C5 and O1."""
    rows = R.report_rows(R.parse_reports(reports(spark, sf))).drop("report_id")
    present = rows.select("recording_id", "channel").filter(F.col("channel").rlike("^(C[0-5]|O1)$"))
    lists = CH.channels_to_interpolate(rows, present)
    return lists.select("recording_id", F.concat_ws(",", "interpolate").alias("interpolate"),
                        F.concat_ws(",", "hf_only").alias("hf_only"))


def rejects(spark, sf):
    """Recordings without a long segment, without standard channels, and unparsed names."""
    windows = W.sliding_windows(S.build_segments(V.annotations(spark, sf)), V.RATE, 100_000.0, V.STRIDE_SEC)
    odd = channel_names(spark, sf).filter("pos % 11 in (4, 8, 10) OR recording_id % 2 = 0")
    return B.rejects(B.empty_recordings(V.recordings(spark, sf), windows), CH.without_channels(odd),
                     CAT.unparsed_files(files(spark, sf)))


def missing_recordings(spark, sf):
    windows = V.annotations(spark, sf).select("recording_id")
    there = V.recordings(spark, sf).filter("recording_id % 5 <> 0")
    return B.missing_recordings(windows, there)


def window_defaults(spark, sf):
    s = S.build_segments(V.annotations(spark, sf)).withColumn("seg_type", F.lower("seg_type"))
    odd = F.when(F.col("segment_id") % 2 == 0, F.lit(2.0))
    made = X.with_defaults(s.withColumn("window_sec", odd))
    return made.select("recording_id", "segment_id", "seg_type", "window_sec",
                       F.isnan("stride_sec").alias("no_stride"), "source", "valid")


def roundtrip_parquet(spark, sf):
    """Two layouts (centre or onset) written, read back as one table."""
    a = V.annotations(spark, sf)
    paths = [scratch_path(spark, n) for n in ("centred", "sliding")]
    first = a.filter("ord % 2 = 0").select("recording_id", "ord", F.col("onset_sec").alias("center_sec"))
    second = a.filter("ord % 2 = 1").select("recording_id", "ord", "onset_sec", F.lit(1.0).alias("window_sec"))
    bucket = F.concat(F.lit("P"), F.col("recording_id") % 10)
    for df, path, name in ((first, paths[0], "annot_centered"), (second, paths[1], "features")):
        B.write_dataset(df.withColumns({"patient_id": bucket, "dataset": F.lit(name)}), path, ["dataset", "patient_id"])
    back = B.as_event_onset(B.read_dataset(spark, *paths))
    return back.select("dataset", "patient_id", "recording_id", "ord", r("time_sec").alias("time_sec"),
                       F.coalesce("window_sec", F.lit(0.0)).alias("window_sec"))


def roundtrip_csv(spark, sf):
    path = scratch_path(spark, "balance")
    from tracewright.operators.stats import class_balance
    B.write_csv(class_balance(V.scored(spark, sf), ["patient_id"]), path, single_file=True)
    return spark.read.option("header", True).schema("patient_id string, n bigint, n_pos bigint, n_neg bigint").csv(path)


def embedding_reader(spark, sf):
    raw = V.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("emb"), "label")
    rows, names = B.embedding_columns(B.read_embeddings(raw, 64), 64)
    return rows.select("vec_id", "y", *[r(n).alias(n) for n in names])


def crop_scan(spark, sf):
    """Samples 100 to 299 of the stored recordings."""
    return B.crop_samples(materialize(V.chunks(spark, sf), "chunks"), V.CHUNK, 100, 299)


QUERIES = {f.__name__: f for f in (
    catalogue, patient_index, files_per_patient, channel_clean, channel_set, time_text, report_channels,
    report_interpolation, rejects, missing_recordings, window_defaults, roundtrip_parquet, roundtrip_csv,
    embedding_reader, crop_scan, report_lines)}

_FILES = """
SELECT CASE WHEN k % 7 = 0 THEN 'p' || (k % 40) || '_A_' || k WHEN k % 7 = 1 THEN 'X' || k WHEN k % 7 = 2 THEN 'P28_' || k
            ELSE 'P' || (k % 60) || '_GHB_' || k END || '.edf' AS file_name
FROM (SELECT c_custkey AS k FROM customer)"""
_RAW = "list_extract([" + ", ".join(f"'{c}'" for c in RAW_CHANNELS) + f"], p_partkey % {len(RAW_CHANNELS)} + 1)"
_NAMES = f"""
SELECT *, CASE cleaned WHEN 'T3' THEN 'T7' WHEN 'T4' THEN 'T8' WHEN 'T5' THEN 'P7' WHEN 'T6' THEN 'P8' ELSE cleaned END AS renamed
FROM (SELECT p_partkey // 8 AS recording_id, p_partkey AS pos, trim(replace({_RAW}, 'EEG ', '')) AS cleaned FROM part)"""
_CANON = "['Fp1','Fp2','F7','F3','Fz','F4','F8','T7','C3','Cz','C4','T8','P7','P3','Pz','P4','P8','O1','O2']"
_TEXT = "printf('%02d:%02d:%02d.%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"
_REPORT = """
SELECT doc_id AS d, CAST(doc_id AS VARCHAR) AS report_id, 'P' || doc_id || '_A' AS recording_id,
       CASE WHEN doc_id % 3 = 0 THEN 'Z9' WHEN doc_id % 5 = 0 THEN 'C1,C2' WHEN doc_id % 5 = 3 THEN 'Fp1'
            WHEN doc_id % 5 = 4 THEN 'XX' ELSE '' END AS deviation,
       CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'C' || (doc_id % 8) END AS hf_noise,
       CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'C' || (doc_id % 3) || ',C5' END AS correlation,
       CASE WHEN doc_id % 3 <> 0 AND doc_id % 2 = 0 THEN 'O1' ELSE '' END AS ransac
FROM documents"""

ORACLE = {
    "catalogue": sql("""SELECT * FROM (SELECT file_name, CAST(nullif(regexp_extract(file_name, '^P(\\d+)_', 1), '') AS INTEGER) AS patient FROM f)
        WHERE patient IS NOT NULL AND patient <> 28""", extra={"f": _FILES}),
    "patient_index": sql("""SELECT file_name, patient_id FROM (SELECT file_name, upper(regexp_extract(file_name, '^([pP]\\d+)_', 1)) AS patient_id FROM f)
        WHERE patient_id <> ''""", extra={"f": _FILES}),
    "files_per_patient": sql("""SELECT patient_id, count(*) AS n_files, min(file_name) AS first_file, max(file_name) AS last_file
        FROM (SELECT file_name, upper(regexp_extract(file_name, '^([pP]\\d+)_', 1)) AS patient_id FROM f) WHERE patient_id <> '' GROUP BY 1""", extra={"f": _FILES}),
    "channel_clean": sql("SELECT pos, cleaned, renamed FROM n", extra={"n": _NAMES}),
    "channel_set": sql(f"""SELECT recording_id, pos, renamed AS channel, CAST(list_position({_CANON}, renamed) - 1 AS INTEGER) AS ch_ord
        FROM n WHERE list_contains({_CANON}, renamed)""", extra={"n": _NAMES}),
    "time_text": sql(f"""SELECT ord, {_TEXT.format('a')} AS rounded, {_TEXT.format('b')} AS cut
        FROM (SELECT ord, CAST(round_even(onset_sec * 1000, 0) AS BIGINT) AS a,
                     CAST(floor(onset_sec) AS BIGINT) * 1000 + CAST(floor((onset_sec - floor(onset_sec)) * 1000) AS BIGINT) AS b FROM annotations)""", "annotations"),
    "report_channels": sql("""SELECT report_id, recording_id, deviation, hf_noise, correlation, ransac FROM rep
        UNION ALL SELECT report_id, 'P' || d || '_B', '', '', '', '' FROM rep""", extra={"rep": _REPORT}),
    "report_lines": sql("""SELECT recording_id, deviation, hf_noise, correlation, ransac FROM rep
        UNION ALL SELECT 'P' || d || '_B', '', '', '', '' FROM rep""", extra={"rep": _REPORT}),
    "report_interpolation": sql("""SELECT recording_id, coalesce(string_agg(DISTINCT c, ',' ORDER BY c) FILTER (regexp_full_match(c, 'C[0-5]|O1')), '') AS interpolate,
            CASE WHEN max(hf_noise) = '' OR list_contains(list(c), max(hf_noise)) THEN '' ELSE max(hf_noise) END AS hf_only
        FROM (SELECT recording_id, hf_noise, unnest(string_split(deviation || ',' || correlation || ',' || ransac, ',')) AS c FROM rep) GROUP BY 1""", extra={"rep": _REPORT}),
    "rejects": sql("""
        SELECT CAST(recording_id AS VARCHAR) AS item, 'no windows' AS reason FROM recordings
        WHERE recording_id NOT IN (SELECT recording_id FROM segments WHERE round_even(seg_stop - seg_start, 0) >= 100000)
        UNION ALL SELECT CAST(recording_id AS VARCHAR), 'no standard channels' FROM n WHERE pos % 11 IN (4, 8, 10) OR recording_id % 2 = 0
            GROUP BY recording_id HAVING count(*) FILTER (list_contains({canon}, renamed)) = 0
        UNION ALL SELECT file_name, 'no patient id' FROM f WHERE NOT regexp_matches(file_name, '^[pP]\\d+_')""".replace("{canon}", _CANON),
        "recordings", "segments", extra={"n": _NAMES, "f": _FILES}),
    "missing_recordings": sql("SELECT recording_id, 'recording not found' AS reason FROM recordings WHERE recording_id % 5 = 0", "recordings"),
    "window_defaults": sql("""SELECT recording_id, segment_id, seg_type, CASE WHEN segment_id % 2 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS window_sec,
        true AS no_stride, CAST(recording_id AS VARCHAR) AS source, true AS valid FROM segments""", "segments"),
    "roundtrip_parquet": sql(f"""SELECT CASE WHEN ord % 2 = 0 THEN 'annot_centered' ELSE 'features' END AS dataset, 'P' || (recording_id % 10) AS patient_id,
        recording_id, ord, {rs('onset_sec')} AS time_sec, CASE WHEN ord % 2 = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS window_sec FROM annotations""", "annotations"),
    "roundtrip_csv": sql("SELECT patient_id, count(*) AS n, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg FROM scored GROUP BY 1", "scored"),
    "crop_scan": sql("SELECT recording_id, channel, idx, v FROM samples WHERE idx BETWEEN 100 AND 299", "samples"),
    "embedding_reader": "SELECT vec_id, label AS y, " + ", ".join(
        f"{rs(f'CAST(embedding[{i + 1}] AS DOUBLE)')} AS f{i}" for i in range(64)) + " FROM embeddings",
}
