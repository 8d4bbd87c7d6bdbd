"""The given tables read as recordings, annotations, windows and scored rows.

Each view exists twice: as a DataFrame and as the SQL common table expression the
oracle uses. Both derive from whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PATIENTS = ["P20", "P28", "P36", "P48", "P49", "P54", "P55", "P58", "P70", "P73"]
FS = 64.0            # rate of the embedding windows
CHUNK = 64           # samples per chunk row
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(x: Column | str, digits: int = 6) -> Column:
    return F.round(x, digits) + F.lit(0.0)


def rs(sql: str, digits: int = 6) -> str:
    return f"(round({sql}, {digits}) + 0.0)"


def patient(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in PATIENTS]), (number % 10 + 1).cast("int"))


def patient_sql(number: str) -> str:
    names = ", ".join(f"'{p}'" for p in PATIENTS)
    return f"list_extract([{names}], ({number}) % 10 + 1)"


def idiv(a: str, b: int) -> Column:
    return F.expr(f"{a} div {b}")


# --- annotations and recordings from events ---------------------------------

def annotations(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    kind, m = F.col("event_type"), F.col("event_id") % 4
    text = (F.when(kind == "signup", "Note : PD_START").when(kind == "error", "PD_STOP ")
            .when(kind == "click", "NON_PD_START").when(kind == "view", "Note : NON_PD_STOP")
            .when(m == 0, "*").when(m == 1, "-").when(m == 2, "Note : * ").otherwise("Note : - "))
    since = F.col("ts").cast("timestamp_ntz") - F.lit("2024-01-01").cast("timestamp_ntz")     # no time zone involved
    part = lambda unit: F.extract(F.lit(unit), since)
    seconds = ((part("DAY") * 24 + part("HOUR")) * 60 + part("MINUTE")) * 60
    onset = (seconds.cast("bigint") * 1_000_000 + (part("SECOND") * 1_000_000).cast("bigint")) / F.lit(1e6)
    return e.select(F.col("user_id").alias("recording_id"), F.col("event_id").alias("ord"),
                    onset.alias("onset_sec"), text.alias("description"))


def recordings(spark: SparkSession, sf: str) -> DataFrame:
    ends = annotations(spark, sf).groupBy("recording_id").agg(F.max("onset_sec").alias("rec_end_sec"))
    rate = F.when(F.col("recording_id") % 2 == 0, 2.0).otherwise(0.5)
    return ends.select("recording_id", rate.alias("sfreq"), "rec_end_sec",
                       F.floor(F.col("rec_end_sec") * rate).cast("bigint").alias("n_samples"))


CTES: dict[str, str] = {}

CTES["annotations"] = """
SELECT user_id AS recording_id, event_id AS ord,
       epoch_us(ts - TIMESTAMP '2024-01-01') / 1e6 AS onset_sec,
       CASE WHEN event_type = 'signup' THEN 'Note : PD_START' WHEN event_type = 'error' THEN 'PD_STOP '
            WHEN event_type = 'click' THEN 'NON_PD_START' WHEN event_type = 'view' THEN 'Note : NON_PD_STOP'
            WHEN event_id % 4 = 0 THEN '*' WHEN event_id % 4 = 1 THEN '-'
            WHEN event_id % 4 = 2 THEN 'Note : * ' ELSE 'Note : - ' END AS description
FROM events"""

CTES["recordings"] = """
SELECT recording_id, sfreq, rec_end_sec, CAST(floor(rec_end_sec * sfreq) AS BIGINT) AS n_samples
FROM (SELECT recording_id, CASE WHEN recording_id % 2 = 0 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS sfreq,
             max(onset_sec) AS rec_end_sec FROM annotations GROUP BY 1)"""

CTES["notes"] = """
SELECT *, trim(regexp_replace(description, '^Note : ', '')) AS d FROM annotations"""

CTES["segments"] = """
SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY onset_sec, ord) - 1 AS segment_id,
       p_onset AS seg_start, onset_sec AS seg_stop, regexp_replace(d, '_STOP$', '') AS seg_type
FROM (SELECT *, lag(d) OVER w AS p_d, lag(onset_sec) OVER w AS p_onset FROM notes
      WHERE d IN ('PD_START', 'PD_STOP', 'NON_PD_START', 'NON_PD_STOP')
      WINDOW w AS (PARTITION BY recording_id ORDER BY onset_sec, ord))
WHERE (d = 'PD_STOP' AND p_d = 'PD_START') OR (d = 'NON_PD_STOP' AND p_d = 'NON_PD_START')"""

CTES["marks"] = "SELECT recording_id, onset_sec AS mark_sec FROM notes WHERE d = '*'"

# windows of 2 h every half hour at 1 Hz
WINDOW_SEC, STRIDE_SEC, RATE = 7200.0, 1800.0, 1.0

CTES["sliding"] = """
SELECT s.*, o.s, seg_start + o.s / 1.0::DOUBLE AS onset_sec
FROM (SELECT *, CAST(round_even(seg_stop - seg_start, 0) AS BIGINT) AS n FROM segments) s,
     LATERAL (SELECT unnest(generate_series(0::BIGINT, n - 7200, 1800)) AS s) o
WHERE n >= 7200"""

CTES["labelled"] = """
SELECT recording_id, segment_id, seg_start, seg_stop, seg_type, s, onset_sec,
       CAST(EXISTS (SELECT 1 FROM marks m WHERE m.recording_id = w.recording_id
                    AND m.mark_sec >= w.onset_sec AND m.mark_sec <= w.onset_sec + 7200.0::DOUBLE) AS INTEGER) AS label
FROM sliding w"""


# --- windows and samples from embeddings ------------------------------------

def windows(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(idiv("vec_id", 8).alias("window_id"),
                    F.concat(F.lit("C"), F.col("vec_id") % 8).alias("channel"),
                    F.col("embedding").cast("array<double>").alias("x"))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Eight channels of ten chunks per recording. The last recording may be shorter, with channels
    that end at different chunks."""
    return table(spark, sf, "embeddings").select(
        idiv("vec_id", 80).alias("recording_id"), F.concat(F.lit("C"), F.col("vec_id") % 8).alias("channel"),
        F.expr("(vec_id div 8) % 10").alias("chunk"), F.col("embedding").cast("array<double>").alias("x"))


def embedding_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_idx"), patient(F.col("vec_id")).alias("patient_id"),
        F.concat(patient(F.col("vec_id")), F.lit("_rec"), F.expr("(vec_id div 10) % 2")).alias("source"),
        F.col("embedding").alias("emb"), (F.col("label") == 0).cast("int").alias("y"))


CTES["samples"] = """
SELECT vec_id // 80 AS recording_id, 'C' || (vec_id % 8) AS channel,
       ((vec_id // 8) % 10) * 64 + (t.i - 1) AS idx, CAST(embedding[t.i] AS DOUBLE) AS v
FROM embeddings, range(1, 65) t(i)"""

CTES["wx"] = """
SELECT vec_id // 8 AS window_id, 'C' || (vec_id % 8) AS channel, t.i AS i,
       CAST(embedding[t.i] AS DOUBLE) - avg(CAST(embedding[t.i] AS DOUBLE)) OVER (PARTITION BY vec_id) AS v
FROM embeddings, range(1, 65) t(i)"""

CTES["wpsd"] = """
SELECT window_id, channel, k, CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END
       * (pow(sum(h * v * cos(2 * pi() * k * (i - 1) / 64)), 2) + pow(sum(h * v * sin(2 * pi() * k * (i - 1) / 64)), 2))
       / (64.0 * sum(h * h)) AS p
FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * (i - 1) / 64) AS h FROM wx), range(0, 33) b(k)
GROUP BY window_id, channel, k"""

CTES["wtime"] = """
SELECT window_id, channel,
       CAST(count(*) FILTER (v * nxt < 0) AS DOUBLE) AS zero_cross,
       CAST(count(*) FILTER (v - prv > 0 AND nxt - v < 0) AS DOUBLE) AS maxima,
       CAST(count(*) FILTER (v - prv < 0 AND nxt - v > 0) AS DOUBLE) AS minima,
       sqrt(avg(v * v)) AS rms,
       sqrt(64.0 * 63.0) / 62.0 * avg(v * v * v) / pow(avg(v * v), 1.5) AS skew,
       63.0 / (62.0 * 61.0) * (65.0 * (avg(v * v * v * v) / pow(avg(v * v), 2) - 3.0) + 6.0) AS kurt_excess
FROM (SELECT *, lag(v) OVER w AS prv, lead(v) OVER w AS nxt FROM wx
      WINDOW w AS (PARTITION BY window_id, channel ORDER BY i))
GROUP BY window_id, channel"""


def _area(low: int, high: int) -> str:
    inside = f"sum(p) FILTER (k BETWEEN {low} AND {high})"
    return f"({inside} - sum(p) FILTER (k IN ({low}, {high})) / 2)"


_BANDS = {"delta": (1, 3), "theta": (4, 8), "alpha": (9, 13), "beta": (14, 20)}

CTES["wspec"] = "SELECT window_id, channel, " + ", ".join(
    [f"{_area(1, 32)} AS total_power_1_40",
     "CAST(arg_max(k, struct_pack(p := p, b := -k)) FILTER (k BETWEEN 1 AND 32) AS DOUBLE) AS peak_freq_1_40"]
    + [f"avg(p) FILTER (k BETWEEN {a} AND {b}) AS mean_band_{n}" for n, (a, b) in _BANDS.items()]
    + [f"{_area(a, b)} / ({_area(1, 32)} + 1e-12) AS norm_band_{n}" for n, (a, b) in _BANDS.items()]
) + " FROM wpsd GROUP BY window_id, channel"

CTES["wfeat"] = "SELECT * FROM wtime JOIN wspec USING (window_id, channel)"


# --- feature rows from lineitem, scored rows from labels --------------------

def line_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Feature rows of ten patients in three datasets."""
    pid = patient(F.col("l_suppkey"))
    dataset = F.when(pid != "P58", "TRAIN").otherwise(F.concat(F.lit("P58_"), "l_linestatus"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", pid.alias("patient_id"), dataset.alias("dataset"), *LINE_FEATURES,
        (F.col("l_returnflag") == "R").cast("int").alias("y"))


CTES["line_rows"] = f"""
SELECT *, CASE WHEN patient_id <> 'P58' THEN 'TRAIN' ELSE 'P58_' || l_linestatus END AS dataset
FROM (SELECT l_orderkey, l_linenumber, l_linestatus, {patient_sql('l_suppkey')} AS patient_id,
             {', '.join(LINE_FEATURES)}, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem)"""

CTES["line_long"] = """
SELECT dataset, feature, value, y FROM (SELECT dataset, y, l_quantity, l_extendedprice, l_discount, l_tax FROM line_rows)
UNPIVOT (value FOR feature IN (l_quantity, l_extendedprice, l_discount, l_tax))"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf, "labels").select(
        d.alias("row_idx"), patient(d).alias("fold"), patient(d).alias("patient_id"), F.col("quality").alias("y"),
        (d * 7919 % 1000 / F.lit(1000.0)).alias("proba"), (d * 104729 % 997 / F.lit(997.0)).alias("proba2"),
        (d * 37.125 + 0.4996).alias("center_sec"),
        F.concat(patient(d), F.lit("_rec"), F.expr("(doc_id div 10) % 4")).alias("source"))


CTES["scored"] = f"""
SELECT doc_id AS row_idx, {patient_sql('doc_id')} AS fold, {patient_sql('doc_id')} AS patient_id, quality AS y,
       (doc_id * 7919 % 1000) / 1000.0::DOUBLE AS proba, (doc_id * 104729 % 997) / 997.0::DOUBLE AS proba2,
       doc_id * 37.125::DOUBLE + 0.4996::DOUBLE AS center_sec,
       {patient_sql('doc_id')} || '_rec' || ((doc_id // 10) % 4) AS source
FROM labels"""

DEPENDS = {"recordings": ["annotations"], "notes": ["annotations"], "segments": ["notes"], "marks": ["notes"],
           "sliding": ["segments"], "labelled": ["sliding", "marks"], "wpsd": ["wx"], "wtime": ["wx"],
           "wspec": ["wpsd"], "wfeat": ["wtime", "wspec"], "line_long": ["line_rows"]}


def sql(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``body`` with the named views, and what they depend on, in front."""
    order: list[str] = []

    def need(name: str) -> None:
        for d in DEPENDS.get(name, []):
            need(d)
        if name not in order:
            order.append(name)
    for n in names:
        need(n)
    parts = [f"{n} AS ({CTES[n].strip()})" for n in order] + [f"{n} AS ({t.strip()})" for n, t in (extra or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body.strip()
