"""Recording catalogue and patient index from file names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewright import constants as C
from tracewright.functions.text import patient_id, patient_number


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """file_name, path, size of the matching files; contents are not read."""
    found = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", "true").load(folder))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "path",
                        F.col("length").alias("size"))


def recording_catalogue(files: DataFrame, exclude: int = C.EXCLUDED_PATIENT_NUMBER) -> DataFrame:
    """Files with an upper-case patient number, without the excluded patient."""
    number = patient_number(F.col("file_name"))
    return files.withColumn("patient", number).filter(number.isNotNull() & (number != exclude))


def patient_index(files: DataFrame) -> DataFrame:
    """file_name with patient_id (any letter case, upper-cased), one row per file. A
    patient's files stay rows: a patient may own most of them."""
    return files.withColumn("patient_id", patient_id(F.col("file_name"))).filter(F.col("patient_id").isNotNull())


def files_per_patient(files: DataFrame) -> DataFrame:
    """patient_id, n_files, first_file, last_file (in sorted order)."""
    return patient_index(files).groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("n_files"), F.min("file_name").alias("first_file"),
        F.max("file_name").alias("last_file"))


def unparsed_files(files: DataFrame) -> DataFrame:
    """Files without a patient id, as rejects."""
    return (files.filter(patient_id(F.col("file_name")).isNull())
            .select("file_name", F.lit("no patient id").alias("reason")))


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """The same rows; raises at once when there are none."""
    if df.isEmpty():
        raise ValueError(message)
    return df
