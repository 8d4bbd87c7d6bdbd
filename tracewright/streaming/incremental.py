"""Feature extraction that picks up new window files only.

The batch step reads every window file of a folder once. As a stream over the same
folder Spark remembers which files are done; the operators are stateless per window
and run unchanged. One call handles what is there and stops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

from tracewright.operators.features import window_features


def stream_windows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def extract_new_windows(spark: SparkSession, windows_path: str, schema: StructType, features_path: str,
                        checkpoint: str, fs: Column | float) -> None:
    """Append the features of the files not seen before. ``checkpoint`` is a folder all
    executors reach."""
    features = window_features(stream_windows(spark, windows_path, schema), fs)
    query = (features.writeStream.format("parquet").option("path", features_path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
