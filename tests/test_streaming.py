"""New window files are processed once."""

import numpy as np

from tracewright.operators.features import window_features
from tracewright.streaming.incremental import extract_new_windows

SCHEMA = "window_id bigint, channel string, x array<double>"


def test_each_file_once(spark, tmp_path):
    rng = np.random.default_rng(0)
    src, out, state = (str(tmp_path / n) for n in ("windows", "features", "state"))
    frames = [spark.createDataFrame([(i, "C0", rng.normal(size=80).tolist()) for i in ids], SCHEMA) for ids in (range(3), range(3, 8))]
    for k, df in enumerate(frames):
        df.write.mode("append").parquet(src)
        for _ in range(2):                       # the second call finds nothing new
            extract_new_windows(spark, src, df.schema, out, state, 80.0)
        got = spark.read.parquet(out)
        assert got.count() == (3, 8)[k]
    want = window_features(frames[0].unionByName(frames[1]), 80.0)
    assert sorted(map(tuple, spark.read.parquet(out).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
