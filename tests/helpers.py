"""Small helpers shared by the tests."""

import numpy as np

ANNOTATIONS = "recording_id bigint, ord bigint, onset_sec double, description string"
CHUNKS = "recording_id bigint, channel string, chunk bigint, x array<double>"


def chunk_rows(spark, signals, chunk_len):
    """{(recording, channel): array} to chunk rows."""
    rows = [(r, c, i // chunk_len, x[i:i + chunk_len].tolist())
            for (r, c), x in signals.items() for i in range(0, len(x), chunk_len)]
    return spark.createDataFrame(rows, CHUNKS)


def joined(df, keys=("recording_id", "channel")):
    """Chunk rows back to {keys: array}."""
    out = {}
    for row in df.orderBy(*keys, "chunk").collect():
        out.setdefault(tuple(row[k] for k in keys), []).extend(row["x"])
    return {k: np.array(v) for k, v in out.items()}


def random_signals(seed, recordings, channels, n):
    rng = np.random.default_rng(seed)
    return {(r, f"C{c}"): rng.normal(size=n) for r in range(recordings) for c in range(channels)}
