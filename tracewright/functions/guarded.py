"""Batch functions that fail for single rows and not for the whole batch."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa


def attempt(work: Callable[..., pa.Array], columns: list[pa.Array], kind: pa.DataType) -> list[tuple[pa.Array, str | None]]:
    """Results of ``work`` on a batch, in pieces: (values, None), or (one null, the message) for a row that raises. A batch that
    raises is halved until the rows that do so are alone; a batch without errors is one call."""
    n = len(columns[0])
    try:
        return [(work(*columns), None)]
    except Exception as e:                       # whatever one item raises must not stop the others
        if n <= 1:
            return [(pa.nulls(n, kind), f"{type(e).__name__}: {e}")]
        half = n // 2
        return (attempt(work, [c.slice(0, half) for c in columns], kind)
                + attempt(work, [c.slice(half) for c in columns], kind))


def value_or_error(work: Callable[..., pa.Array], columns: list[pa.Array], kind: pa.DataType) -> pa.Array:
    """A struct (value, error) for every row."""
    parts = attempt(work, columns, kind)
    values = pa.concat_arrays([v.cast(kind) for v, _ in parts])
    errors = pa.concat_arrays([pa.array([e] * len(v), pa.string()) for v, e in parts])
    return pa.StructArray.from_arrays([values, errors], names=["value", "error"])
