import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tracewright.llm import blobfile
from tracewright.llm.elias_fano import EliasFano


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 2 ** 62), max_size=300), st.integers(0, 40))
def test_select_and_search(values, shift):
    v = np.sort(np.array([x >> shift for x in values], np.uint64))
    e = EliasFano(EliasFano.encode(v))
    assert (e.values() == v).all()
    top = int(v[-1]) if len(v) else 0
    x = np.unique(np.concatenate([v, np.minimum(v + np.uint64(1), np.uint64(top)), np.zeros(1, np.uint64)]))
    assert (e.search(x) == np.searchsorted(v, x)).all()
    assert ((e.find(x) >= 0) == np.isin(x, v)).all()


def test_search_among_many_equal_high_parts():
    v = np.sort(np.concatenate([np.arange(0, 600, 2), np.full(200, 1001), [0, 1 << 20]])).astype(np.uint64)
    e = EliasFano(EliasFano.encode(v, 1 << 21))
    x = np.arange(0, 1100, dtype=np.uint64)
    assert (e.search(x) == np.searchsorted(v, x)).all()
    assert (e.find(x) == np.where(np.isin(x, v), np.searchsorted(v, x), -1)).all()


def test_space_is_near_the_bound():
    n, u = 200_000, 1 << 40
    v = np.sort(np.random.default_rng(0).integers(0, u, n, dtype=np.uint64))
    bits = 8 * EliasFano(EliasFano.encode(v, u)).nbytes / n
    assert bits < 2 + np.log2(u / n) + 1.2


def test_refuses_wrong_input():
    with pytest.raises(ValueError):
        EliasFano.encode(np.array([3, 2]))
    with pytest.raises(ValueError):
        EliasFano.encode(np.array([3]), 3)


def test_files(tmp_path):
    arrays = {"a": np.arange(7, dtype="<u2"), "b/c": np.zeros(0), "d": np.array([2 ** 60])}
    for path in (str(tmp_path / "x"), f"file://{tmp_path}/y"):
        blobfile.write_arrays(path, arrays)
        back = blobfile.read_arrays(path)
        assert back.keys() == arrays.keys() and all((back[k] == arrays[k]).all() for k in arrays)
    back = blobfile.from_bytes(blobfile.to_bytes(arrays))
    assert (back["a"] == arrays["a"]).all()
    (tmp_path / "z").write_bytes(b"something else and longer")
    with pytest.raises(ValueError):
        blobfile.read_arrays(str(tmp_path / "z"))
