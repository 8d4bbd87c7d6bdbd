"""Flat files of named arrays in the shared folder.

Layout: magic, length of the header, JSON header (name -> dtype, length, offset), then
the arrays, each aligned to 64 bytes. A file is written under a fresh name and renamed, so
a task that is run again never leaves half a file under the final name.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyarrow import fs

_MAGIC = b"TWARR001"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def make_folder(uri: str) -> None:
    system, path = _open(uri)
    system.create_dir(path, recursive=True)


def _blocks(arrays: dict[str, np.ndarray]) -> list[bytes | memoryview]:
    entries, at, blocks = {}, 0, []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        entries[name] = [a.dtype.str, len(a), at]
        blocks += [memoryview(a).cast("B") if a.nbytes else b"", b"\0" * (-a.nbytes % 64)]
        at += -(-a.nbytes // 64) * 64
    header = json.dumps(entries).encode()
    header += b" " * (-(len(header) + 16) % 64)
    return [_MAGIC + len(header).to_bytes(8, "little") + header, *blocks]


def _parse(raw: np.ndarray, name: str) -> dict[str, np.ndarray]:
    if raw[:8].tobytes() != _MAGIC:
        raise ValueError(f"not an array file: {name}")
    base = 16 + int.from_bytes(raw[8:16].tobytes(), "little")
    out = {}
    for key, (dtype, n, at) in json.loads(raw[16:base].tobytes()).items():
        out[key] = raw[base + at:base + at + n * np.dtype(dtype).itemsize].view(dtype)
    return out


def to_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    return b"".join(_blocks(arrays))


def from_bytes(raw: bytes) -> dict[str, np.ndarray]:
    return _parse(np.frombuffer(raw, np.uint8), "bytes")


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> int:
    """Write the file; returns its size in bytes."""
    blocks = _blocks(arrays)
    system, path = _open(uri)
    part = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        for block in blocks:
            out.write(block)
    system.move(part, path)
    return sum(len(b) for b in blocks)


def read_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays, memory-mapped where the folder is mounted, else read once."""
    system, path = _open(uri)
    if isinstance(system, fs.LocalFileSystem):
        return _parse(np.memmap(path, np.uint8, "r"), uri)
    with system.open_input_file(path) as f:
        return _parse(np.frombuffer(f.read(), np.uint8), uri)


def delete(uri: str) -> None:
    system, path = _open(uri)
    system.delete_file(path)


def group(arrays: dict[str, np.ndarray], prefix: str) -> dict[str, np.ndarray]:
    """The arrays named ``prefix/...`` without their prefix."""
    return {k[len(prefix) + 1:]: v for k, v in arrays.items() if k.startswith(prefix + "/")}


def prefixed(arrays: dict[str, np.ndarray], prefix: str) -> dict[str, np.ndarray]:
    return {f"{prefix}/{k}": v for k, v in arrays.items()}
