"""Random access to files wherever Arrow's file systems reach (local paths, hdfs://, s3://, ...)."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyarrow import fs

#: Bytes of a container's rows that are read and decoded at once.
BATCH = 4 << 20


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


@contextmanager
def opened(path: str) -> Iterator:
    system, inner = resolve(path)
    with system.open_input_file(inner) as f:
        yield f


def size(path: str) -> int:
    system, inner = resolve(path)
    return system.get_file_info(inner).size


def listed(path: str, ending: str) -> list[str]:
    """A file itself, or a folder's files of that ending, sorted."""
    system, inner = resolve(path)
    if system.get_file_info(inner).type == fs.FileType.File:
        return [path]
    prefix = path[: path.index("://") + 3] if "://" in path else ""
    return sorted(prefix + i.path for i in system.get_file_info(fs.FileSelector(inner)) if i.path.endswith(ending))


def refuse_existing(path: str, overwrite: bool) -> None:
    system, inner = resolve(path)
    if not overwrite and system.get_file_info(inner).type != fs.FileType.NotFound:
        raise FileExistsError(path)


def binary_rows(raw: bytes, n: int) -> pa.Array:
    """Bytes as a column of n equal parts, without a copy per part."""
    ends = np.arange(n + 1, dtype="<i4") * (len(raw) // n)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(raw)])


def listed_rows(values: np.ndarray) -> pa.ListArray:
    """A matrix as a column of lists, without a Python value per number."""
    flat = np.ascontiguousarray(values, np.float32)
    return pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1], pa.array(flat.ravel()))
