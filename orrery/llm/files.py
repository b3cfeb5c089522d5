"""Files that executors write and read in shared storage, through pyarrow's file systems."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs


def target(folder: str, suffix: str) -> str:
    """A path that no other attempt of any task uses: a lost or speculative attempt leaves only an unlisted file."""
    return f"{folder}/{uuid.uuid4().hex}{suffix}"


def create(path: str) -> pa.NativeFile:
    system, inner = fs.FileSystem.from_uri(path)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    return system.open_output_stream(inner, compression=None)


def opened(path: str) -> pa.NativeFile:
    system, inner = fs.FileSystem.from_uri(path)
    return pa.memory_map(inner) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(inner)


def mapped(path: str, kind: str) -> np.ndarray:
    """A whole file as an array; memory-mapped where the store is a mounted one."""
    with opened(path) as file:
        return np.frombuffer(file.read_buffer(file.size()), kind)
