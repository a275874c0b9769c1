"""Arrays in files of the shared folder, memory-mapped by tasks.

A file is written under a temporary name and then renamed, so a task that runs twice
leaves one whole file. A folder that the machine can open is mapped in place; a file
of any other store is copied next to the task first and unlinked once it is mapped.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from itertools import accumulate

import numpy as np
import pyarrow.fs as pafs


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def write_arrays(uri: str, arrays: list[np.ndarray]) -> None:
    """All arrays, one after the other."""
    system, path = _place(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        for a in arrays:
            out.write(np.ascontiguousarray(a).data)
    system.move(part, path)


def map_arrays(uri: str, kinds: list[tuple[str, int]]) -> list[np.ndarray]:
    """The arrays of a file, given the type and length of each."""
    system, path = _place(uri)
    sizes = [np.dtype(k).itemsize * n for k, n in kinds]
    if not sum(sizes):
        return [np.zeros(0, k) for k, _ in kinds]
    copied = None
    if not isinstance(system, pafs.LocalFileSystem):
        handle, copied = tempfile.mkstemp()
        with os.fdopen(handle, "wb") as out, system.open_input_stream(path) as source:
            while block := source.read(1 << 24):
                out.write(block)
    data = np.memmap(copied or path, np.uint8, "r")
    if copied:
        os.unlink(copied)
    starts = [0, *accumulate(sizes)]
    return [data[a : a + s].view(k) for a, s, (k, _) in zip(starts, sizes, kinds, strict=False)]
