"""Small binary files in the folder that all executors share, on any file system that Arrow can open."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write(uri: str, data: bytes) -> None:
    """Writes a file as a whole: it stands under another name until it is complete."""
    system, path = _open(uri)
    folder, name = os.path.split(path)
    system.create_dir(folder, recursive=True)
    partial = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(partial) as out:
        out.write(data)
    system.move(partial, path)


def read(uri: str) -> np.ndarray:
    """The bytes of a file: mapped into memory where it is local or mounted, else read."""
    system, path = _open(uri)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
    with system.open_input_file(path) as file:
        return np.frombuffer(file.read(), np.uint8)


def stream(uri: str) -> pa.NativeFile:
    """A file to be read from its beginning."""
    system, path = _open(uri)
    return system.open_input_file(path)
