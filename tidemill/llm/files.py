"""Files that tasks write themselves: any file system that ``pyarrow.fs`` reaches, local ones memory-mapped."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.fs as pafs


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


def new_file(folder: str, name: str) -> tuple[str, pa.NativeFile]:
    """Opens a file of a name no other attempt of a task uses, so a retry or a twin never touches it."""
    fs, base = file_system(folder)
    fs.create_dir(base, recursive=True)
    name = f"{name}-{uuid.uuid4().hex}"
    return f"{folder}/{name}", fs.open_output_stream(f"{base}/{name}")


def open_file(path: str) -> pa.NativeFile:
    fs, base = file_system(path)
    return pa.memory_map(base) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(base)
