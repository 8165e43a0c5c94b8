"""Random access to files by path or URI, on any file system that pyarrow knows."""

from __future__ import annotations

import pyarrow.fs as pafs


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def read_at(path: str, offset: int, size: int) -> bytes:
    fs, name = locate(path)
    with fs.open_input_file(name) as f:
        return f.read_at(size, offset) if size else b""


def size_of(path: str) -> int:
    fs, name = locate(path)
    info = fs.get_file_info(name)
    if info.type != pafs.FileType.File:
        raise FileNotFoundError(path)
    return info.size
