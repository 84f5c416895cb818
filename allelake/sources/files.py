"""Byte access to genotype files on any file system that Arrow knows."""

from __future__ import annotations

import pyarrow.fs as pafs


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or a local path."""
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.removeprefix("file:")


def open_file(path: str):
    """A seekable input stream."""
    fs, name = locate(path)
    return fs.open_input_file(name)


def exists(path: str) -> bool:
    fs, name = locate(path)
    return fs.get_file_info(name).type != pafs.FileType.NotFound


def read_lines(path: str) -> list[str]:
    """Lines of a small text file."""
    with open_file(path) as f:
        return f.read().decode().splitlines()
