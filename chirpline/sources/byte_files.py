"""Random access to files of any file system that Arrow knows: local, HDFS and object stores."""

from __future__ import annotations

import fnmatch
import posixpath
from dataclasses import dataclass

from pyarrow import fs


@dataclass(frozen=True)
class Listed:
    uri: str
    size: int


def _system(uri: str) -> tuple[fs.FileSystem, str, str]:
    """The file system, the path in it, and what stands before the path."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), posixpath.abspath(uri), ""
    system, path = fs.FileSystem.from_uri(uri)
    return system, path, uri[: uri.index(path)] if path in uri else ""


def listed(pattern: str) -> list[Listed]:
    """Files of a folder, or those that match a pattern (``*`` and ``?`` in its last parts), by name."""
    parts = pattern.split("/")
    fixed = next((k for k, p in enumerate(parts) if any(c in p for c in "*?[")), len(parts))
    system, path, before = _system("/".join(parts[:fixed]) or "/")
    wanted = posixpath.join(path, *parts[fixed:])
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        found = [info]
    elif info.type == fs.FileType.NotFound:
        found = []
    else:
        deep = len(parts) - fixed > 1
        found = [f for f in system.get_file_info(fs.FileSelector(path, recursive=deep)) if f.type == fs.FileType.File and (fixed == len(parts) or fnmatch.fnmatchcase(f.path, wanted) and f.path.count("/") == wanted.count("/"))]
    return sorted((Listed(before + f.path, f.size) for f in found if not posixpath.basename(f.path).startswith(("_", "."))), key=lambda f: f.uri)


class Bytes:
    """A file opened for ranges; counts what it reads."""

    def __init__(self, uri: str):
        system, path, _ = _system(uri)
        self.file, self.read_bytes = system.open_input_file(path), 0

    def at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        raw = self.file.read(max(0, size))
        self.read_bytes += len(raw)
        return raw

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()
