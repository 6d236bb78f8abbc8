"""Files of any store that pyarrow opens: local and mounted paths, file:, hdfs:, s3: (s3a: too), gs:. Opened by executors as well as by the driver."""

from __future__ import annotations

import io
import os
import re
from collections.abc import Iterator

from pyarrow import fs

_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]+:")


def store(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path inside it)."""
    if not _SCHEME.match(path):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


def listed(path: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(name, size) of the files with one of the suffixes: path itself, or all below it, sorted; none if there is no such path. Each name can be opened as path can; names that begin with an underscore are left out."""
    system, inner = store(path)
    info = system.get_file_info(inner)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True)) if info.type == fs.FileType.Directory else []
    # Of a store with a scheme, what stands before the inner path in `path` stands before each name.
    front = "" if isinstance(system, fs.LocalFileSystem) else path[: path.rfind(inner.strip("/"))]
    return sorted((front + (f.path.lstrip("/") if front else f.path), f.size) for f in found if f.type == fs.FileType.File and f.base_name.endswith(suffixes) and not f.base_name.startswith("_"))


def folders(path: str) -> Iterator[str]:
    """Names of the folders right below a path, in no order; a local path's come one by one, those of other stores as one list."""
    system, inner = store(path)
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(inner) as found:
            yield from (f.name for f in found if f.is_dir())
    else:
        yield from (f.base_name for f in system.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.Directory)


class Raw(io.RawIOBase):
    """A seekable file of a store, for io.BufferedReader and zipfile. It counts the bytes that it reads."""

    def __init__(self, path: str) -> None:
        system, inner = store(path)
        self.file = system.open_input_file(inner)
        self.n_read = 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def size(self) -> int:
        return self.file.size()

    def seek(self, at: int, whence: int = 0) -> int:
        place = at + (0, self.file.tell, self.file.size)[whence]() if whence else at
        if place < 0:
            raise OSError("a place before the file's beginning")
        self.file.seek(place)
        return self.file.tell()

    def tell(self) -> int:
        return self.file.tell()

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        self.n_read += len(data)
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self.file.close()
        super().close()
