"""Files by path or URL: local, in a store that pyarrow knows, over http(s), or an open file-like object."""

from __future__ import annotations

import os
import uuid
from typing import Any


def is_http(path: str) -> bool:
    return path.lower().startswith(("http://", "https://"))


def filesystem(path: str):
    """A pyarrow file system and the path within it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


class HttpFile:
    """A file over http(s), read by ranges."""

    def __init__(self, url: str) -> None:
        self.url = url

    def read_at(self, n: int, at: int) -> bytes:
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        if n <= 0:
            return b""
        try:
            with urlopen(Request(self.url, headers={"Range": f"bytes={at}-{at + n - 1}"}), timeout=60) as answer:
                if answer.status == 206:
                    return answer.read(n)
                answer.read(at)  # a server without ranges sends all of it
                return answer.read(n)
        except HTTPError as e:
            if e.code == 416:  # the range begins beyond the end
                return b""
            raise OSError(f"{self.url}: {e}") from e

    def __enter__(self) -> HttpFile:
        return self

    def __exit__(self, *_: Any) -> None:
        pass


class ObjectFile:
    """An open binary file-like object that can seek; it stays open."""

    def __init__(self, file: Any) -> None:
        self.file = file

    def read_at(self, n: int, at: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    __enter__, __exit__ = HttpFile.__enter__, HttpFile.__exit__


def open_file(path: str | Any):
    """Something with read_at(n, at) to use in a with statement."""
    if hasattr(path, "seek") and hasattr(path, "read"):
        return ObjectFile(path)
    if is_http(path):
        return HttpFile(path)
    system, inner = filesystem(path)
    return system.open_input_file(inner)


def write_whole(path: str, data: bytes) -> None:
    """A file that is there complete or not at all; a task that runs again replaces it by the same."""
    system, inner = filesystem(path)
    system.create_dir(os.path.dirname(inner), recursive=True)
    half = f"{inner}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(half) as f:
        f.write(data)
    system.move(half, inner)


def is_writable(path: str) -> bool:
    """Whether tasks can write files there: a local path, or a store that pyarrow knows."""
    try:
        filesystem(path)
    except Exception:  # noqa: BLE001 - pyarrow raises several kinds for schemes and libraries that it lacks
        return False
    return not is_http(path)
