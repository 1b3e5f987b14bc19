"""Byte files in the shared folder, opened by tasks on any executor."""

from __future__ import annotations

import os
from typing import BinaryIO
from urllib.parse import unquote, urlparse

from pyarrow import fs


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def open_read(uri: str) -> BinaryIO:
    """A seekable file; other schemes than file: go through pyarrow's file systems."""
    path = _local(uri)
    if path is not None:
        return open(path, "rb")
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


class Publish:
    """Write under a name of one's own, then move to the final name: readers see whole files, attempts do not mix."""

    def __init__(self, uri: str, attempt: str):
        self.local = _local(uri)
        self.system, self.path = (None, self.local) if self.local is not None else fs.FileSystem.from_uri(uri)
        folder, name = os.path.split(self.path)
        self.temporary = f"{folder}/.{name}.{attempt}"
        if self.system is None:
            os.makedirs(folder, exist_ok=True)
            self.file = open(self.temporary, "wb")
        else:
            self.system.create_dir(folder, recursive=True)
            self.file = self.system.open_output_stream(self.temporary)

    def write(self, data: bytes) -> None:
        self.file.write(data)

    def commit(self) -> None:
        self.file.close()
        if self.system is None:
            os.replace(self.temporary, self.path)
        else:
            self.system.move(self.temporary, self.path)
