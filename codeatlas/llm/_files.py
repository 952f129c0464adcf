"""Files that tasks write and read themselves, on any file system that pyarrow knows."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


class AtomicFile:
    """A file that appears under its name when it is whole. A task that is run again replaces it with the same bytes."""

    def __init__(self, uri: str):
        self.fs, self.path = file_system(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.part, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)

    def abort(self) -> None:
        self.out.close()
        self.fs.delete_file(self.part)


def open_input(uri: str):
    fs, path = file_system(uri)
    return fs.open_input_file(path)
