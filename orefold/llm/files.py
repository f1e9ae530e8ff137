"""Binary files in the shared folder, written and read by tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's address (file, hdfs, s3, gs, ...) and the path in it; tasks call it where they run."""
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class AtomicFile:
    """A file that appears under its name only when complete, so a lost or repeated task leaves no half file."""

    def __init__(self, folder: str, name: str):
        self.store, base = open_store(folder)
        self.store.create_dir(base, recursive=True)
        self.path, self.temporary = f"{base}/{name}", f"{base}/.{name}.{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.temporary)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def commit(self) -> None:
        """Renames the file. Where a repeated task finds the file of an earlier try and the store's rename doesn't overwrite, the old one goes first."""
        self.out.close()
        try:
            self.store.move(self.temporary, self.path)
        except OSError:
            if self.store.get_file_info(self.path).type == fs.FileType.NotFound:
                raise
            self.store.delete_file(self.path)
            self.store.move(self.temporary, self.path)

    def abort(self) -> None:
        self.out.close()
        self.store.delete_file(self.temporary)
