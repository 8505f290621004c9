"""Files that tasks write to and read from the shared folder, by whatever file system its URI names."""

from __future__ import annotations

import contextlib

import pyarrow.fs as pafs


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def writing(uri: str):
    system, path = place(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        yield out


def local_path(uri: str) -> str | None:
    """The path of a file that this machine mounts, else None."""
    system, path = place(uri)
    return path if isinstance(system, pafs.LocalFileSystem) else None


def read_bytes(uri: str, start: int = 0, length: int | None = None) -> bytes:
    """A range of a file; a negative start counts from the end."""
    system, path = place(uri)
    with system.open_input_file(path) as f:
        if start < 0:
            start += f.size()
        f.seek(start)
        return f.read(f.size() - start if length is None else length)
