"""Binary files in the shared folder, written and read inside tasks.

Spark has no writer of plain binary files, so tasks use Arrow's file systems on the folder's URI. A file appears under
its name only when it is complete. A task that runs again writes the same file again or, where the order of its rows may
differ, one of another name; only files that a committed row names are read.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyarrow import fs


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it; ``file:/x`` and plain paths are local or mounted folders."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, write: Callable) -> None:
    """Let ``write(stream)`` fill a file that replaces any of the same name."""
    system, path = located(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    fresh = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(fresh, compression=None) as stream:
        write(stream)
    if not isinstance(system, fs.LocalFileSystem) and system.get_file_info(path).type != fs.FileType.NotFound:
        system.delete_file(path)
    system.move(fresh, path)


@contextmanager
def reading(uri: str):
    """A file open for reads at any place."""
    system, path = located(uri)
    with system.open_input_file(path) as file:
        yield file
