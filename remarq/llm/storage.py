"""Single files in the folders that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa

from ..storage import open_fs


@contextmanager
def new_file(folder: str, name: str) -> Iterator[tuple[pa.NativeFile, str]]:
    """A file for writing that appears under its name once it is complete.

    The name gets a random part, so that a task that runs twice never writes into the file of
    its other attempt; the caller returns the URI of the one that counts.
    """
    files, path = open_fs(folder)
    files.create_dir(path, recursive=True)
    own = f"{uuid.uuid4().hex}-{name}"
    with files.open_output_stream(f"{path}/.{own}.part") as out:
        yield out, f"{folder}/{own}"
    files.move(f"{path}/.{own}.part", f"{path}/{own}")
