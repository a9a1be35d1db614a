"""Files of the operators' own formats, in the shared folder, opened inside tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def opened(uri: str):
    """A file to read at any place; ``uri`` is a path or has a scheme that pyarrow knows (file, s3, gs, hdfs ...)."""
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


@contextmanager
def new_file(folder: str, name: str) -> Iterator[tuple[str, object]]:
    """``(name, stream)`` of a file that appears under its own name only when it is whole.

    Each attempt of a task writes a file of its own, so that a repeated or a lost attempt spoils
    nothing; the one that a manifest names is the one that counts.
    """
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    name = f"{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(f"{path}/.{name}") as stream:
        yield name, stream
    system.move(f"{path}/.{name}", f"{path}/{name}")
