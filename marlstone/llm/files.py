"""Binary files in a folder that the driver and all executors share.

Spark has no sink for formats of one's own, so tasks write whole files with
pyarrow's file systems (local and network mounts, HDFS, S3, GCS by the URI's
scheme). A file gets its final name only when it is complete, and its
name depends on the task's partition alone, so a task that runs again, here
or on another executor, puts the same bytes in the same place.
"""

from __future__ import annotations

import uuid
from typing import BinaryIO

from pyarrow import fs


def write(folder: str, name: str, content: bytes) -> str:
    """Write one file; returns its URI."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part, compression=None) as out:
        out.write(content)
    system.move(part, f"{path}/{name}")
    return f"{folder}/{name}"


def read(uri: str) -> bytes:
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_stream(path, compression=None) as f:
        return f.read()


def stream(uri: str) -> BinaryIO:
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_stream(path, compression=None)
