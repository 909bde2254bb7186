"""Files that tasks write and read themselves, on any store that pyarrow knows.

A task writes under a name of its own attempt; the driver-side manifest lists only what successful
attempts wrote, so a lost executor leaves at most a file nobody refers to.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def attempt_path(folder: str, stem: str, suffix: str) -> str:
    return f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"


def create(uri: str):
    store, path = open_fs(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def open_random(uri: str):
    store, path = open_fs(uri)
    return store.open_input_file(path)
