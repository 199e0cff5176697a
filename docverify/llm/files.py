"""Files in the shared folder, by whatever store its address names."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(address: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(address if "://" in address or address.startswith("file:") else f"file://{address}")


def write_once(folder: str, name: str, data_parts) -> int:
    """Write the parts to folder/name by way of a name of this attempt's own; returns the bytes written.

    A second attempt of a task replaces the file by one with the same content.
    """
    store, base = opened(folder)
    store.create_dir(base, recursive=True)
    scratch, size = f"{base}/.{name}.{uuid.uuid4().hex}", 0
    with store.open_output_stream(scratch, compression=None) as out:
        for part in data_parts:
            out.write(part)
            size += len(part)
    store.move(scratch, f"{base}/{name}")
    return size


def read_stream(folder: str, name: str):
    store, base = opened(folder)
    return store.open_input_stream(f"{base}/{name}", compression=None)
