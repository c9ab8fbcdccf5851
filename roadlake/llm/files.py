"""Binary files in the folder that driver and executors share."""

from __future__ import annotations

import re

from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI, for Python tasks. Hadoop writes ``file:/x`` for ``file:///x``."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def write(uri: str, data: bytes) -> None:
    """Write a new file. Names are unique to a task attempt, so a lost attempt leaves a file that no manifest names."""
    system, path = filesystem(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        out.write(data)
