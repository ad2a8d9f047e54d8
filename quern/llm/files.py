"""Files in the shared folder, as tasks see them: any file system that pyarrow knows by the folder's URI."""

from __future__ import annotations

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or absolute path, and the path in it."""
    return fs.FileSystem.from_uri(uri)
