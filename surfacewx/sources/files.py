"""Files that tasks read or write themselves, in the shared storage."""

from __future__ import annotations

from urllib.parse import quote

from pyarrow import fs


def storage_uri(path: str) -> str:
    """``path`` as Hadoop writes it, in the form that ``pyarrow.fs`` takes:
    ``s3a://`` and ``s3n://`` are ``s3://``, ``file:/x`` is ``file:///x``, and
    characters that a URI may not hold are escaped."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return path
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme.lower(), scheme.lower())
    if not rest.startswith("//"):
        rest = f"//{rest}"
    return f"{scheme}:{quote(rest, safe='/:@~!$&()*+,;=')}"


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of ``path`` and the path in it."""
    return fs.FileSystem.from_uri(storage_uri(path))
