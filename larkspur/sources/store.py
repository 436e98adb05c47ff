"""Files of any store that tasks open themselves, where Spark's own sources don't read the format."""

from __future__ import annotations

import pyarrow.fs as pafs


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address, and the path in it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def files(uri: str, suffix: str = "") -> list[str]:
    """Addresses of the files under a folder (or the file itself), in order; hidden ones are left out."""
    fs, path = store(uri)
    root = uri[: len(uri) - len(path)] if uri.endswith(path) else "file://"
    found = [i for i in fs.get_file_info(pafs.FileSelector(path, recursive=True))] if fs.get_file_info(path).type == pafs.FileType.Directory else [fs.get_file_info(path)]
    plain = lambda p: not any(x.startswith((".", "_")) for x in p[len(path) :].split("/"))
    return sorted(root + i.path for i in found if i.type == pafs.FileType.File and i.path.endswith(suffix) and plain(i.path))
