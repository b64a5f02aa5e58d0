"""Files of captures and containers on any file system that Arrow knows: local and mounted ones, HDFS, S3, GCS.

Paths are as Spark has them, with or without a scheme.  What ends in .gz,
.bz2, .zst or .lz4 is unpacked while it is read.
"""

from __future__ import annotations

import fnmatch
import posixpath
import uuid

from pyarrow import fs


def resolved(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and what the path is called there."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), posixpath.abspath(path)


def listed(options: dict) -> list[str]:
    """The files of ``path`` (or ``paths``, one in a line): files, folders or patterns, without hidden ones and markers."""
    out = []
    for given in options.get("paths", options.get("path", "")).splitlines():
        system, path = resolved(given)
        scheme = given.partition("://")[0] + "://" if "://" in given and not given.startswith("file:") else ""
        folder, pattern = (path, "*") if system.get_file_info(path).type == fs.FileType.Directory else posixpath.split(path)
        if pattern == "*" or any(c in pattern for c in "*?["):
            found = sorted(i.path for i in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, pattern))
        else:
            found = [path]
        out += [f"{scheme}{p}" for p in found if not posixpath.basename(p).startswith((".", "_")) and not p.endswith(".done")]
    return out


def opened(path: str):
    """A file to read from, unpacked if its name says that it is packed."""
    system, path = resolved(path)
    return system.open_input_stream(path, compression="detect", buffer_size=1 << 20)


class Output:
    """A folder that a job writes files to: they are put aside, and come to their place, with names, when the job is committed."""

    def __init__(self, path: str, overwrite: bool, suffix: str, done: bool = False):
        self.path, self.overwrite, self.suffix, self.done = path, overwrite, suffix, done
        self.aside = f"_temporary-{uuid.uuid4().hex}"

    def new(self):
        """A file to write to, and its name; every attempt of a task has its own."""
        system, folder = resolved(self.path)
        name = f"{uuid.uuid4().hex}{self.suffix}"
        system.create_dir(f"{folder}/{self.aside}")
        return system.open_output_stream(f"{folder}/{self.aside}/{name}", compression="detect", buffer_size=1 << 20), name

    def commit(self, names: list[str]) -> None:
        system, folder = resolved(self.path)
        system.create_dir(f"{folder}/{self.aside}")
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(folder)):
                if info.type == fs.FileType.File:
                    system.delete_file(info.path)
        for k, name in enumerate(sorted(names)):
            final = f"{folder}/part-{k:05d}-{name}"
            system.move(f"{folder}/{self.aside}/{name}", final)
            if self.done:
                system.open_output_stream(f"{final}.done").close()
        self.abort()
        system.open_output_stream(f"{folder}/_SUCCESS").close()

    def abort(self) -> None:
        """What was put aside goes, also what failed attempts left."""
        system, folder = resolved(self.path)
        if system.get_file_info(f"{folder}/{self.aside}").type == fs.FileType.Directory:
            system.delete_dir(f"{folder}/{self.aside}")
