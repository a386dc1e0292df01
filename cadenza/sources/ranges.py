"""Files opened by path in tasks, and read by range: what a decoder asks for, and little more.

Paths are those that Spark lists. They are opened with pyarrow's file systems (local, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import re
from functools import lru_cache
from urllib.parse import quote

#: Bytes fetched at a time.
BLOCK = 4096
#: Schemes that Hadoop has names of its own for.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


def uri_of(path: str) -> str:
    """A path as Spark gives it, as a URI: escaped, with the slashes that Hadoop leaves out."""
    scheme, rest = re.fullmatch(r"(?s)(?:([A-Za-z][A-Za-z0-9+.-]+):)?(.*)", path).groups()
    scheme = _SCHEMES.get(scheme, scheme) or "file"
    rest = rest if rest.startswith("//") else "//" + rest
    return f"{scheme}:{quote(rest, safe='/:@')}"


@lru_cache(maxsize=256)
def _folder(uri: str) -> tuple:
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def folder_of(path: str) -> tuple:
    """File system and name of a folder."""
    return _folder(uri_of(path))


def locate(path: str) -> tuple:
    """File system and name of a path; the file systems of folders are kept."""
    folder, _, name = path.rpartition("/")
    system, base = _folder(uri_of(folder or "/"))
    return system, f"{base.rstrip('/')}/{name}"


def open_path(path: str):
    """A file for reading at any place."""
    system, name = locate(path)
    return system.open_input_file(name)


def read_path(path: str) -> bytes:
    with open_path(path) as f:
        return f.read()


def write_path(path: str, content: bytes) -> None:
    system, name = locate(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    with system.open_output_stream(name, compression=None) as f:
        f.write(content)


class Ranges:
    """A file that can be sliced and searched like bytes. Blocks are fetched when they are asked for, and kept; runs of blocks at once."""

    def __init__(self, source, block: int = BLOCK):
        self._source, self._block, self._size = source, block, source.size()
        self._blocks: dict[int, bytes] = {}
        #: Bytes fetched so far.
        self.fetched = 0

    def __len__(self) -> int:
        return self._size

    def _need(self, first: int, last: int) -> None:
        at = first
        while at <= last:
            if at in self._blocks:
                at += 1
                continue
            end = at
            while end < last and end + 1 not in self._blocks:
                end += 1
            self._source.seek(at * self._block)
            got = self._source.read((end - at + 1) * self._block)
            self.fetched += len(got)
            for i in range(end - at + 1):
                self._blocks[at + i] = got[i * self._block : (i + 1) * self._block]
            at = end + 1

    def __getitem__(self, part: slice) -> bytes:
        start, stop, _ = part.indices(self._size)
        if stop <= start:
            return b""
        first, last = start // self._block, (stop - 1) // self._block
        self._need(first, last)
        whole = b"".join(self._blocks[i] for i in range(first, last + 1))
        return whole[start - first * self._block : stop - first * self._block]

    def find(self, byte: int, start: int = 0) -> int:
        """Place of the first such byte from start on, or -1."""
        while start < self._size:
            end = (start // self._block + 1) * self._block
            at = self[start:end].find(byte)
            if at >= 0:
                return start + at
            start = end
        return -1
