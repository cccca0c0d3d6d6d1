"""Byte ranges of files, local or in a store that pyarrow opens, or behind HTTP; and footers and page headers read by range."""

from __future__ import annotations

import urllib.request
from collections.abc import Iterator
from pathlib import PurePosixPath

from quern.sources import thrift

#: Fixed value: what a file starts and ends with, and what stands there if the footer is encrypted.
MAGIC, ENCRYPTED_MAGIC = b"PAR1", b"PARE"
#: Bytes of the end of a file that are read at once; most footers fit.
TAIL = 64 << 10
#: Bytes read to find a page's header; doubled where it is longer.
HEADER = 1 << 10
TIMEOUT_S = 60


class StoredFile:
    """A file of a file system that pyarrow knows (local paths and file:, hdfs:, s3:, gs: addresses)."""

    def __init__(self, path: str):
        system, inner = filesystem(path)
        self.file = system.open_input_file(inner)
        self.size = self.file.size()

    def read(self, start: int, length: int) -> bytes:
        return self.file.read_at(max(0, min(length, self.size - start)), start)

    def close(self) -> None:
        self.file.close()


class HttpFile:
    """A file behind HTTP, read by ``Range`` requests; other answers than 206 raise an error."""

    def __init__(self, url: str):
        self.url = url
        _, headers = self._get("bytes=-1")
        self.size = int(headers["Content-Range"].rpartition("/")[2])

    def _get(self, span: str) -> tuple[bytes, dict]:
        request = urllib.request.Request(self.url, headers={"Range": span})
        with urllib.request.urlopen(request, timeout=TIMEOUT_S) as answer:
            if answer.status != 206:
                raise OSError(f"{self.url}: status {answer.status} for a byte range")
            return answer.read(), dict(answer.headers)

    def read(self, start: int, length: int) -> bytes:
        length = max(0, min(length, self.size - start))
        return self._get(f"bytes={start}-{start + length - 1}")[0] if length else b""

    def close(self) -> None:
        pass


class Seekable:
    """A read-only file object over byte ranges, as pyarrow's reader wants it."""

    def __init__(self, source):
        self.source, self.place, self.closed = source, 0, False

    def read(self, n: int = -1) -> bytes:
        data = self.source.read(self.place, self.source.size - self.place if n is None or n < 0 else n)
        self.place += len(data)
        return data

    def seek(self, offset: int, whence: int = 0) -> int:
        self.place = offset + (0, self.place, self.source.size)[whence]
        return self.place

    def tell(self) -> int:
        return self.place

    def size(self) -> int:
        return self.source.size

    def close(self) -> None:
        self.closed = True

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def writable(self) -> bool:
        return False


def is_http(path: str) -> bool:
    return path.startswith(("http://", "https://"))


def filesystem(path: str):
    """(file system, path within it)"""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def opened(path: str):
    return HttpFile(path) if is_http(path) else StoredFile(path)


def listed(path: str) -> list[str]:
    """The data files of a path, sorted: itself, those below a folder (hidden ones left out), or those that a ``*`` at the end of names matches."""
    from pyarrow import fs

    if is_http(path):
        return [path]
    system, inner = filesystem(path)
    prefix = path.removesuffix(inner)
    if "*" in inner:
        above = PurePosixPath(inner.partition("*")[0] + "x").parent
        found = system.get_file_info(fs.FileSelector(str(above), recursive=True))
        return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and PurePosixPath(f.path).match(inner))
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    shown = [f.path for f in found if f.type == fs.FileType.File and f.size and not any(part.startswith(("_", ".")) for part in PurePosixPath(f.path).relative_to(inner).parts)]
    return sorted(prefix + p for p in shown)


def footer(source) -> dict:
    """The file's metadata, by two reads at most; both the magic and the length are checked."""
    tail = source.read(max(0, source.size - TAIL), TAIL)
    if tail[-4:] == ENCRYPTED_MAGIC:
        raise ValueError("the footer is encrypted")
    if source.size < 12 or tail[-4:] != MAGIC:
        raise ValueError("no footer at the end of the file")
    length = int.from_bytes(tail[-8:-4], "little")
    if length > source.size - 12:
        raise ValueError(f"a footer of {length} bytes in a file of {source.size}")
    if length + 8 > len(tail):
        tail = source.read(source.size - 8 - length, length + 8)
    return thrift.Reader(tail, len(tail) - 8 - length).structure(thrift.FILE_META)


def first_page(chunk: dict) -> int:
    """Where a column chunk's pages begin: at its dictionary or its data, whichever is first. Its file_offset doesn't say so, and a chunk without data pages has 0 for them."""
    return min((x for x in (chunk["data_page_offset"], chunk.get("dictionary_page_offset", 0)) if x > 0), default=0)


def pages(source, chunk: dict) -> Iterator[tuple[int, int, dict]]:
    """(offset, header's length, header) of every page of a column chunk; the pages' bodies aren't read."""
    at = first_page(chunk)
    end = at + chunk["total_compressed_size"]
    while at < end:
        size = HEADER
        while True:
            data = source.read(at, min(size, end - at))
            reader = thrift.Reader(data)
            try:
                header = reader.structure(thrift.PAGE_HEADER)
                break
            except thrift.Truncated:
                if size >= end - at:
                    raise
                size *= 2
        yield at, reader.at, header
        at += reader.at + header["compressed_page_size"]


def footer_of(path: str) -> dict:
    """The metadata that the file has now."""
    source = opened(path)
    try:
        return footer(source)
    finally:
        source.close()
