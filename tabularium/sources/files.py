"""Files of a table in any file system pyarrow knows: discovery, headers, blocks and blobs."""

from __future__ import annotations

import fnmatch
import struct
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow.fs as pafs

from . import layout as L


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and plain path of a URI or local path."""
    return pafs.FileSystem.from_uri(path) if "://" in path else pafs.FileSystem.from_uri("file://" + path) if path.startswith("/") else (pafs.LocalFileSystem(), path)


def companions(directory: str, table: str) -> list[tuple[str, str, str | None, str | None]]:
    """(name, data file, index file or None, blob file or None) of each table whose stem matches the pattern.

    Stems match exactly but for case where the pattern has no wildcard, extensions in any case; both companions are looked up.
    """
    fs, base = opened(directory)
    by_stem: dict[str, dict[str, str]] = {}
    prefix = directory.rstrip("/")
    for info in fs.get_file_info(pafs.FileSelector(base)):
        stem, _, extension = info.base_name.rpartition(".")
        if info.type == pafs.FileType.File and extension.lower() in ("db", "px", "mb"):
            by_stem.setdefault(stem.lower(), {"stem": stem})[extension.lower()] = f"{prefix}/{info.base_name}"
    found = [v for k, v in sorted(by_stem.items()) if "db" in v and fnmatch.fnmatchcase(k, table.lower())]
    if not found:
        raise L.TableError(f"no table {table} in {directory}")
    return [(v["stem"], v["db"], v.get("px"), v.get("mb")) for v in found]


def read_header(path: str) -> L.Header:
    """The header of a file; encrypted files are an error."""
    fs, plain = opened(path)
    with fs.open_input_file(plain) as f:
        header = L.parse(f.read_at(L.header_length(f.read_at(4, 0)), 0))
    if header.encryption:
        raise L.TableError(f"{path} is encrypted")
    return header


def rows_of(header: L.Header, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows in each block, [blocks, most rows, record size] view) of [blocks, block size] bytes."""
    added = np.ascontiguousarray(blocks[:, 4:6]).view("<i2")[:, 0].astype(np.int64)
    n = np.trunc(added / header.record_size).astype(np.int64) + 1
    most = (header.block_size - L.BLOCK_HEAD) // header.record_size
    if (n > most).any() or (n < 0).any():
        raise L.TableError("a block claims more records than it can hold")
    return n, blocks[:, L.BLOCK_HEAD : L.BLOCK_HEAD + most * header.record_size].reshape(len(blocks), most, header.record_size)


def records(path: str, header: L.Header, first: int, last: int, permissive: bool = False, at_once: int = 4 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """([rows, record size] bytes, block numbers, numbers within the block) of blocks first to last - 1, a few MB at a time."""
    fs, plain = opened(path)
    step = max(1, at_once // header.block_size)
    with fs.open_input_file(plain) as f:
        for low in range(first, last, step):
            high = min(last, low + step)
            data = f.read_at((high - low) * header.block_size, header.block_at(low))
            whole = len(data) // header.block_size
            if whole < high - low and not permissive:
                raise L.TableError(f"{path} ends within block {low + whole}")
            n, view = rows_of(header, np.frombuffer(data, np.uint8, whole * header.block_size).reshape(whole, header.block_size))
            inside = np.arange(view.shape[1]) < n[:, None]
            block, rec = np.nonzero(inside)
            yield view[inside], (block + low).astype(np.int32), rec.astype(np.int32)
            if whole < high - low:
                return


def leading_blocks(path: str, header: L.Header, n: int) -> tuple[int, int]:
    """(how many blocks from the start hold the first n records, how many of the n they hold); fewer records are all blocks."""
    found = 0
    if n <= 0:
        return 0, 0
    for _, block, _ in records(path, header, 0, header.file_blocks, permissive=True, at_once=256 << 10):
        if found + len(block) >= n:
            return int(block[n - found - 1]) + 1, n
        found += len(block)
    return header.file_blocks, found


def side_by_side(work: Callable[[Any], Any], items: list[Any]) -> list[Any]:
    """work of each item in order, many at once: for small reads of many files, where waiting is what takes long."""
    if len(items) < 2:
        return [work(x) for x in items]
    with ThreadPoolExecutor(min(32, len(items))) as pool:
        return list(pool.map(work, items))


#: Blobs of at most SMALL bytes that lie no more than GAP apart are read together, READ bytes at most at a time.
SMALL, GAP, READ = 256 << 10, 16 << 10, 4 << 20


class Blobs:
    """The blob file of a table: dereferences ten-byte references. What does not check out is NULL."""

    def __init__(self, path: str) -> None:
        fs, plain = opened(path)
        self.file = fs.open_input_file(plain)

    def _read(self, spans: list[tuple[int, int]]) -> Iterator[bytes]:
        """The bytes of each (place, length), which come in order of their places; neighbours share a read."""
        k = 0
        while k < len(spans):
            first, stop = spans[k][0], k
            end = first
            while stop < len(spans) and spans[stop][0] <= end + GAP and sum(spans[stop]) - first <= READ:
                end = max(end, sum(spans[stop]))
                stop += 1
            data = self.file.read_at(end - first, first)
            for place, length in spans[k:stop]:
                yield data[place - first : place - first + length]
            k = stop

    def __call__(self, references: np.ndarray) -> list[bytes | None]:
        fields = np.ascontiguousarray(references[:, :8]).view("<u4")
        out: list[bytes | None] = [None] * len(references)
        places, sizes = fields[:, 0].astype(np.int64) & 0xFFFFFF00, fields[:, 1].view("<i4").astype(np.int64)
        order = np.argsort(places, kind="stable")  # in file order
        order = order[sizes[order] > 0]
        # A size is believed once the blob's own head repeats it; until then a large one costs a head only.
        spans = [(int(places[k]), 9 + int(sizes[k]) * int(sizes[k] <= SMALL)) for k in order]
        for k, read in zip(order, self._read(spans), strict=True):
            size = int(sizes[k])
            if len(read) >= 9 and struct.unpack_from("<i", read, 3)[0] == size:
                data = read[9:] if size <= SMALL else self.file.read_at(size, int(places[k]) + 9)
                out[k] = data if len(data) == size else None
        return out

    def close(self) -> None:
        self.file.close()


@lru_cache(64)
def cached_header(path: str, _size: int, _time: int) -> L.Header:
    return read_header(path)


def header_of(path: str) -> L.Header:
    """read_header, remembered for as long as the file stays the same."""
    fs, plain = opened(path)
    info = fs.get_file_info(plain)
    return cached_header(path, info.size or 0, info.mtime_ns or 0)
