"""Writes block tables with their index and blob files. TEST-ONLY; shares no code with the reader, so that an error in one shows."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from contextlib import ExitStack
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs

# Fixed values of the format: code of each type name.
CODES = {"Alpha": 1, "Date": 2, "Short": 3, "Long": 4, "Currency": 5, "Number": 6, "Logical": 9, "Memo": 12, "Blob": 13, "FmtMemo": 14, "OLE": 15, "Graphic": 16, "Time": 20, "Timestamp": 21, "AutoInc": 22, "BCD": 23, "Bytes": 24}


#: A file has so many blocks at most, a block so many KiB (what it holds is a signed 16-bit number), a blob file so many bytes.
MOST_BLOCKS, MOST_KIB, MOST_BLOB_BYTES = 65535, 32, 1 << 32


@dataclass
class Column:
    """name, type name, size byte and one value a row (None: NULL), as a sequence or as an Arrow column."""

    name: str
    kind: str
    size: int
    values: Any


def _numbers(values: Any, fill: float = 0) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(values, pa.ChunkedArray):
        return values.fill_null(fill).to_numpy(), values.is_null().to_numpy()
    if isinstance(values, np.ndarray):
        return values, np.zeros(len(values), bool)
    null = np.array([v is None for v in values], bool)
    return np.array([fill if v is None else v for v in values]), null


def _padded(column: Column, width: int) -> np.ndarray:
    """[rows, width] bytes of texts, zeros after each."""
    values = column.values if isinstance(column.values, pa.ChunkedArray) else pa.chunked_array([pa.array(column.values, pa.string())])
    out = np.zeros((len(values), width), np.uint8)
    flat = values.cast(pa.large_binary()).fill_null(b"").combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
    if not len(flat):
        return out
    ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    lengths = np.diff(ends)
    assert lengths.max() <= width, (column.name, lengths.max())
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    out[np.repeat(np.arange(len(flat)), lengths), np.arange(len(data)) - np.repeat(ends[:-1] - ends[0], lengths)] = data
    return out


def encode(column: Column, blobs: bytearray | None = None) -> np.ndarray:
    """[rows, width] bytes of a column."""
    kind, n = column.kind, len(column.values)
    width = 17 if kind == "BCD" else column.size
    out = np.zeros((n, width), np.uint8)
    if kind in ("Short", "Long", "AutoInc", "Date", "Time"):
        values, null = _numbers(column.values)
        bits = 16 if kind == "Short" else 32
        assert not n or (values.min() >= -(1 << bits - 1) and values.max() < 1 << bits - 1)
        out[:] = (values.astype(np.int64) + (1 << bits - 1)).astype(f">u{bits // 8}").view(np.uint8).reshape(n, bits // 8)
        out[null] = 0
    elif kind in ("Number", "Currency", "Timestamp"):
        values, null = _numbers(column.values)
        raw = values.astype(np.float64).astype(">f8").view(np.uint8).reshape(n, 8).copy()
        negative = raw[:, 0] >= 0x80
        raw[negative] ^= 0xFF
        raw[~negative, 0] |= 0x80
        out[:] = raw
        out[null] = 0
    elif kind == "Logical":
        for k, v in enumerate(column.values):
            out[k, 0] = 0 if v is None else 0x81 if v else 0x80
    elif kind == "Alpha":
        out = _padded(column, width)
    elif kind in ("Memo", "Blob"):
        for k, v in enumerate(column.values):
            if v is None:
                continue
            data = v.encode() if isinstance(v, str) else v
            lead = width - 10
            place = 0
            if blobs is not None and kind == "Blob":
                blobs.extend(bytes(-len(blobs) % 256))
                place = len(blobs)
                blobs.extend(struct.pack("<BHiH", 2, (len(data) + 9 + 4095) // 4096 & 0xFFFF, len(data), 1) + data)
            head = data[:lead]
            out[k, : len(head)] = np.frombuffer(head, np.uint8)
            out[k, lead:] = np.frombuffer(struct.pack("<Iih", place | 0xFF, len(data), 1), np.uint8)
    else:  # types without a decoder: any bytes but zeros
        for k, v in enumerate(column.values):
            out[k] = 0 if v is None else 0xA5
    return out


def header(file_type: int, record_size: int, kib: int, blocks: int, rows: int, columns: list[tuple[str, int, int]], table: str, version: int = 0x0C, root: int = 0, levels: int = 0, encryption: int = 0) -> bytes:
    """A header padded to a multiple of 2048 bytes."""
    fixed = bytearray(0x58)
    struct.pack_into("<HHBBi", fixed, 0, record_size, 0, file_type, kib, rows)
    struct.pack_into("<HHHH", fixed, 0x0A, blocks, blocks, 1 if blocks else 0, blocks)
    struct.pack_into("<HBh", fixed, 0x1E, root, levels, len(columns))
    struct.pack_into("<I", fixed, 0x25, encryption)
    fixed[0x39] = version
    out = bytes(fixed)
    if file_type in (0, 2, 3, 5) and version >= 5:
        out += bytes(18) + struct.pack("<H", 1252) + bytes(12)
    out += b"".join(bytes([code, size]) for _, code, size in columns)
    named = file_type in (0, 2)
    out += bytes(4 + 4 * len(columns) * named)
    out += table.encode("ascii")[:78].ljust(261 if version >= 0x0C else 79, b"\0")
    if named:
        out += b"".join(name.encode() + b"\0" for name, _, _ in columns)
    out += bytes(-len(out) % 2048)
    return out[:2] + struct.pack("<H", len(out)) + out[4:]


def per_block(size: int, kib: int) -> int:
    """How many records of a size a block holds."""
    return min((kib * 1024 - 6) // size, 32767 // size)


def fitting_kib(rows: int, size: int, kib: int) -> int:
    """The block size, doubled until a file has room for all rows; more rows than fit the largest blocks are an error."""
    while rows > MOST_BLOCKS * per_block(size, kib):
        if kib >= MOST_KIB:
            raise ValueError(f"{rows} records of {size} bytes are more than one file holds")
        kib = min(MOST_KIB, 2 * kib)
    return kib


def block_bytes(records: np.ndarray, kib: int, before: int = 0) -> np.ndarray:
    """[blocks, block size] bytes of records, all blocks full but the last; before is how many blocks lie ahead of them."""
    n, size = records.shape
    per = per_block(size, kib)
    blocks = -(-n // per)
    held = np.full(blocks, per)
    held[-1:] = n - per * (blocks - 1)
    out = np.zeros((blocks, kib * 1024), np.uint8)
    out[:, 2:4] = (np.arange(blocks) + before + 1).astype("<u2").view(np.uint8).reshape(-1, 2)
    out[:, 4:6] = ((held - 1) * size).astype("<i2").view(np.uint8).reshape(-1, 2)
    whole = n // per
    out[:whole, 6 : 6 + per * size] = records[: whole * per].reshape(whole, per * size)
    if whole < blocks:
        out[-1, 6 : 6 + (n - whole * per) * size] = records[whole * per :].reshape(-1)
    return out


def index_of(firsts: np.ndarray, keys: list[tuple[str, int, int]], kib: int, table: str) -> bytes:
    """A primary index file over data blocks whose first keys are given: the first key of each block, level upon level."""
    pointers = lambda ids: (np.array(ids, np.uint16) ^ 0x8000).astype(">u2").view(np.uint8).reshape(-1, 2)
    key_width = firsts.shape[1]
    children = np.arange(1, len(firsts) + 1)
    blocks: list[bytes] = []
    levels = 0
    while len(firsts):
        rest = np.full((len(firsts), 4), 0x80, np.uint8)
        entries = np.concatenate([firsts, pointers(children), rest], 1)
        made = block_bytes(entries, kib, len(blocks))
        children = np.arange(len(blocks) + 1, len(blocks) + len(made) + 1)
        blocks += [x.tobytes() for x in made]
        firsts = firsts[:: per_block(key_width + 6, kib)]
        levels += 1
        if len(made) == 1:
            break
    head = header(1, key_width + 6, kib, len(blocks), 0, keys, table, root=len(blocks), levels=levels)
    return head + b"".join(blocks)


def opened(directory: str) -> tuple[pafs.FileSystem, str]:
    """File system and plain path of a folder, which is made."""
    fs, base = pafs.FileSystem.from_uri(directory) if "://" in directory else (pafs.LocalFileSystem(), directory)
    fs.create_dir(base, recursive=True)
    return fs, base


def regrouped(runs: Iterable[np.ndarray], many: int) -> Iterator[np.ndarray]:
    """Records of runs of any length, in runs of `many` with a shorter last one."""
    held: list[np.ndarray] = []
    n = 0
    for run in runs:
        held.append(run)
        n += len(run)
        if n >= many:
            joined = np.concatenate(held)
            whole = n - n % many
            yield joined[:whole]
            held, n = [joined[whole:]], n - whole
    if n:
        yield np.concatenate(held)


def put_table(directory: str, table: str, kinds: list[tuple[str, int, int]], widths: list[int], rows: int, runs: Iterable[np.ndarray], keys: int = 0, kib: int = 2, index_kib: int = 1, version: int = 0x0C, encryption: int = 0) -> None:
    """Write table.db and, with keys, table.PX from runs of [some, record size] bytes, `rows` in all, of which few are held at once."""
    fs, base = opened(directory)
    size = sum(widths)
    blocks = -(-rows // (per := per_block(size, kib)))
    assert blocks <= MOST_BLOCKS, (table, blocks)
    firsts = [np.zeros((0, sum(widths[:keys])), np.uint8)]
    before = 0
    with fs.open_output_stream(f"{base}/{table}.db") as f:
        f.write(header(0 if keys else 2, size, kib, blocks, rows, kinds, table, version, encryption=encryption))
        for run in regrouped(runs, per * max(1, (4 << 20) // (per * size))):
            made = block_bytes(run, kib, before)
            f.write(made)
            before += len(made)
            firsts.append(run[::per, : sum(widths[:keys])].copy())
    assert before == blocks, (table, before, blocks)
    if keys:
        with fs.open_output_stream(f"{base}/{table}.PX") as f:
            f.write(index_of(np.concatenate(firsts), kinds[:keys], index_kib, table))


def blob_place(widths: list[int], column: int) -> slice:
    """Where in a record the place of a Blob column's blob stands, four bytes, little endian."""
    at = sum(widths[: column + 1]) - 10
    return slice(at, at + 4)


def move_blobs(records: np.ndarray, at: slice, by: int) -> None:
    """Add a multiple of 256 to the places of blobs; NULL, which refers to none, stays."""
    places = np.ascontiguousarray(records[:, at]).view("<u4")[:, 0].astype(np.int64)
    places[places > 0] += by
    if len(places) and places.max() >= MOST_BLOB_BYTES:
        raise ValueError("the blobs are more than one file holds")
    records[:, at] = places.astype("<u4").view(np.uint8).reshape(-1, 4)


def write_table(directory: str, table: str, columns: list[Column], keys: int = 0, kib: int = 2, index_kib: int = 1, version: int = 0x0C, encryption: int = 0) -> None:
    """Write table.db and, with keys, table.PX, with Blob columns table.MB. Rows must be in key order already."""
    has_blobs = any(c.kind == "Blob" for c in columns)
    blobs = bytearray(4096)
    parts = [encode(c, blobs if has_blobs else None) for c in columns]
    records = np.concatenate(parts, 1)
    kinds = [(c.name, CODES[c.kind], c.size) for c in columns]
    put_table(directory, table, kinds, [p.shape[1] for p in parts], len(records), [records], keys, kib, index_kib, version, encryption)
    if has_blobs:
        fs, base = opened(directory)
        with fs.open_output_stream(f"{base}/{table}.MB") as f:
            f.write(blobs)


class Part:
    """A run of a table's rows as two files in a folder all executors share: its records, and its blobs with places counted from the run's start."""

    def __init__(self, directory: str, name: str) -> None:
        (self.fs, base), self.rows, self.blob_bytes = opened(directory), 0, 0
        self.paths = f"{base}/{name}.records", f"{base}/{name}.blobs"

    def put(self, batches: Iterable[list[Column]]) -> None:
        with ExitStack() as open_files:
            to = [open_files.enter_context(self.fs.open_output_stream(p)) for p in self.paths]
            for columns in batches:
                blobs = bytearray()
                parts = [encode(c, blobs) for c in columns]
                records = np.concatenate(parts, 1)
                widths = [p.shape[1] for p in parts]
                for k, c in enumerate(columns):
                    if c.kind == "Blob":
                        move_blobs(records, blob_place(widths, k), self.blob_bytes)
                blobs.extend(bytes(-len(blobs) % 256))
                to[0].write(records)
                to[1].write(blobs)
                self.rows += len(records)
                self.blob_bytes += len(blobs)


def join_parts(directory: str, parts_directory: str, table: str, columns: list[Column], parts: list[tuple[str, int, int]], keys: int, kib: int) -> None:
    """A table of parts (name, rows, bytes of blobs) in key order, copied a few MB at a time; columns are those of no rows."""
    fs, base = opened(parts_directory)
    kinds, widths = [(c.name, CODES[c.kind], c.size) for c in columns], [encode(c).shape[1] for c in columns]
    size, rows = sum(widths), sum(n for _, n, _ in parts)
    places = [blob_place(widths, k) for k, c in enumerate(columns) if c.kind == "Blob"]

    def pieces(path: str, step: int) -> Iterator[bytes]:
        with fs.open_input_stream(path) as f:
            while data := f.read(step):
                yield data

    def runs() -> Iterator[np.ndarray]:
        before = 4096
        for name, _, blob_bytes in parts:
            for data in pieces(f"{base}/{name}.records", size * max(1, (4 << 20) // size)):
                run = np.frombuffer(data, np.uint8).reshape(-1, size).copy()
                for at in places:
                    move_blobs(run, at, before)
                yield run
            before += blob_bytes

    put_table(directory, table, kinds, widths, rows, runs(), keys, fitting_kib(rows, size, kib))
    if places:
        to, folder = opened(directory)
        with to.open_output_stream(f"{folder}/{table}.MB") as f:
            f.write(bytes(4096))
            for name, _, _ in parts:
                for data in pieces(f"{base}/{name}.blobs", 4 << 20):
                    f.write(data)
