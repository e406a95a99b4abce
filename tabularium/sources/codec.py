"""Field decoders over whole batches: a [rows, width] byte array to an Arrow column. A field of zero bytes alone is NULL."""

from __future__ import annotations

import codecs
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa

from . import layout as L

#: Day number of 1970-01-01, counted from 0001-01-01 as day 1.
EPOCH_DAY = 719163
DAY_MS = 86_400_000


def arrow_type(code: int, time_as: str = "interval") -> pa.DataType:
    """The Arrow type a field decodes to; unsupported types give binary NULLs."""
    return {
        L.ALPHA: pa.string(), L.MEMO: pa.string(), L.DATE: pa.date32(), L.SHORT: pa.int16(), L.LONG: pa.int32(), L.AUTOINC: pa.int32(), L.CURRENCY: pa.float64(), L.NUMBER: pa.float64(),
        L.LOGICAL: pa.bool_(), L.TIMESTAMP: pa.timestamp("us"), L.TIME: pa.duration("us") if time_as == "interval" else pa.time64("ns"),
    }.get(code, pa.binary())


def spark_type(code: int, time_as: str = "interval") -> str:
    """The same as a Spark type name."""
    return {
        L.ALPHA: "string", L.MEMO: "string", L.DATE: "date", L.SHORT: "smallint", L.LONG: "int", L.AUTOINC: "int", L.CURRENCY: "double", L.NUMBER: "double",
        L.LOGICAL: "boolean", L.TIMESTAMP: "timestamp_ntz", L.TIME: "interval day to second" if time_as == "interval" else "time(6)",
    }.get(code, "binary")


def integers(raw: np.ndarray) -> np.ndarray:
    """Big-endian integers whose top bit is flipped, so that bytes sort as numbers do."""
    kind = {2: ">u2", 4: ">u4"}[raw.shape[1]]
    values = np.ascontiguousarray(raw).view(kind)[:, 0]
    bits = 8 * raw.shape[1]
    return (values.astype(np.int64) - (1 << (bits - 1))).astype(np.int16 if bits == 16 else np.int32)


def doubles(raw: np.ndarray) -> np.ndarray:
    """Order-preserving doubles: the top bit set means positive with that bit added, else all bits are inverted."""
    bits = np.ascontiguousarray(raw).view(">u8")[:, 0].astype(np.uint64)
    top = np.uint64(1 << 63)
    return np.where(bits & top, bits ^ top, ~bits).view(np.float64)


@lru_cache(8)
def _widths(charset: str) -> np.ndarray | None:
    """UTF-8 length of each byte of a single-byte code page; None for other encodings."""
    if codecs.lookup(charset).name in ("utf-8", "ascii"):
        return None
    try:
        each = [bytes([b]).decode(charset, "replace") for b in range(256)]
    except UnicodeDecodeError:
        return None
    whole = bytes(range(256)).decode(charset, "replace")
    return np.array([len(c.encode()) for c in each]) if "".join(each) == whole and len(whole) == 256 else None


def strings(raw: np.ndarray, length: np.ndarray, null: np.ndarray, charset: str) -> pa.Array:
    """Text up to the first NUL and at most length bytes of each row."""
    n, width = raw.shape
    zero = raw == 0
    first = np.where(zero.any(1), zero.argmax(1), width) if width else np.zeros(n, np.int64)
    length = np.where(null, 0, np.minimum(np.clip(length, 0, width), first))
    flat = raw[np.arange(width) < length[:, None]]
    offsets = np.concatenate([[0], np.cumsum(length)])
    data, widths = flat.tobytes(), _widths(charset)
    if widths is not None:
        offsets = np.concatenate([[0], np.cumsum(widths[flat])])[offsets]
        data = data.decode(charset, "replace").encode()
    else:
        try:
            if codecs.lookup(charset).name not in ("utf-8", "ascii"):
                raise UnicodeDecodeError(charset, b"", 0, 0, "")
            data.decode(charset)
            if len(flat) and ((flat[np.minimum(offsets[:-1], len(flat) - 1)] & 0xC0) == 0x80)[length > 0].any():
                raise UnicodeDecodeError(charset, b"", 0, 0, "")
        except UnicodeDecodeError:
            values = [None if x else data[a:b].decode(charset, "replace") for x, a, b in zip(null, offsets[:-1], offsets[1:], strict=True)]
            return pa.array(values, pa.string())
    bits = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    return pa.StringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data), bits)


def decode(field: L.Field, records: np.ndarray, charset: str = "cp1252", time_as: str = "interval", blobs: Callable[[np.ndarray], list[bytes | None]] | None = None) -> pa.Array:
    """One column of [rows, record size] bytes."""
    raw, code, n = records[:, field.offset : field.offset + field.width], field.code, len(records)
    kind = arrow_type(code, time_as)
    null = ~raw.any(1)
    if code == L.ALPHA:
        return strings(raw, np.full(n, field.width), null, charset)
    if code == L.MEMO:  # the text before the last ten bytes, of which four give its length
        lead = max(field.width - 10, 0)
        length = np.ascontiguousarray(raw[:, lead + 4 : lead + 8]).view("<i4")[:, 0] if field.width >= 10 else np.zeros(n, np.int64)
        return strings(raw[:, :lead], length, null, charset)
    if code == L.BLOB:
        found = blobs(raw[:, -10:]) if blobs and field.width >= 10 else [None] * n
        return pa.array([None if x else b for x, b in zip(null, found, strict=True)], kind)
    if code in (L.FMT_MEMO, L.OLE, L.GRAPHIC, L.BCD, L.BYTES):
        return pa.nulls(n, kind)
    need = {L.SHORT: 2, L.LONG: 4, L.AUTOINC: 4, L.DATE: 4, L.TIME: 4, L.CURRENCY: 8, L.NUMBER: 8, L.TIMESTAMP: 8, L.LOGICAL: 1}[code]
    if field.width != need:
        raise L.TableError(f"column {field.name} ({L.TYPE_NAMES[code]}) has {field.width} bytes")
    if code == L.LOGICAL:
        return pa.array(raw[:, 0] > 128, kind, mask=null)
    if code in (L.SHORT, L.LONG, L.AUTOINC):
        return pa.array(integers(raw), kind, mask=null)
    if code == L.DATE:
        return pa.array((integers(raw).astype(np.int64) - EPOCH_DAY).astype(np.int32), pa.int32(), mask=null).cast(kind)
    if code == L.TIME:
        ms = integers(raw).astype(np.int64)
        return pa.array(ms * (1000 if time_as == "interval" else 1_000_000), pa.int64(), mask=null).cast(kind)
    value = doubles(raw)
    null = null | np.isnan(value)
    if code == L.TIMESTAMP:
        with np.errstate(invalid="ignore"):
            us = np.where(null, 0, np.rint((value - EPOCH_DAY * float(DAY_MS)) * 1000)).astype(np.int64)
        return pa.array(us, pa.int64(), mask=null).cast(kind)
    return pa.array(value, kind, mask=null)
