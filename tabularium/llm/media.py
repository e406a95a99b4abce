"""Media columns: Netpbm and BMP decoding, area resizing by integral images, NPY tiles and difference hashes.

Rows: a null payload is an empty one, an empty payload is one block of zeros; equal payloads give equal rows.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..runtime import ship

#: Samples in a stored row and bytes in a padding block.
ROW = 64
#: Side of a tile before and after resizing.
TILE, TILE_OUT = 256, 32


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 to an array (h, w) or (h, w, 3); bitmaps are 0/1 with 1 for black, 16-bit samples are big-endian."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError(f"not a Netpbm image: {kind!r}")
    at, fields = 2, []
    need = 2 if kind in (b"P1", b"P4") else 3
    header = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")
    while len(fields) < need:
        m = header.match(data, at)
        if not m:
            raise ValueError("the Netpbm header is cut off")
        fields.append(int(m[1]))
        at = m.end()
    w, h, top = fields[0], fields[1], fields[2] if need == 3 else 1
    channels = 3 if kind in (b"P3", b"P6") else 1
    shape = (h, w, 3) if channels == 3 else (h, w)
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        values = [int(x) for x in (re.findall(rb"[01]", body) if kind == b"P1" else body.split())[: h * w * channels]]
        return np.array(values, np.uint16 if top > 255 else np.uint8).reshape(shape)
    at += 1  # a single white-space byte ends the header
    if kind == b"P4":
        rows = np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at).reshape(h, -1)
        return np.unpackbits(rows, axis=1)[:, :w]
    return np.frombuffer(data, ">u2" if top > 255 else np.uint8, h * w * channels, at).reshape(shape)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits a pixel to (h, w) for grey palettes, else (h, w, 3) in RGB order."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    u32 = lambda at: int.from_bytes(data[at : at + 4], "little")
    i32 = lambda at: int.from_bytes(data[at : at + 4], "little", signed=True)
    start, head, w, h, bits, packing = u32(10), u32(14), i32(18), i32(22), int.from_bytes(data[28:30], "little"), u32(30)
    if packing or bits not in (1, 4, 8, 24, 32):
        raise ValueError(f"BMP with {bits} bits and compression {packing} is not supported")
    stride = (w * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, abs(h) * stride, start).reshape(abs(h), stride)
    rows = rows[::-1] if h > 0 else rows
    if bits >= 24:
        return rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1]
    if bits == 8:
        index = rows[:, :w]
    elif bits == 4:
        index = np.stack([rows >> 4, rows & 15], 2).reshape(abs(h), -1)[:, :w]
    else:
        index = np.unpackbits(rows, axis=1)[:, :w]
    n = u32(46) or 1 << bits
    palette = np.frombuffer(data, np.uint8, n * 4, 14 + head).reshape(n, 4)[:, 2::-1]
    if index.size and index.max() >= n:
        raise ValueError("a BMP sample lies beyond its palette")
    image = palette[index]
    return image[:, :, 0] if (palette == palette[:, :1]).all() else image


def decode(data: bytes) -> np.ndarray:
    """A Netpbm or BMP file to an array."""
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(samples: np.ndarray) -> bytes:
    """8-bit samples (h, w) as binary PGM."""
    h, w = samples.shape
    return b"P5\n%d %d\n255\n" % (w, h) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit samples (h, w) as a bottom-up BMP with a grey palette."""
    h, w = samples.shape
    stride = (w + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, :w] = samples[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1)
    palette[:, 3] = 0
    le = lambda v, n=4: int(v).to_bytes(n, "little")
    start = 14 + 40 + 1024
    return b"BM" + le(start + rows.size) + le(0) + le(start) + le(40) + le(w) + le(h) + le(1, 2) + le(8, 2) + le(0) + le(rows.size) + le(0) * 2 + le(256) + le(0) + palette.tobytes() + rows.tobytes()


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal (fractional) areas, from the integral image sampled with bilinear interpolation, which is exact."""
    if image.ndim == 3:
        return np.stack([area_resize(image[:, :, c], height, width) for c in range(image.shape[2])], 2)
    h, w = image.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(image, 0, dtype=np.float64), 1, out=total[1:, 1:])

    def along(a: np.ndarray, n: int, out: int) -> np.ndarray:
        at = np.arange(out + 1) * n / out
        low = np.minimum(at.astype(np.int64), n - 1)
        part = (at - low)[:, None]
        return a[low] * (1 - part) + a[low + 1] * part

    corners = along(along(total, h, height).T, w, width).T
    return (corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]) * (height * width / (h * w))


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hex: whether each of 8 x 9 area means is below its right neighbour."""
    grey = image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])
    means = np.round(area_resize(grey, 8, 9), 6)
    return np.packbits(means[:, :-1] < means[:, 1:]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    """An array in the NPY format."""
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(array), allow_pickle=False)
    return out.getvalue()


def tiles(image: np.ndarray, side: int = TILE, out: int = TILE_OUT) -> Iterator[tuple[int, int, bytes, str]]:
    """(row, column, NPY bytes, difference hash) of each tile of the image, resized to at most out x out samples of the image's own kind, 8 or 16 bits."""
    for y in range(0, image.shape[0], side):
        for x in range(0, image.shape[1], side):
            part = image[y : y + side, x : x + side]
            small = np.round(area_resize(part, min(out, part.shape[0]), min(out, part.shape[1]))).astype(image.dtype)
            yield y // side, x // side, npy(small), difference_hash(part)


def store_payload(payload: bytes) -> bytes:
    """Bytes, padded with 0 to a positive multiple of ROW, as an 8-bit PGM of ROW samples a row."""
    padded = payload + bytes(-len(payload) % ROW or (0 if payload else ROW))
    return encode_pgm(np.frombuffer(padded, np.uint8).reshape(-1, ROW))


def stored_media(rows: DataFrame, key: str = "doc_id", payload: str = "text") -> DataFrame:
    """(key, n_bytes, media binary): each payload stored as an image."""
    ship(rows.sparkSession)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                data = [(x or "").encode() for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array([store_payload(x) for x in data], pa.binary())], ["key", "n_bytes", "media"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(rows[key].alias("key"), rows[payload].cast("string").alias("payload")).mapInArrow(store, f"key {kind}, n_bytes long, media binary")


def media_tiles(media: DataFrame) -> DataFrame:
    """(key, tile_row, tile_column, npy binary, dhash) for each tile of each stored image; an image that is null or can't be decoded gives no tile."""
    ship(media.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    image = decode(data.as_py() or b"")
                except ValueError:
                    continue
                found = list(tiles(image))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), batch.schema.field(0).type), *(pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.string())))], ["key", "tile_row", "tile_column", "npy", "dhash"])

    return media.select("key", "media").mapInArrow(cut, f"key {media.schema['key'].dataType.simpleString()}, tile_row int, tile_column int, npy binary, dhash string")


def media_features(media: DataFrame) -> DataFrame:
    """Digests of what is read back from each stored image: payload and media lengths and hashes, feature (dhash of the image, hash of its first NPY tile)."""
    ship(media.sparkSession)
    schema = pa.schema([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_tiles", pa.int32()), ("tiles_sha256", pa.string())])

    def one(n: int, data: bytes) -> tuple:
        image = decode(data)
        payload = image.tobytes()
        cut = list(tiles(image))
        return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(image), len(cut), hashlib.sha256(b"".join(x[2] for x in cut)).hexdigest()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [one(n, m.as_py()) for n, m in zip(batch.column(1).to_pylist(), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in made], f.type) for i, f in enumerate(schema))], ["key", *schema.names])

    return media.select("key", "n_bytes", "media").mapInArrow(read, f"key {media.schema['key'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_tiles int, tiles_sha256 string")
