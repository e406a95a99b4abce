"""Field decoders against fixed byte vectors, in numpy and as Column expressions."""

import datetime as dt
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.functions import decode
from tabularium.sources import codec
from tabularium.sources import layout as L


def value(code, raw, size=None, **options):
    data = bytes.fromhex(raw) if isinstance(raw, str) else raw
    field = L.Field("c", code, len(data) if size is None else size, 0)
    return codec.decode(field, np.frombuffer(data, np.uint8)[None, :], **options)[0].as_py()


# Bytes of the format and what they mean.
VECTORS = [
    (L.NUMBER, "8000000000000000", 0.0), (L.CURRENCY, "8000000000000000", 0.0), (L.NUMBER, "BFF8000000000000", 1.5), (L.CURRENCY, "C0934A3D70A3D70A", 1234.56), (L.NUMBER, "4007FFFFFFFFFFFF", -1.5), (L.CURRENCY, "4007FFFFFFFFFFFF", -1.5),
    (L.LONG, "80000005", 5), (L.LONG, "7FFFFFFF", -1), (L.AUTOINC, "80000005", 5), (L.SHORT, "8001", 1), (L.SHORT, "7FFF", -1), (L.DATE, "800B2408", dt.date(2000, 1, 1)), (L.LOGICAL, "81", True), (L.LOGICAL, "80", False), (L.LOGICAL, "00", None),
]


@pytest.mark.parametrize(("code", "raw", "want"), VECTORS)
def test_vectors(code, raw, want):
    assert value(code, raw) == want


@pytest.mark.parametrize(("code", "width"), [(L.NUMBER, 8), (L.CURRENCY, 8), (L.LONG, 4), (L.SHORT, 2), (L.DATE, 4), (L.TIME, 4), (L.TIMESTAMP, 8), (L.ALPHA, 5), (L.MEMO, 20), (L.BLOB, 10), (L.BCD, 17), (L.LOGICAL, 1)])
def test_zero_bytes_are_null(code, width):
    assert value(code, bytes(width)) is None


def flipped(x):
    raw = bytearray(struct.pack(">d", x))
    return bytes(b ^ 0xFF for b in raw) if raw[0] & 0x80 else bytes([raw[0] | 0x80]) + bytes(raw[1:])


@pytest.mark.parametrize("x", [1e-310, -1e-310, 1e300, -0.1, math.inf, -math.inf, 123456.789])
def test_doubles(x):
    assert value(L.NUMBER, flipped(x)) == x == value(L.CURRENCY, flipped(x))


def test_nan_is_null():
    raw = bytes([0xFF, 0xF8]) + bytes(6)
    assert value(L.NUMBER, raw) is None and value(L.CURRENCY, raw) is None


def test_timestamp_and_time():
    assert value(L.TIMESTAMP, flipped(62_135_683_200_000.0)) == dt.datetime(1970, 1, 1)
    assert value(L.TIMESTAMP, flipped(62_135_683_200_000.0 - 1)) == dt.datetime(1969, 12, 31, 23, 59, 59, 999000)
    assert value(L.TIME, struct.pack(">I", 0x80000000 + 3_723_004)) == dt.timedelta(hours=1, minutes=2, seconds=3, milliseconds=4)
    assert value(L.TIME, struct.pack(">I", 0x80000000 + 1000), time_as="time") == dt.time(0, 0, 1)


def test_text():
    assert value(L.ALPHA, b"ab  \0zz") == "ab  "
    assert value(L.ALPHA, b"full") == "full"  # no NUL within the field
    assert value(L.ALPHA, b"\x80uro\xe9") == "€uroé"
    assert value(L.ALPHA, "é中".encode(), charset="utf-8") == "é中"
    assert value(L.ALPHA, b"\xff\xfea", charset="utf-8") == "��a"
    assert value(L.ALPHA, b"\x84", charset="cp437") == "ä"
    assert value(L.ALPHA, b"\x93\xfa", charset="shift_jis") == "日"


def test_split_characters_between_rows():
    """A row that ends within a character doesn't borrow from the next."""
    rows = np.frombuffer(b"\xc3\xa9\xc3" + b"\xa9ab", np.uint8).reshape(2, 3)
    assert codec.decode(L.Field("c", L.ALPHA, 3, 0), rows, "utf-8").to_pylist() == ["é�", "�ab"]


def test_memo():
    trailer = lambda n: struct.pack("<Iih", 0, n, 1)
    assert value(L.MEMO, b"hello" + bytes(5) + trailer(5)) == "hello"
    assert value(L.MEMO, b"hello worl" + trailer(400)) == "hello worl"  # longer than its leader: what is there
    assert value(L.MEMO, b"hello worl" + trailer(3)) == "hel"
    assert value(L.MEMO, b"hello worl" + trailer(-1)) == ""
    assert value(L.MEMO, b"\x01\x02\x03", 3) == ""


def test_wrong_width():
    with pytest.raises(L.TableError):
        value(L.LONG, b"\x80\x01")


def test_column_expressions(spark):
    of = {L.SHORT: decode.short, L.LONG: decode.long, L.AUTOINC: decode.long, L.DATE: decode.date, L.LOGICAL: decode.logical, L.NUMBER: decode.number, L.CURRENCY: decode.number}
    more = [(L.NUMBER, flipped(x).hex(), x) for x in (1e-310, 1e300, -0.1, math.inf, -math.inf, -123456.789)] + [(L.NUMBER, "fff8" + "00" * 6, None)]
    rows = [(k, bytes.fromhex(raw)) for k, (_, raw, _) in enumerate([*VECTORS, *more])]
    for code, f in of.items():
        wanted = {k: v for k, (c, _, v) in enumerate([*VECTORS, *more]) if c == code}
        frame = spark.createDataFrame([r for r in rows if r[0] in wanted], "k int, raw binary")
        assert {r["k"]: r["v"] for r in frame.select("k", f(F.col("raw")).alias("v")).collect()} == wanted
    frame = spark.createDataFrame([(struct.pack(">I", 0x80000000 + 3_723_004), b"ab\0cd"), (bytes(4), bytes(5))], "t binary, a binary")
    got = frame.select(decode.time(F.col("t")).alias("t"), decode.alpha(F.col("a")).alias("a")).collect()
    assert [tuple(r) for r in got] == [(dt.timedelta(seconds=3723, milliseconds=4), "ab"), (None, None)]
