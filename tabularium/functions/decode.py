"""Decoders of single fields as Column expressions over binary columns, without Python: zero bytes alone give NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _unless_null(raw: Column, value: Column) -> Column:
    return F.when(F.hex(raw).rlike("^0*$"), None).otherwise(value)


def _unsigned(raw: Column) -> Column:
    return F.conv(F.hex(raw), 16, 10)


def short(raw: Column) -> Column:
    """Big-endian 16 bits, top bit flipped."""
    return _unless_null(raw, (_unsigned(raw).cast("int") - 32768).cast("smallint"))


def long(raw: Column) -> Column:
    """Big-endian 32 bits, top bit flipped."""
    return _unless_null(raw, (_unsigned(raw).cast("bigint") - 2147483648).cast("int"))


def date(raw: Column) -> Column:
    """Day number; day 1 is 0001-01-01."""
    days = (_unsigned(raw).cast("bigint") - 2147483648).cast("int")
    return _unless_null(raw, F.date_add(F.lit("0001-01-01").cast("date"), days - 1))


def time(raw: Column) -> Column:
    """Milliseconds of the day as an interval."""
    ms = _unsigned(raw).cast("bigint") - 2147483648
    return _unless_null(raw, F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ms.cast("decimal(18,3)") / 1000))


def logical(raw: Column) -> Column:
    """Above 128: true."""
    return _unless_null(raw, _unsigned(raw).cast("int") > 128)


def number(raw: Column) -> Column:
    """Order-preserving double: top bit set means positive, else all bits are inverted; NaN is NULL."""
    high, low = (F.conv(F.substring(F.hex(raw), a, 8), 16, 10).cast("bigint") for a in (1, 9))
    positive = high >= 2147483648
    high = F.when(positive, high - 2147483648).otherwise(4294967295 - high)
    low = F.when(positive, low).otherwise(4294967295 - low)
    # Without its sign bit high has 31 bits; a negative number's inverted bits have it set.
    sign = F.when(positive, F.lit(1.0)).otherwise(F.lit(-1.0))
    high = F.when(high >= 2147483648, high - 2147483648).otherwise(high)
    exponent = F.shiftright(high, 20)
    fraction = high.bitwiseAND(F.lit(0xFFFFF)).cast("double") * 4294967296.0 + low.cast("double")
    value = F.when(exponent == 0, fraction * F.pow(F.lit(2.0), F.lit(-1074.0))).otherwise((fraction / 4503599627370496.0 + 1.0) * F.pow(F.lit(2.0), exponent.cast("double") - 1023.0))
    special = F.when(fraction == 0, sign * F.lit(float("inf")))
    return _unless_null(raw, F.when(exponent == 2047, special).otherwise(sign * value))


def alpha(raw: Column, charset: str = "UTF-8") -> Column:
    """Text up to the first NUL, in an encoding that Spark decodes (ISO-8859-1, US-ASCII, UTF-8, UTF-16, UTF-32)."""
    end = F.instr(F.decode(raw, "ISO-8859-1"), "\0")
    cut = F.when(end > 0, F.substring(raw, F.lit(1), end - 1)).otherwise(raw)
    return _unless_null(raw, F.decode(cut, charset))
