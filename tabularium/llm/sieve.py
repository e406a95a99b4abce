"""A filter of bounded size that goes before a shuffle: bitmaps of the hashes of wanted keys, broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a hash that choose a bitmap and a place in it: 1,024 bitmaps of 4 KiB, whatever the input.
MAPS, PLACES = 10, 15


def sifted(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, inside: bool = True) -> DataFrame:
    """The rows whose key is among the wanted ones, and a few others; null keys go. A shuffled join makes it exact.

    That has to be an inner join with distinct keys: the optimiser moves a semi join below the sieve, and every row is shuffled.
    inside=False gives all other rows instead, those with null keys among them.
    """
    part = lambda k, shift, bits: F.shiftrightunsigned(F.xxhash64(k), shift).bitwiseAND(F.lit((1 << bits) - 1))
    marks = wanted.filter(wanted_key.isNotNull()).select(part(wanted_key, PLACES, MAPS).alias("__map"), part(wanted_key, 0, PLACES).alias("__place"))
    maps = marks.groupBy("__map").agg(F.bitmap_construct_agg("__place").alias("__bits"))
    at = part(key, 0, PLACES)
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.call_function("shiftright", byte, at.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1
    same = part(key, PLACES, MAPS) == F.col("__map")
    if inside:
        found = rows.filter(key.isNotNull()).join(F.broadcast(maps), same).filter(marked)
    else:
        found = rows.join(F.broadcast(maps), same, "left").filter(key.isNull() | ~F.coalesce(marked, F.lit(False)))
    return found.select(*[rows[c] for c in rows.columns])
