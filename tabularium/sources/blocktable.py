"""The Spark data source "blocktable": block-range partitions decoded to Arrow batches.

Options (names in any case):
  table               stem of the table; with wildcards, all tables that match, which must have one schema
  view                data (default), index (entries of the primary index) or meta (a row a table)
  charset             code page of text, cp1252 unless given
  columns             comma-separated columns to decode; the source can't see what a query selects
  blocks              block ranges to read, as "0-3,7"; without it all blocks
  tableblocks         the same by table, as {"name": "0-3,7"} in JSON; tables it doesn't name are read by blocks
  rowids              true adds _block and _rec, the physical order (and _table where table has wildcards)
  timeas              interval (default) or time, which needs spark.sql.timeType.enabled
  mode                FAILFAST (default), or PERMISSIVE, which drops an incomplete last block
  pushdown            true prunes by the filters Spark pushes; needs spark.sql.python.filterPushdown.enabled
  truststringorder    true lets text keys prune as well
  partitionbytes      bytes of blocks in a partition, 4 MiB unless given
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, Not

from ..plans import condition as C
from ..plans import descent
from . import codec, files
from . import layout as L

NAME = "blocktable"
META = "table_name string, record_size int, file_type int, record_count int, field_count int, field_names array<string>, field_types array<string>, has_index boolean, has_blobs boolean, code_page int"


class Blocks(InputPartition):
    """A run of blocks of one file, with all that reading them takes, so that no task lists the folder again."""

    def __init__(self, name: str, path: str, header: L.Header, fields: list[L.Field], blobs: str | None, first: int, last: int) -> None:
        self.name, self.path, self.header, self.fields, self.blobs, self.first, self.last = name, path, header, fields, blobs, first, last


class Described(InputPartition):
    """A table whose header a task reads for the view meta; None stands for no rows."""

    def __init__(self, entry: tuple[str, str, str | None, str | None] | None) -> None:
        self.entry = entry


class Settings:
    """The options, read once."""

    def __init__(self, options: dict[str, str]) -> None:
        get = lambda k, default="": str(options.get(k, default) or default)
        yes = lambda k: get(k, "false").lower() == "true"
        self.directory, self.table = get("path"), get("table")
        if not self.directory or not self.table:
            raise L.TableError("a path and the option table are needed")
        self.view, self.charset, self.time_as = get("view", "data").lower(), get("charset", "cp1252"), get("timeas", "interval").lower()
        if self.view not in ("data", "index", "meta") or self.time_as not in ("interval", "time"):
            raise L.TableError(f"view {self.view} or timeAs {self.time_as} is unknown")
        self.columns = [c.strip() for c in get("columns").split(",") if c.strip()]
        self.blocks = descent.parse_ranges(str(options["blocks"])) if "blocks" in options else None
        self.table_blocks = {k: descent.parse_ranges(v) for k, v in json.loads(get("tableblocks", "{}")).items()}
        self.row_ids, self.permissive = yes("rowids"), get("mode", "FAILFAST").upper() == "PERMISSIVE"
        self.pushdown, self.trust = yes("pushdown"), yes("truststringorder")
        self.partition_bytes = int(get("partitionbytes", str(4 << 20)))
        self.many = any(c in self.table for c in "*?[")

    def tables(self) -> list[tuple[str, str, str | None, str | None]]:
        return files.companions(self.directory, self.table)

    def shape(self, entry: tuple[str, str, str | None, str | None]) -> tuple[L.Header, list[L.Field], str]:
        """(header, columns to decode, file) of the view of a table."""
        _, data_path, index_path, _ = entry
        data = files.header_of(data_path)
        if self.view == "index":
            if not index_path:
                raise L.TableError(f"table {entry[0]} has no primary index")
            header = files.header_of(index_path)
            fields, path = descent.index_fields(header, data), index_path
        else:
            header, fields, path = data, list(data.fields), data_path
        if self.columns:
            by_name = {f.name.lower(): f for f in reversed(fields)}
            missing = [c for c in self.columns if c.lower() not in by_name]
            if missing:
                raise L.TableError(f"no column {', '.join(missing)}")
            fields = [by_name[c.lower()] for c in self.columns]
        return header, fields, path

    def extra(self) -> list[tuple[str, str, pa.DataType]]:
        ids = [("_block", "int", pa.int32()), ("_rec", "int", pa.int32())] if self.row_ids or self.view == "index" else []
        return ids + [("_table", "string", pa.string())] * bool(ids and self.many)


class BlockTableSource(DataSource):
    """The registered source."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> Any:
        from pyspark.sql.types import StructField, StructType, _parse_datatype_string

        s = Settings(self.options)
        if s.view == "meta":
            return META
        _, fields, _ = s.shape(s.tables()[0])
        simple = {"smallint": "ShortType", "int": "IntegerType", "double": "DoubleType", "boolean": "BooleanType", "string": "StringType", "binary": "BinaryType", "date": "DateType", "timestamp_ntz": "TimestampNTZType"}
        from pyspark.sql import types as T

        def of(kind: str) -> Any:
            if kind in simple:
                return getattr(T, simple[kind])()
            return T.DayTimeIntervalType(0, 3) if kind.startswith("interval") else _parse_datatype_string(kind)

        columns = [StructField(f.name, of(codec.spark_type(f.code, s.time_as)), True, {"srcType": L.TYPE_NAMES[f.code], "srcSize": f.size}) for f in fields]
        return StructType(columns + [StructField(n, of(k), True) for n, k, _ in s.extra()])

    def reader(self, schema: Any) -> DataSourceReader:
        s = Settings(self.options)
        return PruningReader(s) if s.pushdown and s.view == "data" else BlockReader(s)


class BlockReader(DataSourceReader):
    """Reads runs of blocks."""

    def __init__(self, settings: Settings) -> None:
        self.settings = settings

    def planned(self, entry: tuple[str, str, str | None, str | None]) -> tuple[L.Header, list[L.Field], str, list[tuple[int, int]]]:
        header, fields, path = self.settings.shape(entry)
        return header, fields, path, self.ranges_of(entry, header)

    def ranges_of(self, entry: tuple[str, str, str | None, str | None], header: L.Header) -> list[tuple[int, int]]:
        wanted = self.settings.table_blocks.get(entry[0], self.settings.blocks)
        wanted = wanted if wanted is not None else [(0, header.file_blocks)]
        return [(max(a, 0), min(b, header.file_blocks)) for a, b in wanted if a < header.file_blocks]

    def partitions(self) -> list[InputPartition]:
        s, out = self.settings, []
        tables = s.tables()
        if s.view == "meta":
            return [Described(e) for e in tables]
        planned = files.side_by_side(self.planned, tables)
        first_fields = None
        for entry, (header, fields, path, ranges) in zip(tables, planned, strict=True):
            kinds = [(f.name, codec.spark_type(f.code)) for f in fields]
            first_fields = first_fields or kinds
            if kinds != first_fields:
                raise L.TableError(f"table {entry[0]} has another schema than the first")
            step = max(1, s.partition_bytes // max(1, header.block_size))
            for a, b in ranges:
                out += [Blocks(entry[0], path, header, fields, entry[3], low, min(b, low + step)) for low in range(a, b, step)]
        return out or [Described(None)]

    def read(self, partition: Blocks | Described) -> Iterator[pa.RecordBatch]:
        s = self.settings
        if isinstance(partition, Described):
            if partition.entry:
                yield self.meta(partition.entry)
            return
        fields = partition.fields
        need_blobs = partition.blobs and any(f.code == L.BLOB for f in fields)
        blobs = files.Blobs(partition.blobs) if need_blobs else None
        try:
            for rows, block, rec in files.records(partition.path, partition.header, partition.first, partition.last, s.permissive):
                arrays = [codec.decode(f, rows, s.charset, s.time_as, blobs) for f in fields]
                ids = {"_block": pa.array(block), "_rec": pa.array(rec), "_table": pa.array([partition.name] * len(rows), pa.string())}
                yield pa.RecordBatch.from_arrays(arrays + [ids[n] for n, _, _ in s.extra()], [f.name for f in fields] + [n for n, _, _ in s.extra()])
        finally:
            if blobs:
                blobs.close()

    def meta(self, entry: tuple[str, str, str | None, str | None]) -> pa.RecordBatch:
        h = files.header_of(entry[1])
        row = [h.table_name, h.record_size, h.file_type, h.record_count, len(h.fields), [f.name for f in h.fields], [L.TYPE_NAMES[f.code] for f in h.fields], entry[2] is not None, entry[3] is not None, h.code_page]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_(), pa.bool_(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [x.split(" ")[0] for x in META.split(", ")])


class PruningReader(BlockReader):
    """Also reads the filters that Spark pushes; all are given back, so pruning only ever saves reading."""

    _OPS = {EqualTo: C.Op.EQUAL, GreaterThan: C.Op.GREATER, GreaterThanOrEqual: C.Op.GREATER_OR_EQUAL, LessThan: C.Op.LESS, LessThanOrEqual: C.Op.LESS_OR_EQUAL}

    def __init__(self, settings: Settings) -> None:
        super().__init__(settings)
        self.condition = C.And()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        known = []
        for f in filters:
            node = f.child if isinstance(f, Not) else f
            if isinstance(f, Not):
                if isinstance(node, EqualTo) and len(node.attribute) == 1:
                    known.append(C.Compare(node.attribute[0], C.Op.NOT_EQUAL, node.value))
            elif type(node) in self._OPS and len(node.attribute) == 1:
                known.append(C.Compare(node.attribute[0], self._OPS[type(node)], node.value))
            elif isinstance(node, In) and len(node.attribute) == 1:
                known.append(C.Or(C.Compare(node.attribute[0], C.Op.EQUAL, v) for v in node.value))
        self.condition = C.And(known)
        yield from filters

    def ranges_of(self, entry: tuple[str, str, str | None, str | None], header: L.Header) -> list[tuple[int, int]]:
        s = self.settings
        found = descent.blocks_for(self.condition, entry[2], header, s.charset, s.trust) if self.condition.children else None
        whole = super().ranges_of(entry, header)
        if found is None:
            return whole
        kept = descent.parse_ranges(descent.ranges(found))
        return [(max(a, c), min(b, d)) for a, b in kept for c, d in whole if max(a, c) < min(b, d)]
