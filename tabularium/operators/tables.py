"""Tables as DataFrames: open, scan, range scan, index and metadata views, first rows, cursor."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..plans import descent
from ..plans.condition import Condition
from ..runtime import ship
from ..sources import files
from ..sources import layout as L
from ..sources.blocktable import NAME, BlockTableSource

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def register(spark: SparkSession) -> None:
    """Make the format "blocktable" known to a session."""
    ship(spark)
    spark.dataSource.register(BlockTableSource)


def read_table(spark: SparkSession, directory: str, table: str, **options: Any) -> DataFrame:
    """All rows of a table (or of all that match a pattern); options as in sources.blocktable. pushdown=True sets the session's flag for it."""
    register(spark)
    text = {k: str(v).lower() if isinstance(v, bool) else ",".join(v) if isinstance(v, (list, tuple)) else str(v) for k, v in options.items()}
    reader = spark.read.format(NAME).option("table", table)
    if text.get("pushdown") != "true":
        return reader.options(**text).load(directory)
    spark.conf.set(PUSHDOWN, "true")
    # Spark keeps the partitions of a source's last pushed filters and uses them again when a later query over the same
    # DataFrame pushes none, so one filter that always holds goes along.
    wanted = next((v for k, v in text.items() if k.lower() == "rowids"), "false")
    df = reader.options(**{k: v for k, v in text.items() if k.lower() != "rowids"}, rowIds="true").load(directory).filter("_block >= 0")
    return df if wanted == "true" else df.drop("_block", "_rec", "_table")


def read_index(spark: SparkSession, directory: str, table: str, levels: int | None = None, **options: Any) -> DataFrame:
    """The entries of a table's primary index: keys, child_block, x1, x2, _block, _rec; of all its levels, or of the lowest only."""
    if levels is not None:
        indexes = [(name, path) for name, _, path, _ in files.companions(directory, table) if path]
        options["tableBlocks"] = json.dumps({name: descent.ranges(descent.level_blocks(path, levels)) for name, path in indexes})
    return read_table(spark, directory, table, view="index", **options)


def read_meta(spark: SparkSession, directory: str, table: str) -> DataFrame:
    """What the header says, and which companions there are: a row a table."""
    return read_table(spark, directory, table, view="meta")


def scan(df: DataFrame, where: Column | Condition | Callable[[Row], bool] | None = None) -> DataFrame:
    """The rows of a table that satisfy a Column, a condition tree or any function of a row; the function is the slow path."""
    if where is None:
        return df
    if isinstance(where, Condition):
        return df.filter(where.column())
    if isinstance(where, Column):
        return df.filter(where)
    opaque = F.udf(lambda row: bool(where(row)), BooleanType())
    return df.filter(opaque(F.struct(*[F.col(f"`{c}`") for c in df.columns])))


def surviving(directory: str, table: str, condition: Condition, charset: str = "cp1252", trust_string_order: bool = False) -> list[int] | None:
    """Numbers of the blocks of one table that a range scan reads, None for all. A pattern that matches several tables is an error."""
    found = files.companions(directory, table)
    if len(found) > 1:
        raise L.TableError(f"{len(found)} tables match {table}; block numbers are those of one")
    _, data_path, index_path, _ = found[0]
    return descent.blocks_for(condition, index_path, files.header_of(data_path), charset, trust_string_order)


def range_scan(spark: SparkSession, directory: str, table: str, condition: Condition, ordered: bool = False, **options: Any) -> DataFrame:
    """Rows that satisfy a condition tree, reading only the blocks its index descent leaves; AND and OR prune alike.

    A pattern descends the index of each table that matches; tables without one are read whole. ordered=True sorts by the
    index's key columns (the first table's); otherwise rows come in no defined order.
    """
    charset, trust = str(options.get("charset", "cp1252")), str(options.get("trustStringOrder", False)).lower() == "true"
    tables = files.companions(directory, table)
    found = files.side_by_side(lambda t: descent.blocks_for(condition, t[2], files.header_of(t[1]), charset, trust), tables)
    left = {t[0]: descent.ranges(blocks) for t, blocks in zip(tables, found, strict=True) if blocks is not None}
    if left:
        options["tableBlocks"] = json.dumps(left)
    out = read_table(spark, directory, table, **options).filter(condition.column())
    return out.orderBy(*key_columns(directory, table)) if ordered else out


def key_columns(directory: str, table: str) -> list[str]:
    """Names of the primary index's key columns."""
    _, data_path, index_path, _ = files.companions(directory, table)[0]
    if not index_path:
        return []
    data, index = files.header_of(data_path), files.header_of(index_path)
    return [f.name for f in data.fields[: len(index.fields) - 3]]


def in_physical_order(df: DataFrame) -> DataFrame:
    """Rows as they lie in the file, table by table where there are many; df needs rowIds=True."""
    return df.orderBy(*["_table"] * ("_table" in df.columns), "_block", "_rec")


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first n rows of any query in physical order; df needs rowIds=True. leading_rows reads less where the query is a table."""
    return in_physical_order(df).limit(n)


def leading_rows(spark: SparkSession, directory: str, table: str, n: int, **options: Any) -> DataFrame:
    """The first n rows in physical order, of the tables by name where a pattern matches several, with the columns of rowIds=True.

    Only the blocks that hold them are read: the counts in the block heads tell how many, from the first block on.
    """
    wanted, blocks = n, {}
    for name, data_path, _, _ in files.companions(directory, table):
        some, rows = files.leading_blocks(data_path, files.header_of(data_path), wanted)
        blocks[name] = f"0-{some - 1}" if some else ""
        wanted = max(0, wanted - rows)
    return first_rows(read_table(spark, directory, table, **options | {"rowIds": True, "tableBlocks": json.dumps(blocks)}), n)


class Cursor:
    """A forward-only cursor over the rows of any query, fetched a partition at a time; a context manager that closes it."""

    def __init__(self, df: DataFrame) -> None:
        self.df, self.schema = df, df.schema
        self._rows: Iterator[Row] = df.toLocalIterator(prefetchPartitions=False)
        self.current: Row | None = None

    def close(self) -> None:
        """Let go of the rows that are left; partitions not yet fetched are never read. read() is False from then on."""
        self._rows, self.current = iter(()), None

    def __enter__(self) -> Cursor:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def read(self) -> bool:
        """Advance; False after the last row."""
        self.current = next(self._rows, None)
        return self.current is not None

    @property
    def field_count(self) -> int:
        return len(self.schema)

    def name(self, i: int) -> str:
        return self.schema[i].name

    def ordinal(self, name: str) -> int:
        """The first column of that name in any case, else -1."""
        return next((i for i, f in enumerate(self.schema) if f.name.lower() == name.lower()), -1)

    def source_type(self, i: int) -> str | None:
        return self.schema[i].metadata.get("srcType")

    def field_type(self, i: int) -> Any:
        return self.schema[i].dataType

    def is_null(self, i: int) -> bool:
        return self[i] is None

    def values(self) -> tuple:
        return tuple(self._row())

    def _row(self) -> Row:
        if self.current is None:
            raise ValueError("the cursor is not on a row")
        return self.current

    def __getitem__(self, at: int | str) -> Any:
        i = at if isinstance(at, int) else self.ordinal(at)
        if isinstance(at, str) and i < 0:
            raise KeyError(at)
        return self._row()[i]

    def __iter__(self) -> Iterator[Row]:
        while self.read():
            yield self._row()
