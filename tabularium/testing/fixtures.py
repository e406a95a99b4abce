"""Block tables made from the driver's parquet tables, once a session and source folder. TEST-ONLY.

Executors sort and encode the rows, a range of keys each; the driver only copies what they wrote into one file, a few MB at a
time. Blocks are as large as FIXTURES says unless a file would need more of them than it can number.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..runtime import shared_dir, ship, table
from .synth import Column, Part, join_parts, opened

DAY_ZERO = 719163
DAY_MS = 86_400_000


def _days(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.cast(pa.timestamp("us")).cast(pa.int64())) // (DAY_MS * 1000) + DAY_ZERO


def _ms(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.cast(pa.timestamp("us")).cast(pa.int64())) // 1000


def _orders(t: pa.Table) -> tuple[list[Column], int]:
    v = {c: t[c] for c in t.column_names if c != "o_orderdate"}
    return [
        Column("o_orderkey", "Long", 4, v["o_orderkey"]), Column("o_custkey", "Long", 4, v["o_custkey"]), Column("o_orderstatus", "Alpha", 1, v["o_orderstatus"]),
        Column("o_totalprice", "Currency", 8, v["o_totalprice"]), Column("o_orderdate", "Date", 4, _days(t["o_orderdate"])), Column("o_orderpriority", "Alpha", 15, v["o_orderpriority"]),
    ], 1


def _split(part: str) -> Callable[[pa.Table], tuple[list[Column], int]]:
    """Orders below 100, and the others' odd or even keys: tables of unlike size with keys that overlap."""

    def build(t: pa.Table) -> tuple[list[Column], int]:
        key = np.asarray(t["o_orderkey"])
        inside = {"low": key < 100, "odd": (key >= 100) & (key % 2 == 1), "even": (key >= 100) & (key % 2 == 0)}
        return _orders(t.filter(pa.array(inside[part])))

    return build


def _customer(t: pa.Table) -> tuple[list[Column], int]:
    v = {c: t[c] for c in t.column_names}
    return [
        Column("c_custkey", "AutoInc", 4, v["c_custkey"]), Column("c_name", "Alpha", 25, v["c_name"]), Column("c_nationkey", "Short", 2, v["c_nationkey"]),
        Column("c_acctbal", "Number", 8, v["c_acctbal"]), Column("acctbal_cur", "Currency", 8, v["c_acctbal"]), Column("c_mktsegment", "Alpha", 10, v["c_mktsegment"]),
    ], 1


def _nulls(t: pa.Table) -> tuple[list[Column], int]:
    """customer with column i NULL where c_custkey % 7 = i, and a Number that is NaN where c_custkey % 5 = 0."""
    columns, _ = _customer(t)
    key = t["c_custkey"].to_pylist()
    out = [Column("id", "Long", 4, key)]
    out += [Column(c.name, c.kind, c.size, [None if k % 7 == i else x for k, x in zip(key, c.values.to_pylist(), strict=True)]) for i, c in enumerate(columns)]
    out.append(Column("maybe_nan", "Number", 8, [float("nan") if k % 5 == 0 else x for k, x in zip(key, columns[3].values.to_pylist(), strict=True)]))
    return out, 0


def _events(t: pa.Table) -> tuple[list[Column], int]:
    ms = _ms(t["ts"])
    v = {c: t[c] for c in ("event_id", "user_id", "event_type", "value")}
    return [
        Column("event_id", "Long", 4, v["event_id"]), Column("ts", "Timestamp", 8, (ms + DAY_ZERO * DAY_MS).astype(float)), Column("tod", "Time", 4, ms % DAY_MS),
        Column("user_id", "Long", 4, v["user_id"]), Column("event_type", "Alpha", 12, v["event_type"]), Column("value", "Number", 8, v["value"]), Column("is_error", "Logical", 1, pc.equal(v["event_type"], "error").to_pylist()),
    ], 1


def _conversations(t: pa.Table) -> tuple[list[Column], int]:
    v = {c: t[c].to_pylist() for c in t.column_names}
    return [Column("conv_id", "Long", 4, v["conv_id"]), Column("turn", "Short", 2, v["turn"]), Column("role", "Alpha", 10, v["role"]), Column("text", "Memo", 110, [x[:25] for x in v["text"]])], 2


def _documents(t: pa.Table) -> tuple[list[Column], int]:
    v = {c: t[c].to_pylist() for c in ("doc_id", "text", "n_chars", "lang")}
    return [Column("doc_id", "Long", 4, v["doc_id"]), Column("body", "Blob", 10, v["text"]), Column("n_chars", "Long", 4, v["n_chars"]), Column("lang", "Alpha", 8, v["lang"])], 1


def _lineitem(t: pa.Table) -> tuple[list[Column], int]:
    v = {c: t[c] for c in t.column_names if c != "l_shipdate"}
    kinds = {"l_orderkey": ("Long", 4), "l_partkey": ("Long", 4), "l_suppkey": ("Long", 4), "l_linenumber": ("Short", 2), "l_quantity": ("Number", 8), "l_extendedprice": ("Number", 8), "l_discount": ("Number", 8), "l_tax": ("Number", 8), "l_returnflag": ("Alpha", 1), "l_linestatus": ("Alpha", 1)}
    return [*(Column(n, *k, v[n]) for n, k in kinds.items()), Column("l_shipdate", "Date", 4, _days(t["l_shipdate"]))], 0


def _unsupported(t: pa.Table) -> tuple[list[Column], int]:
    some = [1] * t.num_rows
    return [
        Column("r_regionkey", "Short", 2, t["r_regionkey"].to_pylist()), Column("fmt", "FmtMemo", 10, some), Column("ole", "OLE", 10, some), Column("pic", "Graphic", 10, some),
        Column("bcd", "BCD", 4, some), Column("raw", "Bytes", 8, some), Column("r_name", "Alpha", 12, t["r_name"].to_pylist()),
    ], 0


#: Fixture name: (source table, order, columns and number of keys, block KiB).
FIXTURES: dict[str, tuple[str, list[str], Callable[[pa.Table], tuple[list[Column], int]], int]] = {
    "orders": ("orders", ["o_orderkey"], _orders, 2),
    "split_1": ("orders", ["o_orderkey"], _split("low"), 1),
    "split_2": ("orders", ["o_orderkey"], _split("odd"), 2),
    "split_3": ("orders", ["o_orderkey"], _split("even"), 1),
    "customer": ("customer", ["c_custkey"], _customer, 2),
    "nulls": ("customer", ["c_custkey"], _nulls, 2),
    "events": ("events", ["event_id"], _events, 4),
    "conversations": ("conversations", ["conv_id", "turn"], _conversations, 4),
    "documents": ("documents", ["doc_id"], _documents, 2),
    "lineitem": ("lineitem", ["l_orderkey", "l_linenumber"], _lineitem, 16),
    "unsupported": ("region", ["r_regionkey"], _unsupported, 1),
}
_made: set[tuple[str, str]] = set()


def _write_part(batches: Iterator[pa.RecordBatch], name: str, parts: str) -> Iterator[pa.RecordBatch]:
    """The rows of one task as a part; its name, place in the order, rows and bytes of blobs. Each attempt writes its own files."""
    build = FIXTURES[name][2]
    at = TaskContext.get().partitionId()
    part = Part(parts, own := f"{at}-{uuid.uuid4().hex}")
    part.put(build(pa.Table.from_batches([b]))[0] for b in batches if b.num_rows)
    yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([at]), pa.array([part.rows]), pa.array([part.blob_bytes])], ["part", "at", "n", "blob_bytes"])


def fixture(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The folder of a fixture, written when first asked for."""
    folder = f"{shared_dir(spark)}/fixtures-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    if (folder, name) not in _made:
        ship(spark)
        source, order, build, kib = FIXTURES[name]
        rows = table(spark, sf_dir, source)
        stamps = {c: F.col(c).cast("timestamp_ntz") for c, t in rows.dtypes if t.startswith("timestamp")}
        rows = rows.withColumns(stamps) if stamps else rows
        columns, keys = build(rows.limit(0).toArrow())
        parts = f"{folder}-parts/{name}-{uuid.uuid4().hex}"
        found = rows.orderBy(*order).mapInArrow(lambda batches: _write_part(batches, name, parts), "part string, at long, n long, blob_bytes long").collect()
        join_parts(folder, parts, name, columns, [(r["part"], r["n"], r["blob_bytes"]) for r in sorted(found, key=lambda r: r["at"])], keys, kib)
        fs, base = opened(parts)
        fs.delete_dir(base)
        _made.add((folder, name))
    return folder
