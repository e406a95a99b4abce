"""Packing by best-fit decreasing.

Texts become token ids and an end id; overlong ones are first cut into full windows. What remains of each has one of
window - 1 lengths, so best fit decreasing runs once over the histogram of lengths: a segment tree indexed by remaining
capacity finds the tightest open windows, and all items of a length that go to windows of one capacity are placed by a
single entry. The plan's size depends on the window alone (at most about window * ln(window) groups of windows, each
with fewer than sqrt(2 * window) lengths), never on the number of documents; each piece then finds its entry by its
rank among the pieces of its length. Ranks are counted by (length, salt), so a length that many pieces share is dealt
over many tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import setting, ship, written
from .arrow_text import WIDE_BYTES, blocks
from .bpe_fst import transducer

WINDOW, END_ID = 2048, 1


def token_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): every document's ids and end id in full windows and a rest. A null text is empty."""
    ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer)
        for batch in batches:
            for rows, data, offsets in blocks(batch, "text", WIDE_BYTES):
                row, start, length, crc, total, parts = [], [], [], [], [], []
                for k, ids in enumerate(machine.texts(data, offsets, True)[1]):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for a in range(0, len(ids), window):
                        part = ids[a : a + window]
                        row.append(k)
                        start.append(a)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        total.append(len(ids))
                        if with_ids:
                            parts.append(part.astype(np.int32))
                columns = [rows.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(parts, pa.list_(pa.int32()))] * with_ids, names + ["ids"] * with_ids)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


class Capacities:
    """A segment tree over remaining capacities: where the tightest open windows are."""

    def __init__(self, top: int) -> None:
        self.size = 1 << top.bit_length()
        self.open = [False] * (2 * self.size)
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]

    def _mark(self, capacity: int) -> None:
        at = capacity + self.size
        self.open[at] = bool(self.groups[capacity])
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def put(self, capacity: int, first: int, count: int) -> None:
        """count windows, numbered from first, have this much room."""
        if capacity > 0 and count > 0:
            self.groups[capacity].append((first, count))
            self._mark(capacity)

    def take(self, capacity: int) -> tuple[int, int]:
        group = self.groups[capacity].pop()
        self._mark(capacity)
        return group

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least `least` with open windows."""
        at = least + self.size
        while not self.open[at]:
            while at & 1:  # a right child: go up until there is a sibling to the right
                at //= 2
            if at == 0:
                return None
            at += 1
            if at & (at - 1) == 0:  # past the right edge of a level
                return None
        while at < self.size:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.size


def best_fit_decreasing(counts: dict[int, int], window: int = WINDOW) -> np.ndarray:
    """Rows (length, first rank, count, first sequence, offset): pieces of a length with these ranks go to so many consecutive sequences, at this offset."""
    plan, tree, sequences = [], Capacities(window), 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first = window, sequences
                bins = -(-left // (window // length))
                sequences += bins
            else:
                first, bins = tree.take(capacity)
            # Best fit goes on filling a window it has begun while the length still fits.
            most = capacity // length
            full = min(bins, left // most)
            for layer in range(most if full else 0):
                plan.append((length, rank, full, first, window - capacity + layer * length))
                rank += full
            left -= full * most
            tree.put(capacity - most * length, first, full)
            rest = left if full < bins and left < most else 0
            for layer in range(rest):
                plan.append((length, rank, 1, first + full, window - capacity + layer * length))
                rank += 1
            left -= rest
            if rest:
                tree.put(capacity - rest * length, first + full, 1)
            tree.put(capacity, first + full + (rest > 0), bins - full - (rest > 0))
    return np.array(plan, np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """The pieces with (sequence_id, offset). pieces is read several times: a written table is best. No piece, no row."""
    spark = pieces.sparkSession
    ship(spark)
    # At most `window` rows come to the driver.
    plan = best_fit_decreasing({int(r["length"]): int(r["count"]) for r in pieces.groupBy("length").count().collect()}, window)
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    plan = plan[order]
    salts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    by_salt = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    before = salted.groupBy("length", "__salt").count().select("length", "__salt", F.coalesce(F.sum("count").over(by_salt), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "start", "ids_crc32"))
    ranked = salted.withColumn("__place", place).join(before, ["length", "__salt"]).withColumn("__rank", F.col("__before") + F.col("__place") - 1)
    columns = pieces.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (plan[:, 0] << 44) + plan[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "__rank"))
            at = np.searchsorted(key, (length << 44) + rank, "right") - 1
            sequence = plan[at, 3] + rank - plan[at, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(sequence), pa.array(plan[at, 4])], [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.select(*columns, "__rank").mapInArrow(assign, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Documents (doc_id, text) packed into sequences of at most `window` tokens: one row a piece."""
    # A batch is little more than a block: batches of 10,000 rows would lie in a worker and its executor several times over.
    with setting(docs.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", WIDE_BYTES * 15 // 16):
        pieces = written(token_pieces(docs, tokenizer, window, end_id, with_ids), "pieces")
    return pack(pieces, window)


def sequences(packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """(sequence_id, n_pieces, n_tokens, padded_length): a fill that is a power of two stays, any other is padded to the window."""
    n = F.sum("length")
    whole = F.when(F.bit_count(n) == 1, n).otherwise(F.lit(window)).cast("long")
    return packed.groupBy("sequence_id").agg(F.count("*").alias("n_pieces"), n.alias("n_tokens"), whole.alias("padded_length"))
