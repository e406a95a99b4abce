"""Token counts by compiled finite-state transducers (bpe_fst). A null text counts as empty; every row gives a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .arrow_text import WIDE_BYTES, blocks
from .bpe_fst import transducer


def token_counts(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) of every whole text, as the tokenizer file's library counts them without added tokens."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer)
        for batch in batches:
            for rows, data, offsets in blocks(batch, "text", WIDE_BYTES):
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offsets)), pa.array(machine.texts(data, offsets)[0])], ["key", "n_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text")).mapInArrow(count, f"key {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens")
