"""Files read as streams of bytes."""

import numpy as np

from tabularium.streaming.arrivals import decoded_files, stream_rows
from tabularium.testing.synth import Column, write_table


def test_streams_are_decoded_a_few_blocks_at_a_time(tmp_path):
    write_table(str(tmp_path), "t", [Column("k", "Long", 4, np.arange(5000))], kib=1)
    with open(tmp_path / "t.db", "rb") as f:
        found = list(stream_rows(f, at_once=4096))
    assert len(found) > 2 and [k for b in found for k in b.column(0).to_pylist()] == list(range(5000))


def test_files_are_read_by_path_or_content(spark, tmp_path):
    write_table(str(tmp_path / "a b"), "t", [Column("k", "Long", 4, np.arange(500))], kib=1)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.db").load(str(tmp_path / "a b"))
    for some in (found, found.select("path")):
        assert sorted(r["k"] for r in decoded_files(some, "k int").collect()) == list(range(500))
