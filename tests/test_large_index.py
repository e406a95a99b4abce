"""Indexes of files with many blocks."""

import numpy as np

from tabularium.operators import tables as T
from tabularium.plans import condition as C
from tabularium.plans import descent
from tabularium.sources import files
from tabularium.testing.synth import Column, write_table


def test_the_block_whose_pointer_is_stored_as_zeros(tmp_path):
    """32,768 is stored as two zero bytes; in a smaller file those point nowhere (test_index_that_points_nowhere)."""
    n = 127 * 33_000
    write_table(str(tmp_path), "t", [Column("k", "Long", 4, np.arange(n)), Column("n", "Long", 4, np.arange(n))], keys=1, kib=1)
    header = files.read_header(str(tmp_path / "t.db"))
    assert header.file_blocks == 33_000
    at = 127 * 32_767 + 5
    assert descent.blocks_for(C.compare("k", "=", at), str(tmp_path / "t.PX"), header) == [32_767]
    assert descent.blocks_for(C.And(), str(tmp_path / "t.PX"), header) == list(range(33_000))


def test_entries_of_the_lowest_levels(spark, tmp_path):
    """The root's own entries are those of the level on top."""
    n, keys = 25_000, 5
    columns = [Column(f"k{k}", "Number", 8, np.arange(n) * 1.0) for k in range(keys)]
    write_table(str(tmp_path), "t", columns, keys=keys, kib=1)
    header = files.read_header(str(tmp_path / "t.PX"))
    assert header.levels == 3
    entries = [T.read_index(spark, str(tmp_path), "t", levels=k).count() for k in (1, 2, 3)]
    assert entries[0] == files.read_header(str(tmp_path / "t.db")).file_blocks
    assert entries[0] < entries[1] < entries[2] == T.read_index(spark, str(tmp_path), "t").count()
    assert entries[2] - entries[1] == header.file_blocks - 1 - len(descent.level_blocks(str(tmp_path / "t.PX"), 1))
