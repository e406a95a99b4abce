"""Fixtures are encoded by executors and joined in one file, whatever their size."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabularium.operators import tables as T
from tabularium.sources import files
from tabularium.testing import fixtures, synth
from tabularium.testing.synth import Column, Part, join_parts, write_table


def test_the_driver_collects_no_rows(spark, sf, monkeypatch):
    seen = []
    real = DataFrame.toArrow
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: seen.append(out := real(self)) or out)
    monkeypatch.setattr(fixtures, "_made", set())
    for name in ("lineitem", "orders", "split_2", "documents", "unsupported"):
        fixtures.fixture(spark, sf, name)
    assert sum(x.num_rows for x in seen) == 0


def test_parts_join_to_the_table_that_is_written_whole(tmp_path):
    n = 700
    texts = [None if k % 5 == 0 else f"é{k}" * (k % 90) for k in range(n)]
    columns = lambda a, b: [Column("k", "Long", 4, list(range(a, b))), Column("s", "Alpha", 9, pa.chunked_array([[f"ü{k}" for k in range(a, b)]], pa.string())), Column("b", "Blob", 10, texts[a:b])]
    write_table(str(tmp_path / "whole"), "t", columns(0, n), keys=1, kib=1)
    parts = []
    for cuts in ([0, 3, 250], [250], [250, 251], [251, n]):
        part = Part(str(tmp_path / "parts"), f"p{len(parts)}")
        part.put(columns(a, b) for a, b in zip(cuts, cuts[1:]))
        parts.append((f"p{len(parts)}", part.rows, part.blob_bytes))
    join_parts(str(tmp_path / "joined"), str(tmp_path / "parts"), "t", columns(0, 0), parts, 1, 1)
    read = {}
    for at in ("whole", "joined"):
        data, index, blobs = (str(tmp_path / at / f"t.{x}") for x in ("db", "PX", "MB"))
        header = files.read_header(data)
        rows = np.concatenate([r for r, _, _ in files.records(data, header, 0, header.file_blocks)])
        read[at] = (header, rows[:, :13].tolist(), files.Blobs(blobs)(rows[:, 13:]), open(index, "rb").read())
    assert read["whole"] == read["joined"]
    assert read["joined"][2] == [t.encode() if t else None for t in texts]


def test_blocks_grow_before_a_file_has_more_of_them_than_it_can_number(spark, tmp_path, monkeypatch):
    assert synth.fitting_kib(65535 * 56, 36, 2) == 2
    assert synth.fitting_kib(65535 * 56 + 1, 36, 2) == 4
    assert synth.fitting_kib(36_000_000, 52, 16) == 32
    monkeypatch.setattr(synth, "MOST_BLOCKS", 40)
    part = Part(str(tmp_path / "parts"), "p")
    part.put([[Column("k", "Long", 4, np.arange(30_000))]])
    join_parts(str(tmp_path), str(tmp_path / "parts"), "t", [Column("k", "Long", 4, [])], [("p", part.rows, 0)], 1, 1)
    assert files.read_header(str(tmp_path / "t.db")).block_kib == 4
    assert sorted(r["k"] for r in T.read_table(spark, str(tmp_path), "t").collect()) == list(range(30_000))
