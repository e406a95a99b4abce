"""Range scans over tables that match a pattern."""

import pytest

from tabularium.operators import tables as T
from tabularium.plans import condition as C
from tabularium.sources import layout as L
from tabularium.testing.synth import Column, write_table


def test_each_table_is_pruned_by_its_own_index(spark, tmp_path):
    folder = str(tmp_path)
    for name, keys, indexed in (("part_a", range(0, 3000), 1), ("part_b", range(-40_000, 3000), 1), ("part_c", range(2000, 3000), 0)):
        write_table(folder, name, [Column("k", "Long", 4, list(keys))], keys=indexed, kib=1)
    found = {(r["_table"], r["k"]) for r in T.range_scan(spark, folder, "part_*", C.And(C.compare("k", ">=", 2500), C.compare("k", "<", 2510)), rowIds=True).collect()}
    assert found == {(t, k) for t in ("part_a", "part_b", "part_c") for k in range(2500, 2510)}
    # The first table holds no match at all.
    assert sorted(r["k"] for r in T.range_scan(spark, folder, "part_*", C.compare("k", "<", -39_997)).collect()) == [-40_000, -39_999, -39_998]
    # Still pruned: of the second table a few blocks are read.
    assert len(T.surviving(folder, "part_b", C.compare("k", "<", -39_997))) <= 2
    with pytest.raises(L.TableError, match="3 tables"):
        T.surviving(folder, "part_*", C.compare("k", "=", 1))
