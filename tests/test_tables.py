"""Tables end to end: the scan, pruning, views, cursor and damaged files."""

import random
import shutil
from pathlib import Path

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tabularium.operators import tables as T
from tabularium.plans import condition as C
from tabularium.plans import descent
from tabularium.sources import files
from tabularium.sources import layout as L
from tabularium.streaming.arrivals import arriving
from tabularium.testing.synth import Column, write_table

OPS = ["=", "<>", ">", ">=", "<", "<="]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """keyed: duplicate leading keys over many small blocks and three index levels; heap: the same without an index."""
    path = str(tmp_path_factory.mktemp("tables"))
    rnd = random.Random(1)
    keys = sorted((rnd.randrange(0, 4000), k) for k in range(9000))
    columns = [Column("k", "Long", 4, [a for a, _ in keys]), Column("n", "Long", 4, [b for _, b in keys]), Column("x", "Number", 8, [None if b % 9 == 0 else b / 4 for _, b in keys]), Column("s", "Alpha", 40, [f"s{b % 50:02d}" for _, b in keys])]
    write_table(path, "keyed", columns, keys=4, kib=1)
    write_table(path, "heap", columns, kib=1)
    texts = sorted(f"t{k:04d}" for k in range(600))
    write_table(path, "named", [Column("s", "Alpha", 6, texts), Column("v", "Short", 2, list(range(600)))], keys=1, kib=1)
    return path


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("column", ["k", "n", "s"])
@pytest.mark.parametrize("op", OPS)
def test_pruned_is_unpruned(spark, folder, column, op):
    value = {"k": 1700, "n": 4500, "s": "s17"}[column]
    condition = C.compare(column, op, value)
    want = rows(T.read_table(spark, folder, "heap").filter(condition.column()))
    assert rows(T.range_scan(spark, folder, "keyed", condition)) == want


def holds(node, k):
    if isinstance(node, C.And):
        return all(holds(c, k) for c in node.children)
    if isinstance(node, C.Or):
        return any(holds(c, k) for c in node.children)
    v = node.value
    return {"=": k == v, "<>": k != v, ">": k > v, ">=": k >= v, "<": k < v, "<=": k <= v}[node.op.value]


def random_tree(rnd, depth):
    if depth == 0 or rnd.random() < 0.4:
        return C.compare("k", rnd.choice(OPS), rnd.randrange(-10, 4010))
    return rnd.choice([C.And, C.Or])(random_tree(rnd, depth - 1) for _ in range(rnd.randrange(0, 4)))


def test_descent_keeps_every_block_that_holds_rows(folder):
    path, index = f"{folder}/keyed.db", f"{folder}/keyed.PX"
    header = files.read_header(path)
    assert files.read_header(index).levels == 3
    from tabularium.sources import codec

    by_block = {}
    for data, block, _ in files.records(path, header, 0, header.file_blocks):
        for b, k in zip(block.tolist(), codec.decode(header.fields[0], data).to_pylist(), strict=True):
            by_block.setdefault(b, []).append(k)
    rnd = random.Random(2)
    for _ in range(400):
        tree = random_tree(rnd, 3)
        kept = set(descent.blocks_for(tree, index, header))
        assert {b for b, ks in by_block.items() if any(holds(tree, k) for k in ks)} <= kept
    few = descent.blocks_for(C.compare("k", "=", 1700), index, header)
    assert 0 < len(few) <= 3 < header.file_blocks / 50
    outer = descent.blocks_for(C.Or(C.compare("k", "<", 20), C.compare("k", ">", 3980)), index, header)
    assert len(outer) < header.file_blocks / 20


def test_empty_nodes_and_unknown_operators():
    assert descent.ranges([0, 1, 2, 7]) == "0-2,7" and descent.parse_ranges("0-2,7") == [(0, 3), (7, 8)] and descent.parse_ranges("") == []
    assert C.And().may_hold("k", 1, 2) and not C.Or().may_hold("k", 1, 2)
    with pytest.raises(ValueError):
        C.Compare("k", "~", 1)
    with pytest.raises(ValueError):
        C.compare("k", "~", 1)


def test_null_keys_and_null_values():
    eq = C.compare("k", "=", 5)
    assert eq.may_hold("k", None, 6) and not eq.may_hold("k", None, None) and not C.compare("k", "=", None).may_hold("k", 1, 9)
    assert C.compare("k", "<", 5).may_hold("k", None, C.UNBOUNDED) and C.compare("k", "=", "5").may_hold("k", 1, 2)
    assert C.compare("K", "=", 5).may_hold("k", 9, 12) is False and C.compare("other", "=", 5).may_hold("k", 9, 12)


def test_text_keys_prune_only_if_trusted(spark, folder):
    condition = C.compare("s", "=", "t0300")
    assert T.surviving(folder, "named", condition) is None
    assert len(T.surviving(folder, "named", condition, trust_string_order=True)) <= 2
    assert rows(T.range_scan(spark, folder, "named", condition, trustStringOrder=True)) == [("t0300", 300)] == rows(T.range_scan(spark, folder, "named", condition))


def test_pushed_filters_prune(spark, folder):
    df = T.read_table(spark, folder, "keyed", pushdown=True, partitionBytes=1024)
    heap = T.read_table(spark, folder, "heap")
    for where in (F.col("k") == 1700, (F.col("k") >= 100) & (F.col("k") < 130) & (F.col("s") != "s07"), F.col("k").isin(5, 6, 3999), F.col("x").isNull() & (F.col("k") > 3900)):
        assert rows(df.filter(where)) == rows(heap.filter(where))
    assert df.filter(F.col("k") == 1700).rdd.getNumPartitions() <= 3 < df.rdd.getNumPartitions()
    assert df.count() == 9000 and df.columns == ["k", "n", "x", "s"]  # what an earlier query pruned doesn't stick


def test_scans(spark, folder):
    df = T.read_table(spark, folder, "HEAP", rowIds=True, partitionBytes=8192)
    assert df.rdd.getNumPartitions() > 10 and df.count() == 9000
    first = T.first_rows(df, 5).collect()
    assert [(r["_block"], r["_rec"]) for r in first] == [(0, k) for k in range(5)]
    assert rows(T.scan(df, lambda r: r["k"] < 9)) == rows(T.scan(df, C.compare("k", "<", 9))) == rows(T.scan(df, F.col("k") < 9))
    assert T.scan(df) is df
    ordered = T.range_scan(spark, folder, "keyed", C.compare("k", "<", 50), ordered=True).select("k", "n").collect()
    assert ordered == sorted(ordered) and T.key_columns(folder, "keyed") == ["k", "n", "x", "s"] and T.key_columns(folder, "heap") == []
    assert T.read_table(spark, folder, "keyed", columns=["S", "k"]).columns == ["s", "k"]


def test_leading_rows_read_their_blocks_only(spark, folder, tmp_path):
    whole = T.in_physical_order(T.read_table(spark, folder, "heap", rowIds=True))
    for n in (0, 1, 16, 17, 400, 9000, 9999):
        found = T.leading_rows(spark, folder, "heap", n)
        assert found.collect() == whole.limit(n).collect()
    path = files.companions(folder, "heap")[0][1]
    header = files.header_of(path)
    per = (header.block_size - L.BLOCK_HEAD) // header.record_size
    assert [files.leading_blocks(path, header, n) for n in (1, per, per + 1)] == [(1, 1), (1, per), (2, per + 1)]
    for k, n in enumerate((3, 0, 500, 4)):
        write_table(str(tmp_path), f"part{k}", [Column("v", "Long", 4, [1000 * k + j for j in range(n)])], kib=1)
    got = [(r["_table"], r["v"]) for r in T.leading_rows(spark, str(tmp_path), "part*", 300).collect()]
    assert got == [("part0", j) for j in range(3)] + [("part2", 2000 + j) for j in range(297)]
    assert T.leading_rows(spark, str(tmp_path), "part1", 5).collect() == []


def test_views(spark, folder):
    meta = T.read_meta(spark, folder, "keyed").collect()[0]
    assert (meta["record_count"], meta["has_index"], meta["has_blobs"], meta["field_types"]) == (9000, True, False, ["Long", "Long", "Number", "Alpha"])
    index = T.read_index(spark, folder, "keyed")
    assert index.columns == ["k", "n", "x", "s", "child_block", "x1", "x2", "_block", "_rec"]
    assert index.schema["k"].metadata == {"srcType": "Long", "srcSize": 4}


def test_many_tables_at_once(spark, tmp_path):
    for k in range(3):
        write_table(str(tmp_path), f"part{k}", [Column("v", "Long", 4, [k, k + 10])])
    df = T.read_table(spark, str(tmp_path), "part*", rowIds=True)
    assert rows(df.select("v", "_table")) == rows(spark.createDataFrame([(k + d, f"part{k}") for k in range(3) for d in (0, 10)]))
    write_table(str(tmp_path), "part9", [Column("w", "Long", 4, [1])])
    with pytest.raises(PySparkException, match="another schema"):
        T.read_table(spark, str(tmp_path), "part*").collect()


def test_cursor(spark, folder):
    cursor = T.Cursor(T.range_scan(spark, folder, "keyed", C.compare("k", "<", 3), ordered=True))
    with pytest.raises(ValueError):
        cursor[0]
    assert (cursor.field_count, cursor.name(1), cursor.ordinal("N"), cursor.ordinal("nope"), cursor.source_type(0)) == (4, "n", 1, -1, "Long")
    seen = []
    while cursor.read():
        seen.append(cursor.values())
        assert cursor["K"] == cursor[0] and cursor.is_null(2) == (cursor["x"] is None)
    assert not cursor.read() and seen == [tuple(r) for r in T.range_scan(spark, folder, "keyed", C.compare("k", "<", 3), ordered=True).collect()]
    with pytest.raises(KeyError):
        T.Cursor(spark.range(1))["nope"]
    with T.Cursor(spark.range(9)) as open_cursor:
        assert open_cursor.read() and open_cursor.read()
    assert not open_cursor.read() and open_cursor.current is None


def write(path, name="t", **options):
    write_table(str(path), name, [Column("a", "Long", 4, [1, 2, 3]), Column("z", "Alpha", 4, ["full", "b", None])], **options)


def test_versions_and_last_field(spark, tmp_path):
    for version in (3, 5, 0x0B, 0x0C):
        write(tmp_path, f"v{version}", version=version)
        assert rows(T.read_table(spark, str(tmp_path), f"v{version}")) == [(1, "full"), (2, "b"), (3, None)]


def test_empty_tables_and_blocks(spark, tmp_path):
    write_table(str(tmp_path), "none", [Column("a", "Long", 4, [])], keys=1)
    assert T.read_table(spark, str(tmp_path), "none").collect() == []
    assert T.surviving(str(tmp_path), "none", C.compare("a", "=", 1)) is None  # no levels: a full scan
    write(tmp_path)
    data = bytearray((tmp_path / "t.db").read_bytes())
    at = files.read_header(str(tmp_path / "t.db")).header_size
    data[at + 4 : at + 6] = (-8).to_bytes(2, "little", signed=True)
    (tmp_path / "t.db").write_bytes(data)
    assert T.read_table(spark, str(tmp_path), "t").collect() == []


def test_companions(tmp_path):
    write(tmp_path, "ab2", keys=1)
    write(tmp_path, "ab")
    (tmp_path / "AB.mb").write_bytes(b"")
    assert files.companions(str(tmp_path), "ab")[0][2:] == (None, f"{tmp_path}/AB.mb")
    (tmp_path / "ab.px").write_bytes(b"")
    assert files.companions(str(tmp_path), "AB")[0][2] == f"{tmp_path}/ab.px"
    with pytest.raises(L.TableError):
        files.companions(str(tmp_path), "abc")


def test_damaged_files(spark, tmp_path):
    write_table(str(tmp_path), "cut", [Column("a", "Long", 4, list(range(2000)))], kib=1)
    whole = (tmp_path / "cut.db").read_bytes()
    (tmp_path / "cut.db").write_bytes(whole[:-100])
    with pytest.raises(PySparkException, match="ends within"):
        T.read_table(spark, str(tmp_path), "cut").collect()
    assert 1500 < T.read_table(spark, str(tmp_path), "cut", mode="PERMISSIVE").count() < 2000
    write(tmp_path, "locked", encryption=7)
    with pytest.raises(PySparkException, match="encrypted"):
        T.read_table(spark, str(tmp_path), "locked")
    with pytest.raises(L.TableError):
        L.parse(whole[:40])
    with pytest.raises(L.TableError):
        L.parse(whole[:100])
    with pytest.raises(PySparkException, match="no column"):
        T.read_table(spark, str(tmp_path), "cut", columns="b")
    with pytest.raises(PySparkException):
        T.read_table(spark, str(tmp_path), "cut", view="index")


def test_index_that_points_nowhere(tmp_path):
    write_table(str(tmp_path), "t", [Column("a", "Long", 4, list(range(3000)))], keys=1, kib=1)
    index, header = tmp_path / "t.PX", files.read_header(str(tmp_path / "t.db"))
    data = bytearray(index.read_bytes())
    at = files.read_header(str(index)).header_size + 6 + 4
    for raw, message in ((b"\0\0", "nowhere"), (b"\xff\xff", "beyond")):
        data[at : at + 2] = raw
        index.write_bytes(data)
        with pytest.raises(L.TableError, match=message):
            descent.blocks_for(C.And(), str(index), header)


def test_blobs(spark, tmp_path):
    values = [b"x" * 5000, None, b"", b"small", b"\0\0"]
    write_table(str(tmp_path), "b", [Column("k", "Long", 4, [1, 2, 3, 4, 5]), Column("v", "Blob", 10, values)], keys=1)
    got = {r["k"]: r["v"] for r in T.read_table(spark, str(tmp_path), "b").collect()}
    assert got == {1: values[0], 2: None, 3: None, 4: b"small", 5: b"\0\0"}
    (tmp_path / "b.MB").unlink()
    assert {r["v"] for r in T.read_table(spark, str(tmp_path), "b").collect()} == {None}


def test_neighbouring_blobs_share_reads(spark, tmp_path, monkeypatch):
    rnd = random.Random(5)
    values = [rnd.randbytes(rnd.choice((3, 40, 900, 5000))) for _ in range(300)] + [rnd.randbytes(files.SMALL + 7)]
    write_table(str(tmp_path), "many", [Column("k", "Long", 4, list(range(1, 302))), Column("v", "Blob", 10, values)], keys=1)
    path = files.companions(str(tmp_path), "many")[0]
    header = files.header_of(path[1])
    references = np.concatenate([r for r, _, _ in files.records(path[1], header, 0, header.file_blocks)])[:, 4:14]
    blobs = files.Blobs(path[3])
    reads = []
    monkeypatch.setattr(blobs, "file", type("Counted", (), {"read_at": lambda _, n, at, f=blobs.file: reads.append(n) or f.read_at(n, at)})())
    backwards = blobs(np.ascontiguousarray(references[::-1]))
    assert backwards == values[::-1] and len(reads) < 8 and max(reads) <= files.READ
    wrong = references.copy()
    wrong[0, 4:8] = [255, 255, 255, 127]  # a size beyond the file
    wrong[1, 4:8] = [9, 0, 0, 0]  # a size that the blob's head denies
    assert blobs(wrong)[:2] == [None, None] and blobs(wrong)[2:] == values[2:]


def test_large_offsets_stay_exact():
    assert L.Header(8, 2048, 2, 255, 0, 65535, 0, 0, 12, 0, None, "t").block_at(65534) == 2048 + 65534 * 255 * 1024 > 1 << 31


def test_streamed_files(spark, tmp_path):
    source, parts = tmp_path / "in", tmp_path / "made"
    source.mkdir()
    write(parts)
    shutil.copy(parts / "t.db", source / "one.db")
    query = arriving(spark, str(source), "a int, z string").writeStream.format("memory").queryName("arrived").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    assert rows(spark.table("arrived")) == [(1, "full"), (2, "b"), (3, None)]


def test_registered_queries(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 11
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_training_data_operators():
    root = Path(__file__).resolve().parents[1]
    own = [p for p in (root / "tabularium").rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert not [p for p in own if ".llm" in p.read_text() or "corpus_pipeline" in p.read_text()]
