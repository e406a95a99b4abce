"""The sieve goes before shuffles, and keys are dealt some at a time."""

from pyspark.sql import functions as F

from tabularium.llm import line_dedup, near_dedup
from tabularium.llm.sieve import sifted


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_what_the_sieve_leaves_out_is_all_the_rest(spark):
    rows = spark.createDataFrame([(k if k % 7 else None, f"t{k}") for k in range(300)], "k int, t string")
    for wanted in (spark.range(50, 90).select(F.col("id").cast("int").alias("k")), spark.createDataFrame([], "k int")):
        inside, rest = (sifted(rows, F.col("k"), wanted, F.col("k"), inside=x).collect() for x in (True, False))
        assert sorted(r["t"] for r in inside + rest) == sorted(f"t{k}" for k in range(300))
        assert {r["k"] for r in wanted.collect() if r["k"] % 7} <= {r["k"] for r in inside} and None not in {r["k"] for r in inside}


def test_no_semi_join_moves_below_the_sieve(spark, monkeypatch):
    ids, docs = spark.range(5), spark.createDataFrame([(k, "a b c d e") for k in range(9)], "doc_id long, text string")
    assert "LeftSemi" not in optimised(near_dedup.shared_shingles(ids, docs))
    monkeypatch.setattr(line_dedup, "made", lambda df, name: df)
    texts = line_dedup.texts_of(line_dedup.lines_of(docs), line_dedup.lines_of(docs).select("f1").distinct())
    assert "LeftSemi" not in optimised(texts) and texts.columns == ["f1", "f2", "norm"]
    assert len(texts.collect()) == 1


def test_keys_dealt_some_at_a_time_are_all_keys(spark):
    signs = spark.range(4).select(F.col("id").alias("f1"), *[F.xxhash64(F.lit(k), F.col("id") % 3).bitwiseAND(F.lit(sum(0x7FF << 12 * r for r in range(5)))).alias(f"s{k}") for k in range(5)])
    parts = [tuple(r) for a in range(0, 30, line_dedup.AT_ONCE) for r in line_dedup.band_keys(signs, a, a + line_dedup.AT_ONCE - 1).collect()]
    assert sorted(parts) == sorted(map(tuple, line_dedup.band_keys(signs).collect()))
    got = line_dedup.shared_keys(signs).collect()
    assert {r["f1"] for r in got} == {0, 3} and len(got) == 60 and {(r["low"], r["high"], r["size"]) for r in got} == {(0, 3, 2)}
    signed = spark.createDataFrame([(1, list(range(16)))], "id long, signature array<long>")
    some = [tuple(r) for a in range(0, 64, near_dedup.AT_ONCE) for r in near_dedup.index_keys(signed, a, a + near_dedup.AT_ONCE - 1).collect()]
    assert sorted(some) == sorted(map(tuple, near_dedup.index_keys(signed).collect()))
