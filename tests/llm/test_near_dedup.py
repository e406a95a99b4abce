"""Near-dedup against brute force over all pairs, and its defined results for odd rows."""

import random
import re

import pytest

from tabularium.llm import near_dedup

SCHEMA = "doc_id long, text string"


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} if 0 < len(words) < 4 else {tuple(words[k : k + 4]) for k in range(len(words) - 3)}


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def found(spark, rows):
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out}


def texts(seed, n=150):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randrange(2, 7))) for _ in range(300)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(60))
    rows = []
    for k in range(n):
        kind = rnd.random()
        if rows and kind < 0.5:  # an edited copy, close to the threshold now and then
            words = (rnd.choice(rows)[1] or "x").split(" ")
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            rows.append((k, rnd.choice([" ", "\n", "\t "]).join(words)))
        elif kind < 0.7:
            rows.append((k, passage + " " + " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(5, 120)))))
        else:
            rows.append((k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 200)))))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rows = [*texts(seed), (900, None), (901, ""), (902, " \n\t"), (903, "One two"), (904, "one TWO"), (905, "one two three")]
    assert found(spark, rows) == brute(rows)


def test_chain_reaches_the_smallest_id(spark):
    base = [f"w{k}" for k in range(400)]
    rows = [(100 - k, " ".join(f"x{j}" if j < 15 * k else w for j, w in enumerate(base))) for k in range(12)]
    got = found(spark, rows)
    assert got == brute(rows)
    assert {r[1] for r in got.values()} == {89}


def test_documents_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert found(spark, rows) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, kept string, n_shingles int, id string")
    assert near_dedup.near_duplicates(empty).collect() == []
    rows = [(1, "a b c d e", "x", 1), (1, "a b c d e", "x", 1), (2, "a b c d e", "y", 2)]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, kept string, component_id int"))
    assert sorted(map(tuple, out.collect())) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]


def test_rows_without_an_id_are_kept(spark, sf):
    import corpus_pipeline

    rows = [(None, "a b c d e", "en", "s", 9), (None, "x y", "en", "s", 3), (3, "a b c d e", "en", "s", 9), (4, "a b c d e", "en", "s", 9), (5, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.without_near_copies(spark, docs, sf)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted((r for r in rows if r[0] != 4), key=str)
