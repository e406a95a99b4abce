"""Token counts and ids against the library; packing against a plain best-fit-decreasing and the rules of a packing."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tabularium.llm import packing, tokens
from tabularium.llm.arrow_text import raw
from tabularium.llm.bpe_fst import Transducer

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", " ", "  ", "\n", "\t", "a", "S", "é", "中", "١", "9", "12", "!", "?!", "<|endoftext|>", "<|endoftext", " ", "\r\n", "x'", "'l", "😀", "ß", "the", "ing", "²", "_", " ", "　"]


def random_texts(n, seed=1):
    rnd = random.Random(seed)
    some = ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(30))) for _ in range(n)]
    return [*some, "", "<|endoftext|>", "<|endoftext|><|endoftext|>", "a" * 5000, "é" * 300, " " * 700 + "x", "\n" * 40, "the" * 3000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def machine():
    return Transducer(PATH)


def test_ids_are_the_library_s(library, machine, spark, sf):
    texts = random_texts(1500) + [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    counts, ids = machine.texts(*raw(pa.array(texts, pa.string())), True)
    assert [i.tolist() for i in ids] == want
    assert counts.tolist() == [len(w) for w in want]


def test_a_small_table_of_transitions_gives_the_same(library):
    small, texts = Transducer(PATH, size=600), random_texts(60, 2)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert small.texts(*raw(pa.array(texts, pa.string())))[0].tolist() == want


def test_a_block_with_more_transitions_than_the_table(library):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(2, 12)))
    texts = [" ".join(word() for _ in range(3500)), "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(60_000))]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [i.tolist() for i in Transducer(PATH, size=2000).texts(*raw(pa.array(texts)), True)[1]] == want
    assert [i.tolist() for i in Transducer(PATH, size=40).texts(*raw(pa.array([t[:2000] for t in texts])), True)[1]] == [e.ids for e in library.encode_batch([t[:2000] for t in texts], add_special_tokens=False)]


def test_counts_of_odd_rows(spark, library):
    rows = [(1, None, 5), (2, "", 5), (3, "one two", 5), (3, "one two", 5), (None, "x", 5)]
    got = tokens.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), PATH).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 0, 0), (2, 0, 0), (3, 7, 2), (3, 7, 2), (None, 1, 1)], key=str)
    assert tokens.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def plain_best_fit(lengths, window):
    """The number of windows that one-by-one best fit decreasing opens, and their fills."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k in range(len(room)) if room[k] >= n]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= n
        else:
            room.append(window - n)
    return sorted(window - r for r in room)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    window = rnd.choice([10, 64, 100])
    lengths = [rnd.choice([rnd.randint(1, window), rnd.randint(1, max(1, window // 4)), 3]) for _ in range(rnd.choice([1, 40, 400]))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.best_fit_decreasing(counts, window)
    at, placed = defaultdict(list), defaultdict(int)
    for length, rank, count, first, offset in plan.tolist():
        assert rank == placed[length]
        placed[length] += count
        for k in range(count):
            at[first + k].append((offset, length))
    assert dict(placed) == counts
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window
    assert sorted(sum(n for _, n in parts) for parts in at.values()) == plain_best_fit(lengths, window)
    assert sorted(at) == list(range(len(at)))


def test_packed_documents(spark, library, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(90001, None), (90002, ""), (90003, "word " * 9000), (90004, "<|endoftext|>")]
    got = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), PATH, with_ids=True).collect()
    pieces, filled = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id, text in docs:
        want = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        end = 0
        for r in sorted(pieces[doc_id], key=lambda r: r["start"]):
            part = want[end : end + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids_crc32"], r["ids"]) == (end, len(want), zlib.crc32(part.tobytes()), part.tolist())
            end += r["length"]
        assert end == len(want)
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(r["length"] for r in got)
    assert len(filled) <= total / 2048 * 1.05 + 1


def test_no_documents_and_clashing_columns(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    rows = spark.createDataFrame([(1, "a", 9, 9), (1, "a", 9, 9)], "doc_id long, text string, start long, sequence_id int")
    packed = packing.pack_documents(rows, PATH)
    assert sorted((r["doc_id"], r["length"], r["offset"]) for r in packed.collect()) == [(1, 2, 0), (1, 2, 2)]
    assert [tuple(r) for r in packing.sequences(packed).collect()] == [(0, 2, 4, 4)]
