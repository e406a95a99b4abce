"""Line dedup, the toxicity chain, SentencePiece and the pipeline."""

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash

import corpus_pipeline
from tabularium.llm import line_dedup, near_dedup, sp_viterbi, toxicity
from tabularium.llm.arrow_text import raw

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def line_set(line):
    """The shingles of a normal line: five characters at every position."""
    return {line[k : k + 5] for k in range(max(1, len(line) - 4))}


def brute_lines(rows):
    """Components of lines with a similarity of 0.8 or more, by the smallest (doc_id, line number)."""
    lines = [((i, k), line_set(n)) for i, t in rows if t is not None for k, x in enumerate(t.split("\n")) if (n := x.lower().strip(" \t\r\f\v"))]
    root = {at: at for at, _ in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, s) in enumerate(lines):
        for b, t in lines[:k]:
            both = len(s & t)
            if both * 100 >= (len(s) + len(t) - both) * 80:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {at: find(at) for at, _ in lines}


def line_rows(seed):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randrange(2, 7))) for _ in range(200)]
    base = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(20, 60))) for _ in range(12)]
    rows = []
    for k in range(40):
        lines = []
        for _ in range(rnd.randrange(1, 6)):
            if rnd.random() < 0.5:
                words = rnd.choice(base).split(" ")
                if rnd.random() < 0.5:
                    words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
                lines.append(rnd.choice([" ".join(words), " ".join(words).upper() + " "]))
            else:
                lines.append(" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 40))))
        rows.append((k, "\n".join(lines)))
    return [*rows, (100, None), (101, ""), (102, "\n \n"), (103, "word\nword\n" + "x" * 5000), (104, "é" * 100), (105, "é" * 100 + "ö")]


def test_lines_against_brute_force(spark):
    rows = line_rows(1)
    got = line_dedup.line_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_lines(rows)
    assert {(r["doc_id"], r["line_no"]): (r["first_doc_id"], r["first_line_no"]) for r in got} == want
    assert all(r["kept"] == ((r["doc_id"], r["line_no"]) == (r["first_doc_id"], r["first_line_no"])) for r in got)


def test_rebuilt_documents(spark):
    rows = [(1, "one two three\nfour five six\n\nend", "k", "s", 33), (2, "ONE two three \nonly here now", "k", "s", 1), (3, "four five six\nend", "k", "s", 1), (4, None, "k", "s", 0), (5, "", "k", "s", 0), (6, "\n", "k", "s", 1)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", kept string")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in line_dedup.dedup_lines(frame).collect()}
    assert got == {1: ("one two three\nfour five six\n\nend", 33), 2: ("only here now", 13), 4: (None, 0), 5: ("", 0), 6: ("\n", 1)}
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).collect() == []


def test_rows_that_repeat_a_doc_id_are_documents_of_their_own(spark):
    rows = [(1, "alpha beta gamma delta\none only"), (1, "a wholly different text here\nmore of it"), (1, "alpha beta gamma delta\none only"), (2, "alpha beta gamma delta\nsome news"), (None, "one only")]
    got = sorted(map(tuple, line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    # Without an id a row is smallest and stays whole, so its line goes elsewhere; equal rows share their fate.
    assert got == sorted([(1, "alpha beta gamma delta"), (1, "alpha beta gamma delta"), (1, "a wholly different text here\nmore of it"), (2, "some news"), (None, "one only")], key=str)


def labelled_texts(n, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8)))
    texts, labels = [], []
    for _ in range(n):
        words = [word() for _ in range(rnd.randrange(5, 120))]
        junk, toxic = rnd.random() < 0.2, rnd.random() < 0.15
        if junk:
            words = [w.upper() + "!!" for w in words]
        for _ in range(rnd.randrange(2, 5) if toxic else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(["Grumblewort", "snarkle", "vexo" + word(), "blighter,"]))
        texts.append(" ".join(words))
        labels.append((float(junk), float(toxic)))
    return texts, np.array(labels)


def occurrences(texts):
    owner, feature, ratios = toxicity.features(*raw(pa.array(texts, pa.string())))
    owner, feature = toxicity.occurring(owner, feature, ratios)
    return [feature[owner == k] for k in range(len(texts))], ratios


def test_held_out_accuracy():
    texts, labels = labelled_texts(900, 1)
    chain = toxicity.fit_chain(*occurrences(texts), labels)
    new, truth = labelled_texts(500, 2)
    p = chain.probabilities(*raw(pa.array(new, pa.string())))
    for k in range(2):
        said, real = p[:, k] >= 0.5, truth[:, k] > 0
        assert (said & real).sum() / real.sum() > 0.95 and (said & ~real).sum() / (~real).sum() < 0.02
    # A later model reads the earlier one's probabilities.
    assert len(chain.models[1].mean) == len(chain.models[0].mean) + 1


def test_features_against_plain_counting():
    texts = ["Ab ab abcdef, ABCDEFG x1", "", "é" * 30, "--- !!"]
    rows, ratios = occurrences(texts)
    words = ["ab", "ab", "abcdef", "abcdefg", "x1"]
    counts = defaultdict(int)
    for w in words:
        counts["w", w] += 1
        for k in toxicity.BEGINNINGS:
            if len(w) > k:
                counts[k, w[:k]] += 1
    assert len(rows[0]) == sum(sum(c >= t for t in toxicity.LEVELS) + sum(c >= r * len(words) for r in toxicity.RATES) for c in counts.values())
    assert len(rows[1]) == len(rows[3]) == 0 and ratios[0, 0] == pytest.approx(8 / 24)


def test_toxicity_of_odd_rows(spark):
    texts, labels = labelled_texts(300, 3)
    docs = spark.createDataFrame([*((k, t) for k, t in enumerate(texts)), (1000, None), (1001, ""), (1002, "?!"), (1003, "snarkle grumblewort " * 20_000)], "doc_id long, text string")
    rows = [(k, int(a), int(b)) for k, (a, b) in enumerate(labels)] + [(0, None, None), (None, 1, 1), (5555, 1, 1)]
    marks = spark.createDataFrame(rows, "doc_id long, junk int, toxic int")
    chain = toxicity.train(docs, marks, ["junk", "toxic"])
    p = {r["doc_id"]: r["p_toxic"] for r in toxicity.score(docs, chain, ["junk", "toxic"]).collect()}
    assert p[1000] == p[1001] == p[1002] == 0 and p[1003] > 0.5
    kept = {r[0] for r in toxicity.keep_clean(docs, chain, 1).collect()}
    assert kept == {i for i, x in p.items() if x < 0.5}
    none = toxicity.train(docs, marks.filter("false"), ["junk", "toxic"])
    assert toxicity.keep_clean(docs, none, 1).count() == docs.count()
    assert toxicity.score(docs.filter("false"), none, ["junk", "toxic"]).collect() == []


MODEL = public_tokenizers.path("piece_bpe_32k.model")
SP_PARTS = [" ", "  ", "   ", "\n", "\t", "a", "the", "ing", "é", "中", "文", "12", "!", "<s>", "▁", " ", " ", "\r\n", "😀", "tion", "Th", "wh", "-", "_", "\x00", " " * 20]


@pytest.fixture(scope="module")
def model():
    return sp_viterbi.Pieces.load(MODEL)


def test_ids_are_sentencepiece_s(model, spark, sf):
    library, rnd = sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(4)
    texts = ["".join(rnd.choice(SP_PARTS) for _ in range(rnd.randrange(30))) for _ in range(1500)]
    texts += ["", " ", "a" * 300, "thetiontion" * 20, " " * 70 + "x", "中" * 100] + [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    got = model.encode(texts)
    assert [g.tolist() for g in got] == library.encode(texts)
    assert [model.decode(g) for g in got] == [library.decode(g.tolist()) for g in got]


def test_unigram_viterbi_against_all_segmentations():
    rnd = random.Random(5)
    texts = sorted({"".join(rnd.choice("ab▁") for _ in range(rnd.randrange(2, 4))) for _ in range(12)})
    table = [("<unk>", 0.0, 2), *((c, -rnd.random() * 5 - 2, 1) for c in "ab▁"), *((t, -rnd.random() * 5, 1) for t in texts if "▁" not in t[1:])]
    small = sp_viterbi.Pieces(table, bpe=False, dummy_prefix=False)
    score = {t: s for t, s, k in table if k == 1}
    for _ in range(60):
        word = "".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 9)))

        def best(w):
            return max((score[w[:k]] + best(w[k:]) for k in range(1, len(w) + 1) if w[:k] in score), default=float("-inf")) if w else 0.0

        ids = small.encode([word])[0]
        assert small.decode(ids) == word and sum(table[i][1] for i in ids) == pytest.approx(best(word))


def test_encoded_and_decoded_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "Some text,  twice", 1), (3, "Some text,  twice", 1)]
    ids = sp_viterbi.encoded(spark.createDataFrame(rows, "doc_id long, text string, ids int"), MODEL)
    assert sorted(map(tuple, sp_viterbi.decoded(ids, MODEL).collect())) == [(1, ""), (2, ""), (3, "Some text,  twice"), (3, "Some text,  twice")]
    trips = sp_viterbi.round_trips(spark.createDataFrame(rows, "doc_id long, text string, ids int"), MODEL).collect()
    assert all(r["decodes_back"] for r in trips) and len(trips) == 4


def test_pipeline_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(near_dedup.written(stage(spark, seen[-1], sf), f"test-{name}"))
    for d in seen[1:4]:
        assert d.columns == docs.columns
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in seen]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] == ids[4]
    # Stage by stage against brute force.
    rows = [(r["doc_id"], r["text"]) for r in seen[1].collect()]
    first = brute_lines(rows)
    want = {}
    for i, t in rows:
        lines = t.split("\n")
        left = [x for k, x in enumerate(lines) if first.get((i, k), (i, k)) == (i, k)]
        if len(left) == len(lines) or any(x.strip() for x in left):
            want[i] = "\n".join(left)
    assert {r["doc_id"]: r["text"] for r in seen[2].collect()} == want
    final = corpus_pipeline.run(spark, sf)
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, final.collect())) == sorted(map(key, seen[4].collect()))


def test_shingle_hash_is_spark_s(spark):
    """The line set's hash values are xxhash64 over the words, as the docstring's brute force assumes distinct ones."""
    got = spark.sql("select xxhash64('ab') as h").collect()[0]["h"]
    assert got == signed(xxhash.xxh64(b"ab", seed=42).intdigest())
