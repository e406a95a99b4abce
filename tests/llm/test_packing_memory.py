"""What a worker holds while it packs: arrays of one block, and batches of about a block."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from tabularium.llm import packing
from tabularium.llm.arrow_text import WIDE_BYTES, raw
from tabularium.llm.bpe_fst import Transducer
from tabularium.runtime import setting

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_arrays_of_a_block_and_parts_that_begin_anywhere(monkeypatch):
    texts = ["the people of the town, é and 中 <|endoftext|> it's " * 40, "", "word " * 400, "x" * 3000] * 450
    data, offsets = raw(pa.array(texts, pa.string()))
    machine = Transducer(PATH)
    machine.texts(*raw(pa.array(texts[:4], pa.string())), True)  # transitions are compiled
    tracemalloc.start()
    counts, ids = machine.texts(data, offsets, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 28 * len(data), peak / len(data)
    monkeypatch.setattr("tabularium.llm.bpe_fst.PART", 100)
    again, other = machine.texts(data, offsets, True)
    assert (counts == again).all() and all((a == b).all() for a, b in zip(ids, other, strict=True))
    one = [machine.texts(*raw(pa.array([t], pa.string())), True)[1][0] for t in texts[:4]]
    assert all((a == b).all() for a, b in zip(ids[:4], one, strict=True))


def test_batches_are_bounded_by_bytes_while_ids_are_made(spark, monkeypatch):
    seen, written = [], packing.written
    monkeypatch.setattr(packing, "written", lambda df, name: (seen.append(spark.conf.get(LIMIT)), written(df, name))[1])
    before = spark.conf.get(LIMIT)
    docs = spark.createDataFrame([(k, "some words " * 200) for k in range(5000)], "doc_id long, text string")
    assert packing.pack_documents(docs, PATH).agg({"length": "sum"}).first()[0] == 5000 * len(np.append(Transducer(PATH).texts(*raw(pa.array(["some words " * 200])), True)[1][0], 1))
    assert seen and all(int(x) <= WIDE_BYTES for x in seen) and spark.conf.get(LIMIT) == before


def test_a_setting_comes_back_after_an_error(spark):
    before = spark.conf.get(LIMIT)
    try:
        with setting(spark, LIMIT, 12345):
            assert spark.conf.get(LIMIT) == "12345"
            raise KeyError
    except KeyError:
        pass
    assert spark.conf.get(LIMIT) == before
