"""Counts are the same with and without ids."""

import numpy as np
import public_tokenizers

from tabularium.llm.bpe_fst import transducer


def test_counts_with_and_without_ids():
    machine = transducer(public_tokenizers.path("byte_bpe_50k.json"))
    special = next(iter(machine.special), "")
    texts = [t.encode() for t in ("", "one two", special, f"a{special}{special} b", "", "naïve " * 90, f"{special}end")]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    counts, ids = machine.texts(data, offsets, True)
    assert counts.tolist() == [len(x) for x in ids] == machine.texts(data, offsets)[0].tolist()
