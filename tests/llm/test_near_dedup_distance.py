"""Near-dedup links pairs whose signatures lie as far apart as the index can find."""

import random

import numpy as np
import pyarrow as pa

from tabularium.llm import near_dedup
from tabularium.llm.arrow_text import raw
from tabularium.llm.shingles import shingle_hashes


def distances(texts):
    """Signature distances of texts 0 and 1, 2 and 3 and so on; no text repeats a shingle."""
    packed = near_dedup.signatures_of(*shingle_hashes(*raw(pa.array(texts)))).view(np.uint64)
    symbols = packed[:, :, None] >> (np.arange(4, dtype=np.uint64) * np.uint64(near_dedup.BITS + 1)) & np.uint64((1 << near_dedup.BITS) - 1)
    return (symbols[::2] != symbols[1::2]).sum((1, 2))


def test_pairs_at_the_edge_of_the_index(spark):
    rnd = random.Random(8)
    texts = []
    for _ in range(200_000):  # 5 shingles, of which the shorter text has 4
        words = [f"{rnd.getrandbits(30):x}" for _ in range(8)]
        texts += [" ".join(words), " ".join(words[:7])]
    apart = distances(texts)
    far = np.flatnonzero((apart > 26) & (apart <= 2 * near_dedup.CHUNKS - 1))
    assert len(far)
    rows = [(int(k), texts[k]) for p in far for k in (2 * p, 2 * p + 1)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[int(2 * p + 1)] == 2 * p for p in far)
