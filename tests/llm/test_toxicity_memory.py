"""What the driver holds while it fits the chain: the sample once."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tabularium.llm import toxicity


def sample(n, width, seed=1):
    rnd = np.random.default_rng(seed)
    rows = [np.unique(rnd.integers(0, 1 << toxicity.BITS, width)) for _ in range(n)]
    labels = rnd.integers(0, 2, (n, 2)).astype(float)
    for k in range(2):
        rows = [np.unique(np.append(r, 77 + k)) if y[k] else r for r, y in zip(rows, labels, strict=True)]
    ratios = rnd.random((n, toxicity.RATIOS))
    lists = pa.array([r.astype(np.int32) for r in rows], pa.list_(pa.int32()))
    return pa.table([lists, pa.array(ratios.tolist(), pa.list_(pa.float64())), labels[:, 0], labels[:, 1]], ["features", "ratios", "c0", "c1"]), rows, ratios, labels


@pytest.mark.parametrize("parts", [1, 7])
def test_the_chain_does_not_depend_on_chunks_or_the_order_of_rows(parts):
    found, rows, ratios, labels = sample(300, 50)
    order = sorted(range(300), key=lambda i: ratios[i].tolist())
    want = toxicity.fit_chain([rows[i] for i in order], ratios[order], labels[order])
    step = -(-300 // parts)
    mixed = pa.concat_tables([found.slice(k, step) for k in range(0, 300, step)][::-1])
    for model, other in zip(toxicity.chain_of(mixed, 2).models, want.models, strict=True):
        assert (model.chosen == other.chosen).all() and np.allclose(model.weight, other.weight) and len(model.chosen)


def test_no_rows():
    found, *_ = sample(3, 5)
    assert [m.constant for m in toxicity.chain_of(found.slice(0, 0), 2).models] == [0.0, 0.0]
    assert [m.constant for m in toxicity.chain_of(pa.Table.from_batches([], found.schema), 2).models] == [0.0, 0.0]


def test_memory_of_a_fit():
    found, *_ = sample(2000, 3000)
    y = found.column(2).to_numpy()
    rows = [row for chunk in found.column(0).chunks for row in toxicity._lists(chunk)]
    tracemalloc.start()
    toxicity.Linear(rows, np.zeros((2000, 1)), y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90e6, peak
