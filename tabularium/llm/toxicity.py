"""Toxicity by a classifier chain.

Categories are predicted in order by linear (logistic) models. A later model reads, beside the text's own features, the
probabilities of the earlier categories; it is trained on out-of-fold predictions of those, so it sees them as they will be for
new texts. Features of a text: which of its words and word beginnings occur at least so many times (hashed; those of a category are
chosen by a chi-squared test on the training rows of the fold), and six ratios of its bytes.

The models are fitted on at most max_train labelled documents, those with the smallest hash of their id, taken whole;
scoring covers every document. A null text, or one without words, has probability 0 in every category. Labels that are null don't
count; of several labels of a document the largest counts, of several texts of a labelled doc_id the smallest is learnt from. A category without both values among the labels is constant.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .arrow_text import blocks, trim
from .shingles import _POWERS, _VALUE, mixed, span_hashes, spans

#: Bits of the feature hash, lengths (bytes) of word beginnings, numbers of occurrences told apart, folds, features of a category and the least chi-squared value.
BITS, BEGINNINGS, LEVELS, FOLDS, MOST, LEAST = 20, (4, 5, 6), (1, 2, 3, 5), 4, 2048, 20.0
#: Occurrences a word that are told apart, besides.
RATES = (0.005, 0.02)
MAX_TRAIN = 4000
#: Training rows, and features, that the driver works on together.
SOME, PIECE = 500, 1 << 16
#: Ratios of a text's bytes, and which of them is the logarithm of its number of words.
RATIOS, WORDS_AT = 6, 4
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each feature occurrence, feature, [texts, RATIOS] ratios) of UTF-8 texts."""
    texts, n = len(offsets) - 1, len(data)
    ratios = np.zeros((texts, RATIOS))
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), ratios
    inside = _WORD[data]
    begin, end = spans(inside, offsets)
    text = np.searchsorted(offsets, begin, "right") - 1
    hashed = lambda x: (x >> np.uint64(64 - BITS)).astype(np.int64)
    owners, values = [text], [hashed(span_hashes(data, inside, begin, end))]
    start, tops = np.zeros(len(begin), np.uint64), max(BEGINNINGS)
    for k in range(tops):
        if k in BEGINNINGS:
            longer = end - begin > k
            owners.append(text[longer])
            values.append(hashed(mixed(start[longer] + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))))
        start += _VALUE[data[np.minimum(begin + k, n - 1)]] * _POWERS[k]
    longer = end - begin > tops
    owners.append(text[longer])
    values.append(hashed(mixed(start[longer] + np.uint64(tops * 0x9E3779B97F4A7C15 & (1 << 64) - 1))))
    size = np.maximum(np.diff(offsets), 1)
    of = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    words = np.bincount(text, minlength=texts)
    letters = of(inside)
    for k, x in enumerate((of(_UPPER[data]) / size, (size - letters - of(_SPACE[data])) / size, of(_DIGIT[data]) / size, letters / np.maximum(words, 1) / 10, np.log1p(words) / 10, of(data == 10) / size * 10)):
        ratios[:, k] = x
    return np.concatenate(owners), np.concatenate(values), ratios


def at_level(feature: np.ndarray, level: int) -> np.ndarray:
    """The feature "occurs that often"; level numbers LEVELS and then RATES."""
    return (feature * 0x9E3B1 + level * 0x85EBD + (feature >> 7)) & (1 << BITS) - 1 if level else feature


def occurring(owner: np.ndarray, feature: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature with level) pairs, sorted by text and feature."""
    pairs, count = np.unique(owner << BITS | feature, return_counts=True)
    words = np.expm1(ratios[pairs >> BITS, WORDS_AT] * 10)
    passed = [count >= t for t in LEVELS] + [count >= r * words for r in RATES]
    found = [(pairs[ok] >> BITS << BITS) | at_level(pairs[ok] & (1 << BITS) - 1, k) for k, ok in enumerate(passed)]
    pairs = np.unique(np.concatenate(found))
    return pairs >> BITS, pairs & (1 << BITS) - 1


class Linear:
    """A logistic model over chosen binary features, ratios and earlier probabilities."""

    def __init__(self, rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray) -> None:
        self.constant: float | None = None
        if not len(y) or y.min() == y.max():
            self.constant = float(y[0]) if len(y) else 0.0
            return
        n, positive = len(y), y.sum()
        seen, hit = np.zeros(1 << BITS), np.zeros(1 << BITS)
        for k in range(0, n, SOME):  # a few rows at a time: the driver holds the sample once
            part = rows[k : k + SOME]
            flat = np.concatenate(part)
            seen += np.bincount(flat, minlength=1 << BITS)
            hit += np.bincount(flat, np.repeat(y[k : k + SOME], [len(r) for r in part]), minlength=1 << BITS)
        chi = np.zeros(1 << BITS)
        for k in range(0, 1 << BITS, PIECE):
            some = slice(k, k + PIECE)
            a, b = hit[some], seen[some] - hit[some]
            c, d = positive - a, (n - positive) - b
            chi[some] = n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1)
        chi[seen < 3] = 0
        del seen, hit
        chosen = np.argsort(-chi, kind="stable")[:MOST]
        self.chosen = np.sort(chosen[chi[chosen] >= LEAST])
        self.mean, self.scale = dense.mean(0), dense.std(0) + 1e-6
        x = np.zeros((n, len(self.chosen) + dense.shape[1] + 1), np.float32)
        del chi
        place = np.full(1 << BITS, -1, np.int32)
        place[self.chosen] = np.arange(len(self.chosen))
        for k, r in enumerate(rows):
            at = place[r]
            x[k, at[at >= 0]] = 1
        x[:, len(self.chosen) : -1] = (dense - self.mean) / self.scale
        x[:, -1] = 1
        self.weight = self._fit(x, y.astype(np.float32))

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, ridge: float = 0.3) -> np.ndarray:
        """Accelerated gradient descent on log loss, half way to balanced classes; the step comes from the largest curvature, by power iteration."""
        balance = np.sqrt(np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))).astype(np.float32)
        v = np.ones(x.shape[1], np.float32)
        for _ in range(12):
            v = x.T @ (balance * (x @ v))
            top = float(np.linalg.norm(v))
            v /= top
        step = 1 / (top / 4 + ridge)
        w = z = np.zeros(x.shape[1], np.float32)
        for k in range(rounds):
            g = x.T @ (balance * (1 / (1 + np.exp(-(x @ z))) - y)) + ridge * np.append(z[:-1], np.float32(0))
            new = z - step * g
            z = new + k / (k + 3) * (new - w)
            w = new
        return w

    def probability(self, owner: np.ndarray, feature: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """For texts given by their distinct (owner, feature) pairs and dense columns."""
        if self.constant is not None:
            return np.full(len(dense), self.constant)
        at = np.minimum(np.searchsorted(self.chosen, feature), max(len(self.chosen) - 1, 0))
        ok = self.chosen[at] == feature if len(self.chosen) else np.zeros(len(feature), bool)
        margin = np.bincount(owner[ok], self.weight[at[ok]], minlength=len(dense)) + ((dense - self.mean) / self.scale) @ self.weight[len(self.chosen) : -1] + self.weight[-1]
        return 1 / (1 + np.exp(-np.clip(margin, -50, 50)))


class Chain:
    """Models in the order of their categories."""

    def __init__(self, models: list[Linear]) -> None:
        self.models = models
        used = [m.chosen for m in models if m.constant is None]
        self.used = np.zeros(1 << BITS, bool)
        for u in used:
            self.used[u] = True
        some, self.used = self.used, np.zeros(1 << BITS, bool)
        for a in range(0, 1 << BITS, PIECE):
            every = np.arange(a, a + PIECE)
            self.used[a : a + PIECE] = np.logical_or.reduce([some[at_level(every, k)] for k in range(len(LEVELS) + len(RATES))])

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """[texts, categories]."""
        owner, feature, ratios = features(data, offsets)
        some = np.bincount(owner, minlength=len(ratios)) > 0
        keep = self.used[feature]
        owner, feature = occurring(owner[keep], feature[keep], ratios)
        dense, out = ratios, np.zeros((len(ratios), len(self.models)))
        for k, model in enumerate(self.models):
            out[:, k] = model.probability(owner, feature, dense)
            dense = np.column_stack([dense, out[:, k]])
        return np.where(some[:, None], out, 0.0)


def fit_chain(rows: list[np.ndarray], ratios: np.ndarray, labels: np.ndarray) -> Chain:
    """rows: distinct features of each training text; labels: [texts, categories], NaN where unknown."""
    dense, models = ratios, []
    fold = np.arange(len(rows)) % FOLDS
    for k in range(labels.shape[1]):
        known = ~np.isnan(labels[:, k])
        pick = lambda mask: [rows[i] for i in np.flatnonzero(mask)]  # noqa: B023, E731
        models.append(Linear(pick(known), dense[known], labels[known, k]))
        if k + 1 == labels.shape[1]:
            break
        outside = np.zeros(len(rows))
        for f in range(FOLDS):
            train, test = known & (fold != f), fold == f
            model = Linear(pick(train), dense[train], labels[train, k])
            part = pick(test)
            owner = np.repeat(np.arange(len(part)), [len(r) for r in part]) if part else np.zeros(0, np.int64)
            outside[test] = model.probability(owner, np.concatenate(part) if part else owner, dense[test])
        dense = np.column_stack([dense, outside])
    return Chain(models)


def train(docs: DataFrame, labels: DataFrame, categories: list[str], max_train: int = MAX_TRAIN) -> Chain:
    """A chain fitted on at most max_train labelled documents (doc_id, text); labels: (doc_id, one 0/1 column a category)."""
    ship(docs.sparkSession)
    sample = labels.groupBy("doc_id").agg(*[F.max(c).cast("double").alias(f"c{k}") for k, c in enumerate(categories)])
    sample = sample.filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    # The sample has at most max_train rows, and so has what comes back: of the texts of a repeated doc_id the smallest counts.
    joined = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), *[F.first(f"c{k}").alias(f"c{k}") for k in range(len(categories))]).drop("doc_id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in blocks(batch, "text"):
                owner, feature, ratios = features(data, offsets)
                owner, feature = occurring(owner, feature, ratios)
                edges = np.searchsorted(owner, np.arange(len(ratios) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(feature.astype(np.int32)))
                dense = pa.ListArray.from_arrays(pa.array(np.arange(0, ratios.size + 1, RATIOS, dtype=np.int32)), pa.array(ratios.ravel()))
                yield pa.RecordBatch.from_arrays([lists, dense, *rows.columns[1:]], names)

    names = ["features", "ratios", *(f"c{k}" for k in range(len(categories)))]
    found = joined.mapInArrow(read, "features array<int>, ratios array<double>, " + ", ".join(f"{c} double" for c in names[2:])).toArrow()
    chain = chain_of(found, len(categories))
    del found
    trim()
    return chain


def chain_of(found: pa.Table, categories: int) -> Chain:
    """A chain fitted on rows (features, ratios, one label a category). Features stay where Arrow has them."""
    ratios = found.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, RATIOS)
    order = np.array(sorted(range(len(ratios)), key=lambda i: ratios[i].tolist()), np.int64)  # the same folds whatever order rows arrive in
    rows = [row for chunk in found.column(0).chunks for row in _lists(chunk)]
    values = np.column_stack([np.asarray(found.column(2 + k).to_numpy(zero_copy_only=False), float) for k in range(categories)])
    return fit_chain([rows[i] for i in order], ratios[order], values[order])


def _lists(chunk: pa.ListArray) -> list[np.ndarray]:
    """The lists of a chunk without nulls, as views."""
    flat, edges = chunk.values.to_numpy(), chunk.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def score(docs: DataFrame, chain: Chain, categories: list[str]) -> DataFrame:
    """(doc_id, p_<category>, ...) for every document."""
    ship(docs.sparkSession)
    names = ["doc_id", *(f"p_{c}" for c in categories)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in blocks(batch, "text"):
                p = chain.probabilities(data, offsets)
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(p[:, k]) for k in range(p.shape[1]))], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(read, f"doc_id {kind}, " + ", ".join(f"`{c}` double" for c in names[1:]))


def keep_clean(docs: DataFrame, chain: Chain, category: int, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose probability in a category is below the threshold."""
    ship(docs.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in blocks(batch, "text"):
                yield rows.filter(pa.array(chain.probabilities(data, offsets)[:, category] < threshold))

    return docs.mapInArrow(read, docs.schema)
