"""SentencePiece encoding and decoding by a batched numpy Viterbi.

Texts are cut into units, a run of spaces with the word behind it; distinct words of equal length advance together. At each
position the hashes of the substrings that end there probe the sorted keys of the pieces; candidates score the best score where
they begin plus their own, and the vectorised maximum stores its backpointer.

For unigram models that is the model itself. A BPE model's own result is not the best-scoring segmentation, so for it a
candidate counts only if BPE would leave it unmerged beside the piece before it; exactly one path is left then, which is the
library's. That is the one change to the method.

Unknown characters become their bytes' pieces where the model has those, else the unknown piece. An empty or null text has no ids.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .arrow_text import WIDE_BYTES, blocks

MARK = "▁"
#: Words longer than this advance one by one; so many stability results are kept, those of arrays in 2**KNOWN_BITS slots.
LONG_WORD, MOST_KNOWN, KNOWN_BITS = 40, 1_000_000, 20
#: Characters of the longest units whose ids are kept.
KEPT_WORD = 200
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_NONE = -1


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else varint(at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Pieces:
    """A model's pieces, their merges if it is a BPE model, and the encoder."""

    def __init__(self, pieces: list[tuple[str, float, int]], bpe: bool, dummy_prefix: bool = True) -> None:
        """pieces: (text, score, type) in id order; types as in the model file: 1 normal, 2 unknown, 3 control, 6 byte."""
        self.bpe, self.dummy_prefix = bpe, dummy_prefix
        self.text = [p[0] for p in pieces]
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == 2), 0)
        self.bytes = {int(p[0][3:5], 16): i for i, p in enumerate(pieces) if p[2] == 6}
        normal = [(t, s, i) for i, (t, s, k) in enumerate(pieces) if k in (1, 4) and t]
        # Ordinals: single characters, then pieces in the order in which BPE merges them. Runs of marks merge last and from the left.
        self.runs = {len(t): i for t, _, i in normal if t == MARK * len(t)}
        single = [x for x in normal if len(x[0]) == 1]
        more = [x for x in normal if len(x[0]) > 1 and not (bpe and x[0] == MARK * len(x[0]))]
        more.sort(key=lambda x: (-x[1], x[2]))
        ordered = single + more
        self.leaves = len(single)
        self.id = np.array([x[2] for x in ordered], np.int64)
        self.score = np.array([x[1] for x in ordered], np.float64)
        self.ordinal = {x[0]: k for k, x in enumerate(ordered)}
        self.left, self.right = np.arange(len(ordered)), np.arange(len(ordered))
        self.merged: dict[tuple[int, int], int] = {}
        self.known: dict[tuple[int, int], bool] = {}
        self.pair_keys, self.pair_to = np.zeros(0, np.int64), np.zeros(0, np.int64)
        usable = np.ones(len(ordered), bool)
        if bpe:
            for k in range(self.leaves, len(ordered)):
                usable[k] = self._place(ordered[k][0], k)
            self.known.clear()
            keys = np.array([a * len(ordered) + b for a, b in self.merged], np.int64)
            order = np.argsort(keys)
            self.pair_keys, self.pair_to = keys[order], np.array(list(self.merged.values()), np.int64)[order]
        self.seen_keys, self.seen = np.full(1 << KNOWN_BITS, -1, np.int64), np.zeros(1 << KNOWN_BITS, bool)
        self.longest = max((len(x[0]) for x in ordered), default=1)
        self.power = np.power(_BASE, np.arange(LONG_WORD + 2, dtype=np.uint64))
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        self.inverse = np.power(inverse, np.arange(LONG_WORD + 2, dtype=np.uint64))
        hashes = np.array([self._hash(x[0]) for x in ordered], np.uint64)
        kept = np.flatnonzero(usable & (np.array([len(x[0]) for x in ordered]) <= LONG_WORD))
        kept = kept[np.argsort(hashes[kept])]
        self.keys, self.of_key = hashes[kept], kept
        self.usable = usable
        self.score_of = {t: s for t, s, _ in normal if len(t) > 1}
        self.worst = float(self.score.min(initial=0)) - 10
        # What each id decodes to.
        data = [b"" if k in (2, 3) else bytes([int(t[3:5], 16)]) if k == 6 else t.replace(MARK, " ").encode() for t, _, k in pieces]
        self.decode_at = np.concatenate([[0], np.cumsum([len(d) for d in data])])
        self.decode_data = np.frombuffer(b"".join(data), np.uint8)
        self.words: dict[str, list[int]] = {}

    @classmethod
    def load(cls, path: str) -> Pieces:
        with open(path, "rb") as f:
            data = f.read()
        pieces, bpe, prefix = [], False, True
        for number, value in _fields(data):
            if number == 1:
                x = dict(_fields(value))
                pieces.append((x.get(1, b"").decode(), float(np.frombuffer(x.get(2, bytes(4)), "<f4")[0]), x.get(3, 1)))
            elif number == 2:
                bpe = dict(_fields(value)).get(3, 1) == 2
            elif number == 3:
                spec = dict(_fields(value))
                prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("models that normalise characters or remove spaces are not supported")
        return cls(pieces, bpe, prefix)

    def _hash(self, text: str) -> np.uint64:
        value = 0
        for k, c in enumerate(text):
            value += (ord(c) + 1) * pow(int(_BASE), k, 1 << 64)
        return _mixed(np.array([value & (1 << 64) - 1], np.uint64) + np.uint64(len(text)))[0]

    def _place(self, text: str, k: int) -> bool:
        """Find the merge that makes a piece; False if BPE never makes it."""
        for cut in range(1, len(text)):
            a, b = self.ordinal.get(text[:cut], k), self.ordinal.get(text[cut:], k)
            if a < k and b < k and (a < self.leaves or self.left[a] != a) and (b < self.leaves or self.left[b] != b) and self._stable_one(a, b):
                self.left[k], self.right[k] = a, b
                self.merged[a, b] = k
                self.known.clear()
                return True
        return False

    def _stable_one(self, a: int, b: int) -> bool:
        """Whether BPE leaves a, b side by side, by the merges known so far: undo merges, the later one first, looking for one across."""
        bound, x, y = 1 << 60, a, b
        while True:
            if self.merged.get((x, y), bound) < bound:
                return False
            if x < self.leaves and y < self.leaves:
                return True
            if x > y:
                bound, x = x, int(self.right[x])
            else:
                bound, y = y + 1, int(self.left[y])

    def _stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_stable_one of arrays; an unknown character (-1) is stable beside anything."""
        keys = np.where((a < 0) | (b < 0), -1, a * len(self.id) + b)
        slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - KNOWN_BITS)).astype(np.int64)
        out = self.seen[slot]
        out[keys < 0] = True
        missing = np.flatnonzero((self.seen_keys[slot] != keys) & (keys >= 0))
        if len(missing):
            distinct, first, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            x, y = distinct // len(self.id), distinct % len(self.id)
            bound, open_ = np.full(len(distinct), 1 << 60), np.arange(len(distinct))
            result = np.ones(len(distinct), bool)
            while len(open_):
                pair = x[open_] * len(self.id) + y[open_]
                k = np.minimum(np.searchsorted(self.pair_keys, pair), max(len(self.pair_keys) - 1, 0))
                over = np.where(self.pair_keys[k] == pair, self.pair_to[k], 1 << 60) if len(self.pair_keys) else np.full(len(pair), 1 << 60)
                merges = over < bound[open_]
                result[open_[merges]] = False
                open_ = open_[~merges & ~((x[open_] < self.leaves) & (y[open_] < self.leaves))]
                late = x[open_] > y[open_]
                l, r = open_[late], open_[~late]
                bound[l] = x[l]
                x[l] = self.right[x[l]]
                bound[r] = y[r] + 1
                y[r] = self.left[y[r]]
            out[missing] = result[back]
            at = slot[missing[first]]  # of pairs that share a slot one stays
            self.seen_keys[at] = distinct
            self.seen[at] = result
            lost = self.seen_keys[at] != distinct
            self.seen_keys[at[lost]] = -1
        return out

    def viterbi(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """([words, length] ordinals in reading order, -1 for an unknown character and -2 beyond the last; number of pieces) of words of equal length."""
        n, length = points.shape
        prefix = np.zeros((n, length + 1), np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * self.power[:length], axis=1, out=prefix[:, 1:])
        score = np.full((n, length + 1), -np.inf)
        score[:, 0] = 0
        piece, back = np.full((n, length + 1), _NONE), np.zeros((n, length + 1), np.int64)
        for end in range(1, length + 1):
            for size in range(1, min(end, self.longest) + 1):
                begin = end - size
                value = _mixed((prefix[:, end] - prefix[:, begin]) * self.inverse[begin] + np.uint64(size))
                at = np.minimum(np.searchsorted(self.keys, value), len(self.keys) - 1)
                rows = np.flatnonzero((self.keys[at] == value) & (score[:, begin] > -np.inf))
                found = self.of_key[at[rows]]
                if self.bpe and begin and len(rows):
                    ok = self._stable(piece[rows, begin], found)
                    rows, found = rows[ok], found[ok]
                gained = score[rows, begin] + self.score[found]
                better = gained > score[rows, end]
                rows, found = rows[better], found[better]
                score[rows, end], piece[rows, end], back[rows, end] = gained[better], found, begin
                if size == 1:  # a character without a piece
                    rows = np.flatnonzero((self.keys[at] != value) & (score[:, begin] > -np.inf))
                    score[rows, end], piece[rows, end], back[rows, end] = score[rows, begin] + self.worst, _NONE, begin
        out, count = np.full((n, length), -2), np.zeros(n, np.int64)
        here, rows = np.full(n, length), np.arange(n)
        while len(rows):
            out[rows, count[rows]] = piece[rows, here[rows]]
            count[rows] += 1
            here[rows] = back[rows, here[rows]]
            rows = rows[here[rows] > 0]
        turned = np.arange(length)[None, :]
        order = np.where(turned < count[:, None], count[:, None] - 1 - turned, turned)
        return np.take_along_axis(out, order, 1), count

    def _one(self, word: str) -> list[int]:
        """Ordinals of one long word, by the same recurrence; unknown characters are -1."""
        best: list[tuple[float, int, int] | None] = [(0.0, _NONE, 0), *[None] * len(word)]
        for end in range(1, len(word) + 1):
            for begin in range(end - 1, max(end - self.longest, 0) - 1, -1):
                before, k = best[begin], self.ordinal.get(word[begin:end], _NONE)
                if before is None or k >= 0 and not self.usable[k] or k < 0 and end - begin > 1:
                    continue
                if self.bpe and begin and k >= 0 and before[1] >= 0:
                    pair = (before[1], k)
                    if pair not in self.known:
                        if len(self.known) > MOST_KNOWN:
                            self.known.clear()
                        self.known[pair] = self._stable_one(*pair)
                    if not self.known[pair]:
                        continue
                gained = before[0] + (self.score[k] if k >= 0 else self.worst)
                if best[end] is None or gained > best[end][0]:
                    best[end] = (gained, k, begin)
        out, end = [], len(word)
        while end:
            _, k, begin = best[end]
            out.append(k)
            end = begin
        return out[::-1]

    def _ids(self, word: str, ordinals: list[int]) -> list[int]:
        """Ids of a word's ordinals."""
        out, at = [], 0
        for k in ordinals:
            if k >= 0:
                out.append(int(self.id[k]))
                at += len(self.text[self.id[k]])
            else:
                out += [self.bytes[b] for b in word[at].encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]
                at += 1
        return out

    def _spaced(self, unit: str) -> list[int]:
        """Ids of a unit of several marks. Runs of marks merge after all else, with equal scores, so stability by rank doesn't
        tell their pieces: merge by score and then from the left, as BPE is defined. Unigram models need none of this."""
        if not self.bpe:
            return self._ids(unit, self._one(unit))
        part, after, before = list(unit), [*range(1, len(unit)), -1], [-1, *range(len(unit) - 1)]
        heap: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            if left >= 0 and after[left] >= 0 and (both := part[left] + part[after[left]]) in self.score_of:
                heapq.heappush(heap, (-self.score_of[both], left, both))

        for k in range(len(unit)):
            offer(k)
        while heap:
            _, left, both = heapq.heappop(heap)
            right = after[left]
            if not part[left] or right < 0 or part[left] + part[right] != both:
                continue
            part[left], part[right], after[left] = both, "", after[right]
            if after[left] >= 0:
                before[after[left]] = left
            offer(before[left])
            offer(left)
        out: list[int] = []
        for p in part:
            if p:
                k = self.ordinal.get(p, _NONE)
                out += [self.runs[len(p)]] if p[0] == MARK and p == MARK * len(p) and len(p) in self.runs else self._ids(p, [k])
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        prefix = MARK if self.dummy_prefix else ""
        marked = [prefix + t.replace(" ", MARK) if t else "" for t in texts]
        whole = "".join(marked)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(points)
        if not n:
            return [np.zeros(0, np.uint32) for _ in texts]
        bounds = np.concatenate([[0], np.cumsum([len(m) for m in marked])])
        mark = points == ord(MARK)
        opens = mark.copy()
        opens[1:] &= ~mark[:-1]
        opens[bounds[:-1][bounds[:-1] < n]] = True
        begin = np.flatnonzero(opens)
        end = np.append(begin[1:], n)
        second = np.zeros(len(begin), bool)
        two = end - begin > 1
        second[two] = mark[begin[two]] & mark[begin[two] + 1]
        size = end - begin
        plain = ~second & (size <= LONG_WORD)
        # Distinct plain units by hash, those of a length together.
        power = np.uint64(0xD6E8FEB86659FD93)
        steps = np.full(n, power)
        steps[0] = 1
        powers = np.multiply.accumulate(steps)
        inverse_steps = np.full(n, np.uint64(pow(int(power), -1, 1 << 64)))
        inverse_steps[0] = 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers, out=total[1:])
        value = _mixed((total[end] - total[begin]) * np.multiply.accumulate(inverse_steps)[begin] + size.astype(np.uint64))
        which = np.flatnonzero(plain)
        _, first, back = np.unique(value[which], return_index=True, return_inverse=True)
        model = which[first]
        found: list[list[int] | np.ndarray] = [[]] * len(model)
        for length in np.unique(size[model]):
            group = np.flatnonzero(size[model] == length)
            words = points[begin[model[group]][:, None] + np.arange(length)]
            ordinals, count = self.viterbi(words)
            ids = self.id[np.maximum(ordinals, 0)]
            odd = (ordinals == _NONE).any(1)
            for row, g in enumerate(group):
                if odd[row]:
                    word = "".join(map(chr, words[row]))
                    found[g] = self._ids(word, ordinals[row, : count[row]].tolist())
                else:
                    found[g] = ids[row, : count[row]]
        sizes = np.array([len(f) for f in found], np.int64)
        table = np.concatenate([np.asarray(f, np.int64) for f in found]) if len(found) else np.zeros(0, np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        # The other units, one by one.
        other = np.flatnonzero(~plain)
        rest: list[list[int]] = []
        for k in other:
            unit = whole[begin[k] : end[k]]
            got = self.words.get(unit)
            if got is None:
                got = self._spaced(unit) if second[k] else self._ids(unit, self._one(unit))
                if len(unit) <= KEPT_WORD:
                    if len(self.words) > 100_000:
                        self.words.clear()
                    self.words[unit] = got
            rest.append(got)
        more = np.concatenate([np.asarray(r, np.int64) for r in rest]) if rest else np.zeros(0, np.int64)
        table_all = np.concatenate([table, more])
        length = np.zeros(len(begin), np.int64)
        source = np.zeros(len(begin), np.int64)
        length[which], source[which] = sizes[back], starts[back]
        rest_sizes = np.array([len(r) for r in rest], np.int64)
        length[other] = rest_sizes
        source[other] = len(table) + np.concatenate([[0], np.cumsum(rest_sizes)])[:-1]
        ends = np.concatenate([[0], np.cumsum(length)])
        ids = table_all[np.repeat(source - ends[:-1], length) + np.arange(ends[-1])].astype(np.uint32)
        cuts = ends[np.searchsorted(begin, bounds)]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the space put before it; invalid bytes become replacement characters."""
        ids = np.asarray(ids, np.int64)
        begin, size = self.decode_at[ids], self.decode_at[ids + 1] - self.decode_at[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        text = self.decode_data[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])].tobytes().decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


@lru_cache(2)
def pieces(path: str) -> Pieces:
    """One per worker process and model."""
    return Pieces.load(path)


def encoded(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every whole text."""
    ship(docs.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, _ in blocks(batch, "text", WIDE_BYTES):
                found = pieces(model).encode([t or "" for t in rows.column(1).to_pylist()])
                at = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(at, pa.array(np.concatenate(found).astype(np.int32)))], ["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text")).mapInArrow(read, f"key {kind}, ids array<int>")
    return out.select(F.col("key").alias(key), "ids")


def decoded(ids: DataFrame, model: str, key: str = "doc_id") -> DataFrame:
    """(key, text) of ids (key, ids array<int>); null ids give a null text."""
    ship(ids.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [pieces(model).decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    kind = ids.schema[key].dataType.simpleString()
    out = ids.select(ids[key].alias("key"), "ids").mapInArrow(read, f"key {kind}, text string")
    return out.select(F.col("key").alias(key), "text")


def round_trips(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_bytes, n_ids, ids_crc32, decodes_back) of every whole text: digests of its ids, and whether they decode to it."""
    ship(docs.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = pieces(model)
        for batch in batches:
            for rows, _, offsets in blocks(batch, "text", WIDE_BYTES):
                texts = [t or "" for t in rows.column(1).to_pylist()]
                found = machine.encode(texts)
                crc = [zlib.crc32(f.astype("<u4").tobytes()) for f in found]
                same = [machine.decode(f) == t for f, t in zip(found, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offsets)), pa.array([len(f) for f in found], pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_bytes", "n_ids", "ids_crc32", "decodes_back"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(read, f"doc_id {kind}, n_bytes long, n_ids long, ids_crc32 long, decodes_back boolean")
