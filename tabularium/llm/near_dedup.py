"""MinHash near-dedup by a multi-index Hamming join.

A document's signature has SYMBOLS MinHash values of b = BITS bits; two documents' distance is the number of symbols in
which they differ. Signatures are split into CHUNKS chunks of four symbols. By the pigeonhole principle two signatures
within 2 * CHUNKS - 1 agree in some chunk but for at most one symbol, so every allowed error is enumerated: each chunk
gives four keys, each with one symbol left out. All pairs within DISTANCE share a key; at the threshold similarity of
0.8 a pair lies beyond it with a probability of some 0.0000001, less above. Every pair is then confirmed on the full
shingle sets.

Documents with equal sets form one class first, and only one document of each class is indexed, so copies never meet in
a key. Each member is first compared with the smallest member of its keys and the one that is smallest in most of them,
and what is linked is united. Only keys that then still hold several components compare members across components, each pair in
its first common key alone, and only where the sets can be similar enough: shingles that no other such document has
can't be shared, which bounds the intersection. A parity sketch bounds it further: a set's shingles fall into SKETCH
buckets, and every bucket in which two sets differ in parity holds a shingle that only one of them has, so the number of such
buckets never exceeds the symmetric difference. A pair that this rules out can't be linked, so no link is lost, and what passes
is nearly always one. Nothing is capped: hot copies cost a partial aggregate, hot near copies two comparisons each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import release, remove, ship, written
from .arrow_text import blocks, raw
from .components import components
from .shingles import WORDS, mixed, shingle_hashes, shingle_sets
from .sieve import sifted

SYMBOLS, CHUNKS, BITS = 64, 16, 14
#: The signature distance up to which all pairs are found: all that the index guarantees.
DISTANCE = 2 * CHUNKS - 1
#: Buckets of the parity sketch, one bit each.
SKETCH = 512
#: Keys of a document that are dealt at once.
AT_ONCE = 16
#: Link documents with PERCENT * union <= 100 * intersection.
PERCENT = 80
_FACTORS = mixed(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signatures_of(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Packed signatures (rows of CHUNKS 64-bit words) of non-empty shingle sequences laid end to end."""
    symbols = np.empty((len(bounds) - 1, SYMBOLS), np.uint64)
    for k, factor in enumerate(_FACTORS):
        symbols[:, k] = np.minimum.reduceat(sets * factor, bounds[:-1])
    symbols = mixed(symbols) >> np.uint64(64 - BITS)
    shifts = np.arange(4, dtype=np.uint64) * np.uint64(BITS + 1)  # a spare bit above each symbol, for distance()
    return (symbols.reshape(-1, CHUNKS, 4) << shifts).sum(2, dtype=np.uint64).view(np.int64)


def parities(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Packed parity sketches (rows of SKETCH / 64 64-bit words) of non-empty sets of distinct shingles laid end to end."""
    rows = len(bounds) - 1
    out = np.empty((rows, SKETCH // 8), np.uint8)
    bucket = (sets >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64)
    for low in range(0, rows, 2048):
        high = min(low + 2048, rows)
        at = np.repeat(np.arange(high - low) * SKETCH, np.diff(bounds[low : high + 1]))
        odd = np.bincount(at + bucket[bounds[low] : bounds[high]], minlength=(high - low) * SKETCH) & 1
        out[low:high] = np.packbits(odd.astype(np.uint8).reshape(-1, SKETCH), axis=1)
    return out.view(np.int64)


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, signature, sketch array<long>): h1, h2 identify the set; without words n_shingles is 0 and h1, h2 null."""
    ship(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in blocks(batch, "text"):
                value, bounds = shingle_hashes(data, offsets, words)
                sets = [np.unique(value[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                n = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(n)
                h1, h2 = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                packed, sketch = np.zeros((len(n), CHUNKS), np.int64), np.zeros((len(n), SKETCH // 64), np.int64)
                if len(some):
                    flat = np.concatenate([sets[k] for k in some])
                    edges = np.concatenate([[0], np.cumsum(n[some])])
                    h1[some] = np.add.reduceat(mixed(flat ^ np.uint64(0x5851F42D4C957F2D)), edges[:-1]).view(np.int64)
                    h2[some] = np.bitwise_xor.reduceat(mixed(flat + np.uint64(0x14057B7EF767814F)), edges[:-1]).view(np.int64)
                    packed[some], sketch[some] = signatures_of(flat, edges), parities(flat, edges)
                none = n == 0
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel())) for x in (packed, sketch)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n), pa.array(h1, mask=none), pa.array(h2, mask=none), *lists], ["doc_id", "n_shingles", "h1", "h2", "signature", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(sign, f"doc_id {kind}, n_shingles long, h1 long, h2 long, signature array<long>, sketch array<long>")


def index_keys(signs: DataFrame, first: int = 0, last: int = 4 * CHUNKS - 1) -> DataFrame:
    """(key, number, id) of signs (id, signature): each chunk without each of its symbols in turn; of these keys the first to the last.

    The keys are numbered and each is worked out from its number. All of them in one expression make a method too long to be compiled.
    """
    masks = F.array(*[F.lit(sum(((1 << BITS) - 1) << (BITS + 1) * j for j in range(4) if j != k)) for k in range(4)])
    each = signs.select("id", "signature", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("number"))
    return each.select(F.xxhash64("number", F.get("signature", (F.col("number") / 4).cast("int")).bitwiseAND(F.get(masks, F.col("number") % 4))).alias("key"), "number", "id")


def distance(a: str, b: str) -> Column:
    """The number of symbols in which two signatures differ: adding 2**BITS - 1 to a symbol's difference carries into its spare bit unless it is 0."""
    low = sum(((1 << BITS) - 1) << (BITS + 1) * k for k in range(4))
    spare = sum(1 << ((BITS + 1) * k + BITS) for k in range(4))
    words = [F.bit_count((F.col(a)[c].bitwiseXOR(F.col(b)[c]) + F.lit(low)).bitwiseAND(F.lit(spare))) for c in range(CHUNKS)]
    return reduce(lambda x, y: x + y, words)


def at_least_apart(a: str, b: str) -> Column:
    """How many shingles only one of two sets has, at least, by their parity sketches."""
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(SKETCH // 64)])


def first_common(a: str, b: str, key: str) -> Column:
    """Whether key number `key` is the first that two signatures share, so that a pair is compared once."""
    low = sum(((1 << BITS) - 1) << (BITS + 1) * k for k in range(4))
    spare = sum(1 << ((BITS + 1) * k + BITS) for k in range(4))
    out = F.lit(True)
    for c in range(CHUNKS):
        errors = F.bit_count((F.col(a)[c].bitwiseXOR(F.col(b)[c]) + F.lit(low)).bitwiseAND(F.lit(spare)))
        # No earlier chunk is shared; a chunk that agrees in full has four keys, of which the first counts.
        out = out & ((F.col(key) < 4 * c) | (F.col(key) >= 4 * c + 4) & (errors > 1) | (F.col(key) == 4 * c) | (F.col(key) < 4 * c + 4) & (errors > 0))
    return out


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of all documents in ids (id), and of a few others: a filter of bounded size that goes before any shuffle."""
    return sifted(docs.select("doc_id", docs["text"].cast("string").alias("text")), F.col("doc_id"), ids, F.col("id"))


def shared_shingles(ids: DataFrame, docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, alone): how many shingles of a document no other document in ids (id, distinct) has. Equal sets should be there once."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in blocks(batch, "text"):
                sets = shingle_sets(data, offsets, words)
                at = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
                yield pa.RecordBatch.from_arrays([rows.column(0).take(at), pa.array(np.concatenate(sets).view(np.int64))], ["id", "shingle"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = texts_of(docs, ids).join(ids.select(F.col("id").alias("doc_id")), "doc_id").dropDuplicates(["doc_id"])
    each = texts.mapInArrow(explode, f"id {kind}, shingle long")
    return each.groupBy("shingle").agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n = 1").groupBy("id").agg(F.count("*").alias("alone"))


def confirmed(pairs: DataFrame, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Those pairs (a, b) of doc_ids whose full shingle sets are similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in blocks(batch, "text_a"):
                left = shingle_sets(data, offsets, words)
                right = shingle_sets(*raw(rows.column(3)), words)
                keep = []
                for x, y in zip(left, right, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both) > 0)
                yield pa.RecordBatch.from_arrays([rows.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], ["a", "b"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    pairs = written(pairs.select("a", "b"), "pairs")
    texts = texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    joined = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    joined = joined.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    out = written(joined.select("a", "b", "text_a", "text_b").mapInArrow(compare, f"a {kind}, b {kind}"), "links")
    remove(pairs)
    return out


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text).

    component_id is the smallest doc_id reachable over links. Null, empty and wordless texts are linked with nothing.
    Rows that repeat a doc_id are one document to the links (their texts should be equal); each gives a row. A row without a doc_id
    takes the component of its equals, if they have ids, else none, and is kept.
    """
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    signed = written(signatures(docs, words), "signatures")
    # One document stands for each set.
    found = signed.filter("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch"))
    classes = written(found, "classes")
    release(docs.sparkSession)

    def shared_keys(first: int) -> DataFrame:
        # Both uses of the dealt rows read one exchange.
        keys = index_keys(classes.select("id", "signature"), first, first + AT_ONCE - 1).repartition("key")
        shared = keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
        out = written(keys.join(shared.select("key", "low").hint("shuffle_hash"), "key"), "members")
        release(docs.sparkSession)
        return out

    members = reduce(DataFrame.unionAll, [shared_keys(k) for k in range(0, 4 * CHUNKS, AT_ONCE)])
    signs = classes.select("id", "n", "signature", "sketch")
    end = lambda rows, at: rows.withColumnsRenamed({"id": at, "root": f"r_{at}", "n": f"n_{at}", "able": f"m_{at}", "signature": f"s_{at}", "sketch": f"p_{at}"})
    close = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)
    close &= at_least_apart("p_a", "p_b") * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)
    close &= distance("s_a", "s_b") <= DISTANCE

    def united(roots: DataFrame, links: DataFrame) -> DataFrame:
        """(id, root) after uniting the components that links (a, b) join."""
        of = lambda end: roots.select(F.col("id").alias(end), F.col("root").alias(f"r_{end}"))
        joined = components(links.join(of("a"), "a").join(of("b"), "b").select("r_a", "r_b"), "r_a", "r_b")
        merged = roots.join(joined.select(F.col("id").alias("root"), F.col("root").alias("__new")), "root", "left")
        out = written(merged.select("id", F.coalesce("__new", "root").alias("root")), "roots")
        remove(joined)
        return out

    votes = members.groupBy("id", "low").agg(F.count("*").alias("n")).groupBy("id")
    nearest = written(votes.agg(F.min("low").alias("least"), F.max_by("low", F.struct("n", "low")).alias("most")), "nearest")
    stars = nearest.select(F.explode(F.array("least", "most")).alias("a"), F.col("id").alias("b")).filter("a < b").distinct()
    links = confirmed(stars.join(end(signs, "a"), "a").join(end(signs, "b"), "b").filter(close), docs, words, percent)
    roots = united(nearest.select("id", F.col("id").alias("root")), links)
    # Keys that still hold several components: compare across them.
    rooted = members.select("key", "number", "id").join(roots, "id")
    apart = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    opened = written(rooted.join(apart.hint("shuffle_hash"), "key"), "open")
    release(docs.sparkSession)
    alone = shared_shingles(opened.select("id").distinct(), docs, words)
    # Shingles in common are at most those that others have, and must be percent of the set at least.
    able = F.col("n") - F.coalesce("alone", F.lit(0))
    bounded = signs.join(opened.select("id").distinct(), "id", "semi").join(alone, "id", "left").withColumn("able", able).filter(F.col("able") * 100 >= F.col("n") * percent)
    open_ = opened.join(bounded.select("id", "n", "able", "signature", "sketch"), "id")
    most = F.least("m_a", "m_b")
    across = (F.col("a") < F.col("b")) & (F.col("r_a") != F.col("r_b")) & (most * 100 >= (F.col("n_a") + F.col("n_b") - most) * percent)
    more = end(open_, "a").join(end(open_.drop("number"), "b"), "key").filter(across & close & first_common("s_a", "s_b", "number")).select("a", "b")
    others = confirmed(more, docs, words, percent)
    release(docs.sparkSession)
    if others.take(1):
        roots, before = united(roots, others), roots
        remove(before)
    for done in (members, nearest, links, opened, others):
        remove(done)
    by_set = classes.join(roots, "id", "left").select("h1", "h2", F.coalesce("root", "id").alias("__root"))
    out = signed.select("doc_id", "n_shingles", "h1", "h2").join(by_set, ["h1", "h2"], "left")
    root = F.coalesce("__root", "doc_id")
    return out.select("doc_id", "n_shingles", root.alias("component_id"), root.eqNullSafe(F.col("doc_id")).alias("kept"))


#: DuckDB SQL for near_duplicates() of the table documents: exact similarities of all pairs that share a shingle, and their closure.
NEAR_DUPLICATES_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
step AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a, b FROM step UNION SELECT r.a, t.b FROM reach r JOIN step t ON r.b = t.a),
root AS (SELECT a AS doc_id, least(a, min(b)) AS root FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(root.root, d.doc_id) AS component_id, coalesce(root.root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN root USING (doc_id)
"""
