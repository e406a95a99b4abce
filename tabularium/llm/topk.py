"""Exact top-k inner-product search with two cover trees.

The tree's top level is one for all rows: cells around a bounded number of centres, to the nearest of which every vector is dealt,
and large cells split into parts by hash. A query group (the queries of a cell, QUERY_BLOCK of them at most) first meets one
part of its own cell, and then those parts of cells that may hold something better, together with other small groups that go there. Each meeting is one group of a co-grouped job, which
indexes both sides with a cover tree:
a node has a centre, covers its members within a radius, and its children are centred on members found farthest first.
For a query node Q and a data node P no score between members exceeds
    <q, p> + |q| * radius(P) + |p| * radius(Q) + radius(Q) * radius(P),
so the pair is dropped once that lies below the worst k-th score of Q's queries; cells are dropped by the same bound, before
their rows are shuffled. What remains is scored exactly, in integers.

Of equal vectors only the k + 1 with the smallest ids can be among anyone's k best, so a vector that very many rows share
costs no more than k + 1 rows. Vectors that are null or hold null or non-finite components take no part; vectors of different
lengths don't meet; rows that repeat an id and its vector count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import remove, ship, written

QUERY_BLOCK, DATA_BLOCK, LEAF, FANOUT = 4096, 16384, 64, 32
#: Cells of the top level (but one for each length at least), rows a cell before there are so many, and rows to pick centres from.
CELLS, CELL_ROWS, SAMPLE = 128, 16384, 1024
#: What no score lies below, and the rounding of bounds by their terms.
NOTHING, SLACK = int(np.iinfo(np.int64).min), 1e-9


class CoverTree:
    """Nodes over rows of points: centre, radius and either children or member rows."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.rows: list[np.ndarray] = []
        todo = [(np.arange(len(points)), -1)]
        while todo:
            rows, parent = todo.pop()
            node = len(self.centre)
            if parent >= 0:
                self.children[parent].append(node)
            centre = points[rows].mean(0) if parent < 0 else points[rows[0]]
            far = np.sqrt(((points[rows] - centre) ** 2).sum(1))
            self.centre.append(centre)
            self.radius.append(float(far.max()))
            self.children.append([])
            self.rows.append(rows)
            if len(rows) > LEAF and far.max() > 0:
                todo += [(part, node) for part in self._split(rows, far)]
        self.centres, self.radii = np.array(self.centre), np.array(self.radius)
        self.norms = np.sqrt((self.centres**2).sum(1))

    def _split(self, rows: np.ndarray, far: np.ndarray) -> list[np.ndarray]:
        """Cells around centres taken farthest first until half the radius is covered, or there are FANOUT of them."""
        points, goal = self.points[rows], far.max() / 2
        centre = int(far.argmax())
        near = np.full(len(rows), np.inf)
        cell = np.zeros(len(rows), np.int64)
        centres: list[int] = []
        while len(centres) < FANOUT and (not centres or near.max() > goal):
            gap = np.sqrt(((points - points[centre]) ** 2).sum(1))
            closer = gap < near
            near[closer], cell[closer] = gap[closer], len(centres)
            centres.append(centre)
            centre = int(near.argmax())
        out = []
        for k, c in enumerate(centres):
            members = np.flatnonzero(cell == k)
            if len(members):  # the cell's centre comes first
                out.append(np.concatenate([[rows[c]], rows[members[members != c]]]))
        return out


class Best:
    """The k best (score, id) of each query so far, ties to smaller ids; what lies below a query's floor doesn't count."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None) -> None:
        self.k = k
        self.floor = np.full(queries, NOTHING) if floor is None else floor
        self.score = np.full((queries, k), np.iinfo(np.int64).min)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def worst(self, rows: np.ndarray) -> int:
        """The score that something new has to reach to matter to any of these queries."""
        return int(np.maximum(self.score[rows, -1], self.floor[rows]).min())

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """scores [rows, ids]; own: the queries' own ids, which don't count."""
        hopeful = (scores >= np.maximum(self.score[rows, -1], self.floor[rows])[:, None]) & (ids[None, :] != own[:, None])
        for k in np.flatnonzero(hopeful.any(1)):
            at = hopeful[k]
            score = np.concatenate([self.score[rows[k]], scores[k, at]])
            who = np.concatenate([self.id[rows[k]], ids[at]])
            best = np.lexsort((who, -score.astype(np.float64)))[: self.k] if np.abs(score[score > np.iinfo(np.int64).min]).max(initial=0) < 1 << 53 else np.array(sorted(range(len(who)), key=lambda i: (-int(score[i]), int(who[i])))[: self.k])
            self.score[rows[k]], self.id[rows[k]] = score[best], who[best]


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of each query's k best among vectors that reach its floor; integer rows on both sides."""
    best = Best(len(queries), k, floor)
    small = len(queries) and len(vectors) and float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, queries.shape[1]) < 2**53
    q_rows, p_rows = (queries.astype(np.float64), vectors.astype(np.float64))
    exact_q, exact_p = (q_rows, p_rows) if small else (queries, vectors)
    q_tree, p_tree = CoverTree(q_rows), CoverTree(p_rows)

    def bounds(q: int, nodes: list[int]) -> np.ndarray:
        p = np.array(nodes)
        middle = p_tree.centres[p] @ q_tree.centres[q]
        more = q_tree.norms[q] * p_tree.radii[p] + p_tree.norms[p] * q_tree.radii[q] + q_tree.radii[q] * p_tree.radii[p]
        return middle + more + SLACK * (np.abs(middle) + more + 1)

    def score(q: int, p: int) -> None:
        a, b = q_tree.rows[q], p_tree.rows[p]
        best.add(a, np.rint(exact_q[a] @ exact_p[b].T).astype(np.int64) if small else exact_q[a] @ exact_p[b].T, ids[b], query_ids[a])

    def visit(q: int, nodes: list[int]) -> None:
        """Queries of node q against what data nodes remain, most promising first."""
        most = bounds(q, nodes)
        for i in np.argsort(-most):
            p = nodes[i]
            if most[i] < best.worst(q_tree.rows[q]):
                break  # all that follow are bounded lower still
            if not q_tree.children[q] and not p_tree.children[p]:
                score(q, p)
            elif p_tree.children[p] and (not q_tree.children[q] or p_tree.radii[p] >= q_tree.radii[q]):
                visit(q, p_tree.children[p])
            else:
                for child in q_tree.children[q]:
                    visit(child, [p])

    if len(queries) and len(vectors):
        visit(0, [0])
    at = np.flatnonzero(best.id.ravel() != np.iinfo(np.int64).max)
    return np.repeat(query_ids, k)[at], best.id.ravel()[at], best.score.ravel()[at]


def quantised(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each finite vector's components."""
    whole = "embedding is not null and vec_id is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    return vectors.select("vec_id", "embedding").filter(whole).select("vec_id", F.expr(f"transform(embedding, x -> cast(floor({scale}D * cast(x as double)) as bigint))").alias("v"))


def centres_of(rows: DataFrame) -> dict[int, np.ndarray]:
    """Centres of the tree's top level by the vectors' length: the more rows the more of them, fewer than 2 * CELLS in all.

    They are picked farthest first from the SAMPLE rows with the smallest hash of their id. Where they lie only decides how
    much is pruned; every row is dealt to the nearest, and a length that the sample misses has one cell without bounds.
    """
    most = int(min(CELLS, max(1, rows.count() // CELL_ROWS)))
    sample = [np.array(r["v"], np.float64) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()]
    out = {}
    for dim in sorted({len(x) for x in sample})[:most]:
        points = np.stack([x for x in sample if len(x) == dim])
        share = max(1, most * len(points) // max(1, len(sample)))
        chosen, near = [0], ((points - points[0]) ** 2).sum(1)
        while len(chosen) < share and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(1))
        out[dim] = points[chosen]
    return out


def dealt(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """rows (vec_id, v) with dim, cell and far: the vector's length, the nearest of its centres and the distance from it."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1)
            at, flat = np.asarray(v.offsets).astype(np.int64), np.asarray(v.values)
            dims, cell, far = np.diff(at), np.zeros(len(v), np.int32), np.full(len(v), np.inf)
            for dim in set(dims.tolist()) & centres.keys():
                pick = np.flatnonzero(dims == dim)
                points, near = flat[at[pick][:, None] + np.arange(dim)].astype(np.float64), centres[dim]
                cell[pick] = ((near**2).sum(1) - 2 * points @ near.T).argmin(1)
                far[pick] = np.sqrt(((points - near[cell[pick]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), v, pa.array(dims.astype(np.int32)), pa.array(cell), pa.array(far)], ["vec_id", "v", "dim", "cell", "far"])

    return rows.select("vec_id", "v").mapInArrow(deal, "vec_id long, v array<bigint>, dim int, cell int, far double")


def cell_bounds(spark: SparkSession, cells: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """(dim, q_cell, chunk, cell, bound): no score between q_cell's queries and cell's vectors exceeds the bound.

    Neighbouring cells with few queries make one chunk of QUERY_BLOCK queries at most. (2 * CELLS)**2 rows at most.
    """
    known = cells.filter(F.col("dim").isin(list(centres))).orderBy("dim", "cell").collect() if centres else []
    out: list[tuple[int, int, int, int, float]] = []
    chunk = load = 0
    for k, q in enumerate(known):
        if load + q["queries"] > QUERY_BLOCK or k and q["dim"] != known[k - 1]["dim"]:
            chunk, load = chunk + 1, 0
        load += q["queries"]
        for p in known:
            if q["dim"] == p["dim"] and q["queries"]:
                a, b = centres[q["dim"]][q["cell"]], centres[p["dim"]][p["cell"]]
                terms = np.array([a @ b, np.sqrt(a @ a) * p["radius"], np.sqrt(b @ b) * q["q_radius"], p["radius"] * q["q_radius"]])
                out.append((q["dim"], q["cell"], chunk, p["cell"], float(terms.sum() + SLACK * (np.abs(terms).sum() + 1))))
    return spark.createDataFrame(out, "dim int, q_cell int, chunk int, cell int, bound double")


def top_k(vectors: DataFrame, is_query: str, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of quantised vectors (vec_id, v) for the rows where is_query holds."""
    spark = vectors.sparkSession
    ship(spark)
    rows = written(vectors.select("vec_id", "v").filter("v is not null").distinct(), "vectors")
    centres = centres_of(rows)
    placed = written(dealt(rows, centres).withColumn("is_query", F.coalesce(F.expr(is_query), F.lit(False))), "placed")
    far_query = F.max(F.when(F.col("is_query"), F.col("far")))
    cells = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.count_if("is_query").alias("queries"), F.max("far").alias("radius"), far_query.alias("q_radius"))
    parts = lambda n, block: F.ceil(F.col(n) / block).cast("int")
    cells = written(cells.withColumns({"parts": parts("n", DATA_BLOCK), "q_parts": parts("queries", QUERY_BLOCK)}), "cells")
    of_cell = cells.select("dim", "cell", "parts", "q_parts")
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    same = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    data = placed.withColumn("__same", F.row_number().over(same)).filter(F.col("__same") <= k + 1).join(of_cell, ["dim", "cell"]).withColumn("part", part("parts"))
    queries = placed.filter("is_query").join(of_cell, ["dim", "cell"]).withColumn("q_part", part("q_parts")).withColumnRenamed("cell", "q_cell")
    every = lambda n: F.explode(F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)))
    group, block = ["dim", "q_cell", "q_part"], ["dim", "cell", "part"]

    def unpack(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        v = t.column("v").combine_chunks()
        flat = np.asarray(v.flatten() if not isinstance(v, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in v.chunks] or [pa.array([], pa.int64())]))
        return np.asarray(t.column("vec_id")), flat.reshape(t.num_rows, -1) if t.num_rows and len(flat) else np.zeros((t.num_rows, 0), np.int64)

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        empty = (np.zeros(0, np.int64),) * 3
        query, who, score = search(*unpack(a), *unpack(b), k, np.asarray(a.column("floor"))) if a.num_rows and b.num_rows else empty
        return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(who, pa.int64()), "score": pa.array(score, pa.int64())})

    def searched(left: DataFrame, right: DataFrame, by: list[str], name: str) -> DataFrame:
        # Both sides come from one table, so one gets columns of its own.
        right = right.select(*[F.col(c).alias(c) for c in (*by, "vec_id", "v")])
        met = left.select(*by, "vec_id", "v", "floor").groupBy(*by).cogroup(right.groupBy(*by))
        return written(met.applyInArrow(pair, "query_id long, vec_id long, score long"), name)

    # Each query group first meets a part of its own cell, which gives its queries something to beat.
    home = F.pmod(F.col("q_part"), F.col("parts"))
    left = queries.withColumns({"cell": F.col("q_cell"), "part": home, "floor": F.lit(NOTHING)})
    right = data.withColumn("q_cell", F.col("cell")).withColumn("q_part", every("q_parts")).filter(home == F.col("part"))
    near = searched(left, right, [*group, "cell", "part"], "near")
    floors = near.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    queries = written(queries.select(*group, "vec_id", "v").join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(NOTHING))), "queries")
    # Then only the cells whose bound reaches the worst of the group's k-th scores.
    worst = queries.groupBy(*group).agg(F.min("floor").alias("worst"))
    reached = worst.join(F.broadcast(cell_bounds(spark, cells, centres)), ["dim", "q_cell"], "left").filter("bound is null or bound >= worst")
    reached = reached.select(*group, F.coalesce("chunk", F.lit(-1)).alias("chunk"), F.coalesce("cell", F.lit(0)).alias("cell")).join(of_cell.select("dim", "cell", "parts"), ["dim", "cell"])
    visits = written(reached.withColumn("part", every("parts")).filter((F.col("cell") != F.col("q_cell")) | (F.col("part") != home)).select(*group, "chunk", "cell", "part"), "visits")
    meetings = visits.select(*block, "chunk", "q_part").distinct()
    far = searched(queries.join(visits, group), data.drop("q_parts", "parts").join(meetings, block), [*block, "chunk", "q_part"], "far")
    for done in (rows, placed, cells, queries, visits):
        remove(done)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.unionAll(far).distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL for the 5 best of the table embeddings, for ids divisible by 50.
TOP_5_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, p.vec_id, CAST(list_inner_product(q.v, p.v) AS BIGINT) AS score
  FROM v q JOIN v p ON q.vec_id <> p.vec_id AND len(q.v) = len(p.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
