"""Exact top-k by inner product with a dual-tree search over cover trees.

Vectors become integers, floor(scale * x). Candidates are dealt by a hash of their id into chunks of
about ``CHUNK`` rows, queries into groups of about ``GROUP``; every pair of a group and a chunk is a
task of bounded size. There both are indexed by cover trees, and node pairs are visited best bound
first: the largest possible inner product of two nodes follows from their centres and covering radii, and a pair
is pruned if it is below the worst kth score of the queries under the query node. What is left at
the leaves is one matrix product. Each task returns k rows per query, and a window keeps the best.

The queries are a stated set that is compared with all rows, so the work is queries times rows at
worst; the trees lower it where the data have structure.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warpline.llm.common import Scratch

SCALE, TOP, CHUNK, GROUP, LEAF, TREE, BASE = 64, 20, 16_384, 2_048, 96, 4_096, 1.3


@dataclass
class Node:
    """``rows`` are all points below; ``radius`` covers them around ``centre``."""

    centre: np.ndarray
    radius: float
    rows: np.ndarray
    children: list[Node] = field(default_factory=list)


def build(points: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> Node:
    """A cover tree: a node's children are points farther apart than the next radius, which cover its rows.

    Children with few rows are kept as one leaf around the node's own centre.
    """
    centre = points[rows[0]]
    apart = np.sqrt(((points[rows] - centre) ** 2).sum(axis=1))
    node = Node(centre, float(apart.max()), rows)
    if len(rows) <= leaf or node.radius == 0:
        return node
    cover, rest, far, small = node.radius / BASE, rows, apart, []
    while len(rest):
        inside = far <= cover
        inside[0] = True
        own = rest[inside]
        if len(own) <= max(1, leaf // 8):
            small.append(own)
        else:
            node.children.append(build(points, own, leaf))
        rest = rest[~inside]
        if len(rest):
            far = np.sqrt(((points[rest] - points[rest[0]]) ** 2).sum(axis=1))
    if small:
        loose = np.concatenate(small)
        for start in range(0, len(loose), leaf):
            part = loose[start : start + leaf]
            middle = points[part].mean(axis=0)
            node.children.append(Node(middle, float(np.sqrt(((points[part] - middle) ** 2).sum(axis=1)).max()), part))
    return node


class Search:
    """The best ``k`` of candidates added so far for each query; ties go to the smaller id."""

    def __init__(self, queries: np.ndarray, keys: np.ndarray, k: int):
        self.points, self.keys, self.k = queries, keys, k
        self.scores = np.full((len(keys), k), -np.inf)
        self.found = np.full((len(keys), k), np.iinfo(np.int64).max)
        self.tree = build(queries, np.arange(len(keys)))

    def add(self, points: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        """Candidates with their ids, and the keys by which a query knows its own row."""
        root, order = build(points, np.arange(len(ids))), count()
        todo = [(-self._bound(self.tree, root), next(order), self.tree, root)]
        while todo:
            bound, _, q, c = heapq.heappop(todo)
            if -bound < self.scores[q.rows, -1].min():
                continue
            if not q.children and not c.children:
                self._leaf(q.rows, points[c.rows], ids[c.rows], keys[c.rows])
            elif c.children and (c.radius >= q.radius or not q.children):
                todo_new = [(q, x) for x in c.children]
            else:
                todo_new = [(x, c) for x in q.children]
            if q.children or c.children:
                for a, b in todo_new:
                    heapq.heappush(todo, (-self._bound(a, b), next(order), a, b))

    @staticmethod
    def _bound(q: Node, c: Node) -> float:
        """No inner product below the two nodes exceeds this; a little more than exact, for rounding."""
        most = float(q.centre @ c.centre) + q.radius * float(np.linalg.norm(c.centre)) + c.radius * (float(np.linalg.norm(q.centre)) + q.radius)
        return most + 1e-9 * (1 + abs(most))

    def _leaf(self, rows: np.ndarray, points: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        scores = self.points[rows] @ points.T
        scores[self.keys[rows][:, None] == keys[None, :]] = -np.inf
        better = (scores >= self.scores[rows, -1][:, None]).any(axis=1)
        if not better.any():
            return
        rows, scores = rows[better], scores[better]
        all_scores = np.concatenate([self.scores[rows], scores], axis=1)
        all_ids = np.concatenate([self.found[rows], np.broadcast_to(ids, scores.shape)], axis=1)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, : self.k]
        self.scores[rows] = np.take_along_axis(all_scores, order, axis=1)
        self.found[rows] = np.take_along_axis(all_ids, order, axis=1)


def _ints(column: pa.ChunkedArray) -> np.ndarray:
    """Integer vectors as doubles where all products are exact in them, else as Python integers."""
    rows = np.array(column.to_pylist(), dtype=np.int64).reshape(len(column), -1)
    return rows


def _search(k: int):
    names = ["row", "query_id", "vec_id", "score"]

    def search(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        q, c = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        if not q.num_rows or not c.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        (ids, keys), points = (c.column(n).to_numpy() for n in ("vec_id", "row")), _ints(c.column("v"))
        (qids, qkeys), qpoints = (q.column(n).to_numpy() for n in ("vec_id", "row")), _ints(q.column("v"))
        exact = int(np.abs(points).max(initial=0)) * int(np.abs(qpoints).max(initial=0)) * max(points.shape[1], 1) < 2**52
        if exact:
            run = Search(qpoints.astype(np.float64), qkeys, k)
            order = np.argsort(ids, kind="stable")
            for start in range(0, len(ids), TREE):
                part = order[start : start + TREE]
                run.add(points[part].astype(np.float64), ids[part], keys[part])
            at, place = np.nonzero(np.isfinite(run.scores))
            return pa.table([qkeys[at], qids[at], run.found[at, place], run.scores[at, place].astype(np.int64)], names=names)
        rows: list[tuple[int, int, int, int]] = []
        for key, i, point in zip(qkeys.tolist(), qids.tolist(), qpoints.tolist(), strict=True):  # products too large for doubles
            scored = ((-sum(a * b for a, b in zip(point, x, strict=True)), j) for own, j, x in zip(keys.tolist(), ids.tolist(), points.tolist(), strict=True) if own != key)
            rows += [(key, i, j, -s) for s, j in heapq.nsmallest(k, scored)]
        return pa.table([pa.array([r[n] for r in rows], pa.int64()) for n in range(4)], names=names)

    return search


def top_products(vectors: DataFrame, asks: Column, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, k: int = TOP, chunk: int = CHUNK, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best candidates of each query, all if there are fewer.

    Queries are the rows for which ``asks`` holds; candidates all rows but the query's own. Ties go to the
    smaller id. Vectors are compared with those of as many components. A vector that is null or
    empty, or holds a null or non-finite component, and a row without an id take no part. Rows that
    repeat an id are rows of their own: each such query has its own ranks, and each such candidate its own place. A score beyond 64 bits is an error. An empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession, "topk")
    v = F.transform(vec_col, lambda x: x.cast("double"))
    valid = F.col(id_col).isNotNull() & (F.size(vec_col) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(valid).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"), F.coalesce(asks, F.lit(False)).alias("asks"))
    # Rows are numbered once, in a table that is written before it is read.
    rows = scratch.save(rows.withColumns({"dim": F.size("v"), "row": F.monotonically_increasing_id()}), "rows")
    n = rows.agg(F.count(F.lit(1)).alias("all"), F.count(F.when(F.col("asks"), 1)).alias("asks")).first()
    chunks, groups = max(1, -(-n["all"] // chunk)), max(1, -(-n["asks"] // group))
    deal = lambda seed, parts: F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    queries = rows.where("asks").select("dim", deal(1, groups).alias("g"), each(chunks).alias("c"), "row", "vec_id", "v", F.lit(True).alias("asks"))
    candidates = rows.select("dim", each(groups).alias("g"), deal(2, chunks).alias("c"), "row", "vec_id", "v", F.lit(False).alias("asks"))
    found = queries.unionByName(candidates).groupBy("dim", "g", "c").applyInArrow(_search(k), "row bigint, query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL for top_products over the table embeddings: every query against every row.
TOP_SQL = """
with v as (
    select row_number() over () as own, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
    where vec_id is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
), scored as (
    select q.own, q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score from v q join v c on q.own <> c.own and q.vec_id % 20 = 0
), ranked as (
    select query_id, row_number() over (partition by own order by score desc, vec_id)::int as rank, vec_id, score from scored
)
select * from ranked where rank <= 20
"""
