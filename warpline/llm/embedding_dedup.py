"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells.

Centres are fitted on a bounded sample (``SAMPLE`` rows); every vector is assigned to the cell of its
nearest centre, its home, and is also a guest of each cell whose home vectors could be close enough:
x, at an angle of at most acos(t) from y, can only be at home beyond the plane between two centres
if y is no farther than sin(acos(t)) from that plane. So comparing a cell's home vectors with its
home vectors and guests loses no pair, and a pair is counted once from each side.

Equal vectors are one class with a multiplicity. A cell is cut into a grid of blocks of about
``BLOCK`` classes, so no task holds more than two blocks, however dense a group is; a block product
returns one row per vector with its number of links and the smallest node it is connected to there,
never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warpline.llm.common import Scratch, connected_components

THRESHOLD, SAMPLE, BLOCK, MOST_CELLS, ROUNDS = 0.93, 16_384, 2_048, 1_024, 12


def fit_centres(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means on unit rows: the centres, as unit rows. Starts from rows spread over the sample's order."""
    cells = max(1, min(cells, len(sample)))
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        nearest = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centres)
    return np.unique(centres, axis=0)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(len(column), -1)


def _assign(centres: dict[int, np.ndarray], threshold: float):
    reach = float(np.sqrt(1 - threshold**2)) + 1e-9

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(rows))
                c = centres[int(dim)]
                apart = np.linalg.norm(c[:, None, :] - c[None, :, :], axis=2) if len(c) <= 256 else None
                for start in range(0, len(rows), 1024):
                    piece = part.slice(start, 1024)
                    scores = _matrix(piece.column("vec")) @ c.T
                    home = np.argmax(scores, axis=1)
                    gap = apart[home] if apart is not None else np.stack([np.linalg.norm(c - c[h], axis=1) for h in home])
                    member = scores[np.arange(len(home)), home][:, None] - scores <= reach * gap + 1e-12
                    at, cell = np.nonzero(member)
                    out = piece.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [*out.columns, pa.array(cell.astype(np.int32)), pa.array(home[at] == cell)], names=[*out.schema.names, "cell", "home"]
                    )

    return assign


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrays to the bytes of unit vectors in double precision."""
    for batch in batches:
        vectors = [np.array(v, dtype=np.float64) for v in batch.column("v").to_pylist()]
        packed = []
        for v in vectors:
            v = v / np.abs(v).max()
            packed.append((v / np.linalg.norm(v)).astype("<f8").tobytes())
        i = batch.schema.get_field_index("v")
        yield batch.set_column(i, "vec", pa.array(packed, pa.binary()))


def _smallest_nodes(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the bipartite links ``near`` the smallest node number of each row's and column's component."""
    top = np.iinfo(np.int64).max
    while True:
        new_right = np.minimum(right, np.where(near, left[:, None], top).min(axis=0, initial=top))
        new_left = np.minimum(left, np.where(near, new_right[None, :], top).min(axis=1, initial=top))
        if (new_right == right).all() and (new_left == left).all():
            return left, right
        left, right = new_left, new_right


def _compare(threshold: float):
    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        is_home = table.column("as_home").to_numpy(zero_copy_only=False).astype(bool)
        homes, members = table.filter(pa.array(is_home)), table.filter(pa.array(~is_home))
        if not homes.num_rows or not members.num_rows:
            return pa.table({"node": pa.array([], pa.string()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.string())})
        h, m = (_matrix(x.column("vec").combine_chunks()) for x in (homes, members))
        near = h @ m.T >= threshold
        names, codes = np.unique(np.array(homes.column("node").to_pylist() + members.column("node").to_pylist()), return_inverse=True)
        left, right = codes[: len(h)].astype(np.int64), codes[len(h) :].astype(np.int64)
        near &= left[:, None] != right[None, :]
        links = near @ members.column("copies").to_numpy(zero_copy_only=False).astype(np.int64)
        low_left, low_right = _smallest_nodes(near, left, right)
        rows, cols = np.flatnonzero(links > 0), np.flatnonzero(low_right != right)
        return pa.table(
            {
                "node": pa.array([*names[left[rows]], *names[right[cols]]], pa.string()),
                "links": pa.array([*links[rows].tolist(), *[0] * len(cols)], pa.int64()),
                "root": pa.array([*names[low_left[rows]], *names[low_right[cols]]], pa.string()),
            }
        )

    return compare


def embedding_groups(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", group_col: str = "label", threshold: float = THRESHOLD, block: int = BLOCK, sample: int = SAMPLE
) -> DataFrame:
    """One row per row of ``vectors``: id, n_links (other vectors linked directly), component_id, kept.

    Vectors with equal, non-null groups and as many components are linked at a cosine of
    ``threshold`` or more, in double precision. component_id is the smallest id reachable, the row's
    own included, and kept says that it is the row's own. A vector that is null, empty or zero, or
    holds a null or non-finite component, and one without a group, links with nothing; so its
    component_id is its own id. Rows with equal ids are different vectors; a null id is never the
    smallest. An empty table gives an empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    v = F.transform(vec_col, lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    valid = F.col(group_col).isNotNull() & F.col(vec_col).isNotNull() & F.coalesce(finite, F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(group_col).alias("part"), F.when(valid, v).alias("v"))
    # Zero has one sign, so equal vectors have equal keys.
    rows = rows.withColumn("v", F.transform("v", lambda x: x + 0.0))
    node = F.concat(*[F.lower(F.lpad(F.hex(F.xxhash64(F.lit(s), "part", "v")), 16, "0")) for s in (1, 2)])
    rows = rows.withColumn("node", F.when(F.col("v").isNotNull(), node))
    classes = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("part").alias("part"), F.first("v").alias("v"))
    classes = classes.select("node", "first", "copies", "part", F.size("v").alias("dim"), "v")
    kind = classes.schema["part"].dataType.simpleString()
    first = classes.schema["first"].dataType.simpleString()
    classes = scratch.save(classes.mapInArrow(_unit, f"node string, first {first}, copies bigint, part {kind}, dim int, vec binary"), "classes")

    sizes = {r["dim"]: (r["n"], r["parts"]) for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("part").alias("parts")).collect()}
    centres = {}
    for dim, (n, parts) in sizes.items():
        rows_ = classes.where(F.col("dim") == dim).orderBy("node").limit(sample).select("vec").collect()
        cells = min(MOST_CELLS, max(1, n // (max(parts, 1) * block)))
        centres[dim] = fit_centres(np.frombuffer(b"".join(bytes(r["vec"]) for r in rows_), dtype="<f8").reshape(-1, dim), cells)

    members = classes.select("node", "copies", "part", "dim", "vec").mapInArrow(_assign(centres, threshold), f"node string, copies bigint, part {kind}, dim int, vec binary, cell int, home boolean")
    members = scratch.save(members, "members")
    key = ["part", "dim", "cell"]
    grid = members.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    members = members.join(grid, key).withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    as_home = members.where("home").select(*key, F.col("own").alias("i"), others.alias("j"), "node", "copies", "vec", F.lit(True).alias("as_home"))
    as_member = members.select(*key, others.alias("i"), F.col("own").alias("j"), "node", "copies", "vec", F.lit(False).alias("as_home"))
    hits = as_home.unionByName(as_member).groupBy(*key, "i", "j").applyInArrow(_compare(threshold), "node string, links bigint, root string")
    hits = scratch.save(hits, "hits")

    roots = connected_components(hits.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    links = hits.groupBy("node").agg(F.sum("links").alias("links"))
    placed = classes.select("node", "first", "copies").join(links, "node", "left").join(roots, "node", "left")
    placed = placed.withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    placed = placed.join(least, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("id", "node").join(placed, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


#: DuckDB SQL for embedding_groups over the table embeddings: all pairs within labels, then closure.
GROUPS_SQL = """
with recursive v as (
    select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
), ok as (
    select *, sqrt(list_inner_product(e, e)) as norm from v
    where label is not null and e is not null and len(e) > 0 and list_bool_and(list_transform(e, lambda x: x is not null and isfinite(x))) and list_inner_product(e, e) > 0
), pairs as (
    select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id
    where list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
), reach(a, b) as (
    select vec_id, vec_id from v
    union
    select r.a, p.b from reach r join pairs p on r.b = p.a
), least as (
    select a, min(b) as component_id from reach group by a
)
select v.vec_id, (select count(*) from pairs p where p.a = v.vec_id)::bigint as n_links, l.component_id, l.component_id = v.vec_id as kept
from v join least l on l.a = v.vec_id
"""
