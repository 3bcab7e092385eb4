"""What the operators share: intermediate tables, connected components, batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warpline.session import Scratch, shared_folder  # noqa: F401

#: The characters that separate words in all contracts of this subpackage.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Column names like ``names`` that no column in ``taken`` has, whatever the case of its letters."""
    used = {t.lower() for t in taken}
    out = []
    for name in names:
        new, n = f"_w_{name}", 0
        while new.lower() in used:
            new, n = f"_w{n}_{name}", n + 1
        used.add(new.lower())
        out.append(new)
    return out


def column(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the component's smallest node.

    Alternates large-star and small-star rounds until nothing changes, so the number of rounds grows
    with the logarithm of the component size. Every round is two aggregations, which combine before
    the shuffle, and two equi-joins, whose hot keys Spark can split. Nothing is collected but a
    count and a checksum.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = scratch.save(edges, "edges-0")
    before, turn = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        turn += 1
        edges = scratch.save(small, f"edges-{turn}")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"edges-{turn - 1}")
        if now == before:
            roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        before = now


#: Bits of the bitmap that ``among`` broadcasts: a table of at most this many / 64 rows of two numbers.
FILTER_BITS = 1 << 24


def among(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """``rows`` without most of those whose ``key`` is none of ``wanted_key``; the others all stay, and a join must decide.

    For joins that would shuffle long texts of which few have a partner: a bitmap of the wanted keys'
    hashes is broadcast, whose size ``FILTER_BITS`` bounds whatever the tables are. As it fills up
    (from ten million keys or so) it lets more rows pass. Both keys must have the same type; null keys go.
    """
    cell, bits = fresh(rows.columns, "cell", "bits")

    def place(of: Column) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(FILTER_BITS))

    bit = place(wanted_key)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    bitmap = wanted.where(wanted_key.isNotNull()).select(F.floor(bit / 64).alias(cell), one.alias(bits)).groupBy(cell).agg(F.bit_or(bits).alias(bits))
    at = place(key)
    found = rows.where(key.isNotNull()).join(F.broadcast(bitmap), F.floor(at / 64) == F.col(cell))
    return found.where(F.getbit(bits, (at % 64).cast("int")) == 1).select(*map(column, rows.columns))


def text_batches(batches: Iterator[pa.RecordBatch], most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``most_bytes``, one row at least, so that long texts do not add up."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * most_bytes / max(batch.nbytes, 1)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
