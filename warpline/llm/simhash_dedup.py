"""SimHash near-duplicates by anchor-point covering.

Fingerprints that differ in at most ``THRESHOLD`` bits are linked. The anchors are the words of a
covering code: two binary Golay codes of length 23 and covering radius 3, each over its own 23 bits
of the fingerprint. A fingerprint has one home, the anchor within the covering radius in both
blocks, and is replicated to every anchor within radius plus threshold (the threshold is shared by
the blocks). If x and y differ in at most ``THRESHOLD`` bits, y is replicated to x's home by the
triangle inequality, so comparing homes with replicas per anchor loses no pair. There are 2**24
anchors and 61 replicas of a fingerprint on average.

Equal fingerprints are one class before anything is compared, so a group of exact copies is one row.
A fingerprint has at most 2080 others within two bits, so the links of different fingerprints stay
linear in their number; the join per anchor is an equi-join whose hot anchors Spark can split.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warpline.llm.common import Scratch, connected_components, text_batches

LENGTH, RADIUS, THRESHOLD = 23, 3, 2
#: Fingerprints that one task replicates; their table is slim, so its files alone would make few tasks.
TASK_PRINTS = 20_000
#: Generator of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@lru_cache(1)
def code_tables() -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The syndrome of each bit, and for 0, 1 and 2 steps beyond the radius the error patterns of each syndrome."""
    bits = np.array([_remainder(1 << i) for i in range(LENGTH)], dtype=np.int64)
    tables = []
    for extra in range(THRESHOLD + 1):
        weights = range(RADIUS + 1) if not extra else [RADIUS + extra]
        patterns = [(int(np.bitwise_xor.reduce(bits[list(c)])) if c else 0, sum(1 << i for i in c)) for w in weights for c in combinations(range(LENGTH), w)]
        patterns.sort()
        syndromes = np.array([s for s, _ in patterns])
        starts = np.searchsorted(syndromes, np.arange(2049))
        tables.append((starts, np.array([p for _, p in patterns], dtype=np.int64)))
    return bits, tables


def _syndromes(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), dtype=np.int64)
    for i in range(LENGTH):
        out ^= np.where(words >> i & 1, bits[i], 0)
    return out


def _near(words: np.ndarray, extra: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each 23-bit word the anchors ``extra`` steps beyond the radius: counts per word, starts, anchors."""
    bits, tables = code_tables()
    starts, patterns = tables[extra]
    s = _syndromes(words, bits)
    n = starts[s + 1] - starts[s]
    at = np.repeat(starts[s] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    return n, np.concatenate(([0], np.cumsum(n)[:-1])), np.repeat(words, n) ^ patterns[at]


def anchors(prints: np.ndarray, replicas: bool) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``prints``, anchor) of every home, or of every replica."""
    mask = (1 << LENGTH) - 1
    blocks = [prints & mask, prints >> LENGTH & mask]
    lists = [[_near(b, e) for e in range(THRESHOLD + 1 if replicas else 1)] for b in blocks]
    rows, found = [], []
    for e1, (n1, at1, a1) in enumerate(lists[0]):
        for e2, (n2, at2, a2) in enumerate(lists[1]):
            if e1 + e2 <= THRESHOLD:
                n = n1 * n2
                row = np.repeat(np.arange(len(prints)), n)
                k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                rows.append(row)
                found.append(a1[at1[row] + k // n2[row]] | a2[at2[row] + k % n2[row]] << LENGTH)
    return np.concatenate(rows), np.concatenate(found)


def _spread(replicas: bool):
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for start in range(0, len(values), 4096):
                part = values[start : start + 4096]
                rows, found = anchors(part, replicas)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(part[rows])], names=["anchor", "print"])

    return spread


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of a text's word shingles in order, repeats included; fewer words are one shingle, none are none."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    if len(words) <= width:
        return np.array([xxh64_intdigest(b" ".join(words), 42)], dtype="<u8")
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - width].tolist()]
    return np.array([xxh64_intdigest(line[s:e], 42) for s, e in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], dtype="<u8")


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[start : start + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return ones


def text_print(text: str | None, width: int) -> int:
    """The signed 64-bit fingerprint of a text's word shingles."""
    hashes = shingle_hashes(text, width)
    return int(np.packbits(_ones(hashes) * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns, print): the SimHash of every whole text. Null and empty texts have the fingerprint zero."""
    names = [id_col, *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            prints = [text_print(t, width) for t in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(prints, pa.int64())], names=[*names, "print"])

    slim = docs.select(*names, text_col)
    kinds = ", ".join(f"{c} {slim.schema[c].dataType.simpleString()}" for c in names)
    return slim.mapInArrow(run, f"{kinds}, print bigint")


def hex_print(column: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def print_links(prints: DataFrame) -> DataFrame:
    """(a, b), a < b, for all pairs of different values of column ``print`` (distinct) within the threshold.

    The join must merge: the planner takes the replicas for as small as the prints they are made of, and would have the driver gather and broadcast them.
    """
    prints = prints.select("print").repartition(max(1, prints.count() // TASK_PRINTS), "print")
    homes = prints.mapInArrow(_spread(False), "anchor bigint, print bigint")
    replicas = prints.mapInArrow(_spread(True), "anchor bigint, print bigint")
    h, r = homes.alias("h"), replicas.alias("r")
    near = (F.col("h.print") < F.col("r.print")) & (F.bit_count(F.col("h.print").bitwiseXOR(F.col("r.print"))) <= THRESHOLD)
    return h.join(r.hint("merge"), (F.col("h.anchor") == F.col("r.anchor")) & near).select(F.col("h.print").alias("a"), F.col("r.print").alias("b"))


def simhash_groups(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id, and the columns to ``carry``.

    component_id is the smallest id reachable through links of at most two differing bits, the row's
    own included. Null and empty texts share the fingerprint zero and are linked like any other;
    rows without an id are grouped too, and a group of such rows alone has a null component_id.
    Repeated rows stay. Other columns are ignored. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.save(fingerprints(docs, width, id_col, text_col, carry), "prints")
    classes = scratch.save(rows.groupBy("print").agg(F.min(id_col).alias("first")), "classes")
    roots = connected_components(print_links(classes), scratch)
    placed = classes.join(roots, classes["print"] == roots["node"], "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "root").select("print", "component_id")
    return rows.join(named, "print").select(id_col, hex_print("print").alias("fingerprint"), "component_id", *carry)
