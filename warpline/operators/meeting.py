"""Which windows of two sides can meet at all, so that the others are never shuffled.

Most windows of a text are in no other text. Before windows are joined, 32 bits of each one's hash are dealt to ``BUCKETS``
in sorted blocks, four bytes a window, and each bucket returns a bitmap of what both sides have. The bitmaps are ``2**BITS`` bits
in all, whatever the tables are. Windows outside have no partner for certain; those inside go on to the exact join. As the bitmap fills up
(from some 10**8 shared windows on) it lets more windows pass, but never loses one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from warpline.functions import text as T

BITS, BUCKETS = 27, 1024
#: Windows that a task gathers before it deals them out.
BLOCK = 1 << 21


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(side, hashes) to (bucket, side, block): sorted different hashes of a bucket as bytes."""
    held: list[list[np.ndarray]] = [[], []]

    def flush(side: int) -> pa.RecordBatch:
        hashes = np.unique(np.concatenate(held[side]))
        held[side].clear()
        bucket = (hashes >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32)
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        blocks = [part.tobytes() for part in np.split(hashes, starts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(np.full(len(starts), side, dtype=np.int32)), pa.array(blocks, pa.binary())], names=["bucket", "side", "block"])

    for batch in batches:
        sides = batch.column(0).to_numpy(zero_copy_only=False)
        for side in (0, 1):
            mine = batch.column(1).filter(pa.array(sides == side)).flatten().to_numpy(zero_copy_only=False)
            for start in range(0, len(mine), BLOCK):
                held[side].append(mine[start : start + BLOCK].astype(np.uint32))
                if sum(map(len, held[side])) >= BLOCK:
                    yield flush(side)
    for side in (0, 1):
        if held[side]:
            yield flush(side)


def _shared(table: pa.Table) -> pa.Table:
    """The bitmap of a bucket, empty blocks left out by the caller."""
    side = table.column("side").to_numpy()
    blocks = table.column("block")
    one, two = (np.unique(np.frombuffer(b"".join(blocks[i].as_py() for i in np.flatnonzero(side == s).tolist()), dtype=np.uint32)) for s in (0, 1))
    both = np.intersect1d(one, two, assume_unique=True)
    bits = np.zeros(2**BITS // BUCKETS, dtype=np.uint8)
    bits[(both >> np.uint32(32 - BITS)) % len(bits)] = 1
    return pa.table({"bucket": table.column("bucket").slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def meeting(left: DataFrame, right: DataFrame, word_col: str = "w") -> Broadcast:
    """A bitmap of the windows that both tables have in their word arrays."""
    side = lambda df, n: df.select(F.lit(n).alias("side"), T.window_hashes(F.col(word_col)).alias("hashes"))
    dealt = side(left, 0).unionByName(side(right, 1)).mapInArrow(_dealt, "bucket int, side int, block binary")
    found = dealt.groupBy("bucket").applyInArrow(_shared, "bucket int, bits binary").toArrow()
    each = 2**BITS // BUCKETS // 8
    bitmap = np.zeros(2**BITS // 8, dtype=np.uint8)
    for bucket, bits in zip(found.column("bucket").to_pylist(), found.column("bits"), strict=True):
        bitmap[bucket * each : (bucket + 1) * each] = np.frombuffer(bits.as_py(), dtype=np.uint8)
    return left.sparkSession.sparkContext.broadcast(bitmap)


def meeting_places(word_array: Column, bitmap: Broadcast) -> Column:
    """array<int>: where windows begin that may be in both tables of the bitmap; all that are in both are among them."""

    def places(hashes: pa.Array) -> pa.Array:
        bits = bitmap.value
        flat = hashes.flatten().to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(hashes.value_lengths().to_numpy(zero_copy_only=False))))
        at = flat >> (32 - BITS)
        found = np.flatnonzero(bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)
        cuts = np.searchsorted(found, ends)
        row = np.searchsorted(ends, found, side="right") - 1
        return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array((found - ends[row]).astype(np.int32)))

    places.__annotations__ = {"hashes": pa.Array, "return": pa.Array}
    return F.arrow_udf(places, S.ArrayType(S.IntegerType()))(T.window_hashes(word_array))
