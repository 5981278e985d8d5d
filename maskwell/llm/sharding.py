"""Sharding by histogram sort: equal bytes a shard, found without sorting.

Every row gets a 62-bit key: the hash of its text above the hash of its id, so equal
texts lie together and even a group of a third of all rows can be cut finely.  The
splitters between shards are found by refinement: each round counts the exact bytes
below all probe keys in one pass over (key, size) and keeps, for each splitter, the
interval between the two probes around its target, until the bytes below a probe are
within ``tolerance`` of the target or the interval is one key.  Probes between groups
of equal texts are tried first; only where no such border is near enough does a
splitter cut a group.  Then the rows are exchanged once, by (shard, block of the id
hash), and numbered: a block's first slot is the number of rows in the shard's
earlier blocks, so no task holds a shard.

Defined results: null text has no bytes, its size is 1; null ids hash like any value;
repeated rows get slots of their own; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, spread

KEY_BITS, GROUP_BITS = 62, 38  # of them the upper GROUP_BITS come from the text
TOLERANCE = 0.002  # of a shard's share
PROBES = 2048  # keys counted at once
ROWS_A_BLOCK = 20_000


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, key."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = KEY_BITS - GROUP_BITS
    group = F.shiftrightunsigned(F.xxhash64(text), 64 - GROUP_BITS)
    member = F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 64 - low)
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.shiftleft(group, low).bitwiseOR(member).alias("key"))


def counts_below(rows: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, int]:
    """Exact bytes of the rows with key < probe for each sorted probe, and all bytes: one pass, one small row a task and cell."""

    def count(batches):
        import pyarrow as pa

        sums = np.zeros(len(probes) + 1, np.int64)
        for batch in batches:
            cell = np.searchsorted(probes, batch.column(0).to_numpy(zero_copy_only=False), side="right")
            sums += np.bincount(cell, batch.column(1).to_numpy(zero_copy_only=False), minlength=len(sums)).astype(np.int64)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["cell", "bytes"])

    found = rows.select("key", "size").mapInArrow(count, "cell long, bytes long").groupBy("cell").agg(F.sum("bytes").alias("bytes")).collect()
    cells = np.zeros(len(probes) + 1, np.int64)
    for r in found:  # len(probes) + 1 rows at most
        cells[r.cell] = r.bytes
    below = np.cumsum(cells)
    return below[:-1], int(below[-1])


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE, probes: int = PROBES) -> list[int]:
    """shards - 1 keys; shard i takes the keys from splitter i - 1 up to, not including, splitter i."""
    wide, step = 1 << KEY_BITS, 1 << (KEY_BITS - GROUP_BITS)
    bounds = [(0, wide) for _ in range(shards - 1)]  # below(low) <= target <= below(high)
    best: list[tuple[float, int]] = [(float("inf"), 0)] * (shards - 1)
    done, fine = [False] * (shards - 1), [False] * (shards - 1)
    while not all(done):
        each = max(2, probes // max(1, len({b for b, d in zip(bounds, done, strict=True) if not d})))
        wanted: set[int] = set()
        for (low, high), over, small in zip(bounds, done, fine, strict=True):
            if not over:
                unit = 1 if small else step
                width = (high - low) // unit
                wanted.update(low + unit * (width * i // (each + 1)) for i in range(each + 2))
        keys = np.array(sorted(k for k in wanted if 0 < k < wide), np.int64)
        if not len(keys):
            break
        below, total = counts_below(rows, keys)
        for i in range(shards - 1):
            if done[i]:
                continue
            target, allowed = total * (i + 1) / shards, max(1.0, tolerance * total / shards)
            low, high = bounds[i]
            inside = np.flatnonzero((keys >= low) & (keys <= high))
            for j in inside:
                best[i] = min(best[i], (abs(float(below[j]) - target), int(keys[j])))
            under = [int(keys[j]) for j in inside if below[j] <= target]
            over = [int(keys[j]) for j in inside if below[j] > target]
            bounds[i] = low, high = max([low, *under]), min([high, *over])
            unit = 1 if fine[i] else step
            if best[i][0] <= allowed or high - low <= 1:
                done[i] = True
            elif high - low <= unit:
                fine[i] = True
    return sorted(k for _, k in best)


def shard(docs: DataFrame, shards: int = 16, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row."""
    spark = docs.sparkSession
    rows = materialize(spark, keyed(docs, id_col, text_col))
    cuts = splitters(rows, shards, tolerance)
    number = sum((F.when(F.col("key") >= k, 1).otherwise(0) for k in cuts), F.lit(0)).cast("int")
    blocks = max(spread(spark), -(-rows.count() // ROWS_A_BLOCK))
    dealt = rows.withColumn("shard", number).withColumn("__block", F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(blocks)))
    filled = dealt.groupBy("shard", "__block").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    base = materialize(spark, filled.select("shard", "__block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__base")))
    own = Window.partitionBy("shard", "__block").orderBy("key", "doc_id")
    placed = dealt.withColumn("__rank", F.row_number().over(own) - 1).join(base, ["shard", "__block"])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("__base") + F.col("__rank")).cast("long").alias("slot"))
