"""Exact deduplication behind a two-pass Bloom filter, in DataFrame functions only.

Pass 1 reads every text, hashes it (SHA-256), and counts, map-side first, how many rows
hit each slot of a Bloom filter; slots hit twice or more stay set.  The filter has 32
slots a row, a power of two, and one probe: a row sends one slot number, and 3 % of the
unique rows are taken for repeated ones; a second probe would send as much again to save
less than that.  The set slots are packed into bitmaps of 4 KiB (``bitmap_construct_agg``),
128 MiB altogether at most, so what is broadcast has a bound.  Pass 2 tests every row against
them: a row with an unset slot is certainly unique and passes straight through; only the
possibly repeated ones shuffle, as (hash, id) pairs, never as text.  False positives cost
a shuffled pair and never change a result; beyond some 10^9 rows the bound makes them most
of the rows, which then shuffle 40 bytes each.

Defined results: null text counts as empty text; empty texts equal each other;
rows with equal text and equal id are all ``kept`` if that id is the largest; a
group of null ids only keeps every row (keep_id null); an empty table gives no rows.
Columns besides ``id_col`` and ``text_col`` are not read by :func:`classify`, so
clashing names do no harm; :func:`dedup` hands all columns of kept rows on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bits_of, materialize, release, tested, width, without

PROBES = 1


def _slots(digest, probes: int, bits: int):
    """Slot numbers in [0, bits): disjoint 48-bit parts of the digest."""
    return [F.pmod(F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("long"), F.lit(bits)) for i in range(probes)]


def repeated_slots(hashed: DataFrame, bits: int, probes: int = PROBES) -> DataFrame:
    """Pass 1: bitmaps (bucket, bits) of the slots that two or more rows hit."""
    slots = _slots(F.col("text_sha256"), probes, bits)
    hits = hashed.select(slots[0].alias("slot")) if probes == 1 else hashed.select(F.explode(F.array(*slots)).alias("slot"))
    return bits_of(hits.groupBy("slot").agg(F.count(F.lit(1)).alias("hits")).filter("hits > 1"))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int | None = None, probes: int = PROBES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.  The largest id of a group stays."""
    spark = docs.sparkSession
    hashed = docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256"))
    hashed = materialize(spark, hashed)  # the texts are read once; the rest works on ids and digests
    bits = min(max_bits or width(1 << 62), width(hashed.count()))
    maps = materialize(spark, repeated_slots(hashed, bits, probes))
    maybe = hashed
    for i, slot in enumerate(_slots(F.col("text_sha256"), probes, bits)):
        maybe = tested(maybe.withColumn("__slot", slot), "__slot", maps, f"__set{i}").drop("__slot")
    maybe = materialize(spark, maybe.select("doc_id", "text_sha256", F.expr(" and ".join(f"__set{i}" for i in range(probes))).alias("__maybe")))
    release(hashed, maps)

    unique = maybe.filter(~F.col("__maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    suspects = maybe.filter("__maybe").select("doc_id", "text_sha256")
    # A hot group is summed map-side; then its rows meet their sum in a join whose two sides are
    # exchanged for it alone (the key is spelt anew), so that AQE can split a hot side.
    groups = suspects.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select(F.reverse("text_sha256").alias("__key"), "keep_id", "group_size")
    met = (
        suspects.withColumn("__key", F.reverse("text_sha256"))
        .join(groups, "__key")
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )
    return unique.unionByName(met)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input without the rows whose text an equal row with a larger id repeats; columns as they were.

    Rows that agree in id and text are one row's repeats: one of them stays.  Filters of the rows to drop
    let texts pass or go where they are; hardly any is shuffled (:func:`.common.without`).
    """
    spark = docs.sparkSession
    found = materialize(spark, classify(docs, id_col, text_col, **options))
    verdicts = found.select(F.col("doc_id").alias(id_col), F.col("text_sha256").alias("__hash"), (~F.col("kept")).alias("gone"))
    hashed = docs.withColumn("__hash", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    left = without(hashed, [id_col, "__hash"], verdicts)
    again = found.filter("kept and group_size > 1").groupBy(F.col("doc_id").alias(id_col), F.col("text_sha256").alias("__hash")).count().filter("count > 1").drop("count")
    if again.isEmpty():
        return left.drop("__hash")
    # Rows that may repeat an id and text get a number; the least of each such key stays, the other numbers go.
    left = materialize(spark, left.withColumn("__row", F.monotonically_increasing_id()))
    marks = again.select(F.col(id_col).alias("__a"), F.col("__hash").alias("__b"))
    rows = materialize(spark, left.select(id_col, "__hash", "__row").join(marks, F.col(id_col).eqNullSafe(F.col("__a")) & (F.col("__hash") == F.col("__b")), "left_semi"))
    first = rows.groupBy(id_col, "__hash").agg(F.min("__row").alias("__row")).select("__row")  # summed map-side
    extra = rows.select("__row").join(first, "__row", "left_anti").withColumn("gone", F.lit(True))
    others = left.select("__row").join(extra.select("__row"), "__row", "left_anti").withColumn("gone", F.lit(False))
    return without(left, ["__row"], materialize(spark, extra.unionByName(others))).select(*docs.columns)
