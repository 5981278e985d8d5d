"""Helpers shared by the training-data operators: table access, shared scratch tables, worker set-up."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship


def prepare(spark: SparkSession) -> SparkSession:
    """Workers can import the package, take Arrow batches of 4 MiB and give freed memory back (see :func:`maskwell.ship`)."""
    return ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only where none is set and everything runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="maskwell-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    Lost executors cost only a re-read, and Python stages run once however often the result is used.
    """
    path = f"{shared_dir(spark)}/maskwell-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_at = path
    return back


def release(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote, once all that reads them is written itself."""
    for df in tables:
        spark, path = df.sparkSession, df.written_at
        path = spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(spark: SparkSession, minimum: int = 1) -> int:
    """Shuffle width: the session's setting, at least ``minimum``."""
    return max(minimum, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ranges(sizes, budget: int = 4 << 20):
    """Row ranges (start, stop) of at most ``budget`` bytes, or one row."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > budget:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def append_arrow(df: DataFrame, text_col: str, fields: list, work) -> DataFrame:
    """``df`` with columns ``fields`` that ``work(list of values of text_col)`` computes, in Arrow batches cut to a few MiB.

    ``work`` is called once a task, as a factory, and returns the function that maps values to Arrow arrays.
    Columns of ``df`` that clash with ``fields`` are replaced.
    """
    from pyspark.sql import types as T

    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    names = [f.name for f in df.schema.fields]
    take, at = [i for i, f in enumerate(df.schema.fields) if f in kept], names.index(text_col)
    schema = T.StructType([*kept, *[T.StructField(f.name, f.dataType, True) for f in fields]])
    out_names = schema.names

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        apply = work()
        for batch in batches:
            column = batch.column(at)
            sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist() if not pa.types.is_list(column.type) else [4 * n for n in pc.fill_null(pc.list_value_length(column), 0).to_pylist()]
            for a, b in ranges(sizes):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in take], *apply(part.column(at))], names=out_names)

    return df.mapInArrow(run, schema)


BITMAP = 32768  # bits of one bitmap of bitmap_construct_agg
FEWEST_BITS, MOST_BITS, BITS_A_KEY = 1 << 18, 1 << 30, 32  # a filter is 128 MiB at most


def width(keys: int) -> int:
    """Bits of a filter for so many keys: 3 % of the others pass it, up to 33 million keys; more pass beyond."""
    return min(MOST_BITS, max(FEWEST_BITS, 1 << (BITS_A_KEY * keys - 1).bit_length()))


def bits_of(slots: DataFrame, slot: str = "slot") -> DataFrame:
    """Filter (bucket, bits) of the numbers in column ``slot``, in DataFrame functions; built map-side, added up by bucket."""
    parts = slots.select(F.expr(f"`{slot}` div {BITMAP}").alias("bucket"), F.expr(f"`{slot}` % {BITMAP}").alias("bit"))
    return parts.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def tested(df: DataFrame, slot: str, filter_: DataFrame, name: str) -> DataFrame:
    """``df`` with boolean ``name``: whether the bit of its column ``slot`` is set in the filter, which is broadcast (MOST_BITS / 8 bytes at most)."""
    mine = F.broadcast(filter_.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits")))
    met = df.join(mine, F.expr(f"`{slot}` div {BITMAP}") == F.col("__bucket"), "left")
    byte = F.conv(F.hex(F.substring("__bits", (F.col(slot) % BITMAP / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.withColumn(name, F.coalesce(byte.bitwiseAND(F.expr(f"shiftleft(1, cast(`{slot}` % 8 as int))")) != 0, F.lit(False))).drop("__bucket", "__bits")


def without(docs: DataFrame, on: list[str], verdicts: DataFrame) -> DataFrame:
    """``docs`` without the rows whose columns ``on`` (nulls too) a row of ``verdicts`` (on..., gone) marks gone.

    ``verdicts`` is a narrow table with every key of ``docs``, each wholly gone or wholly kept.  A filter of the gone keys lets
    most kept rows pass; a second one, of the kept keys that it stops, drops most gone ones; only what both stop is joined.
    So hardly any text is shuffled, however many rows go.
    """
    spark = docs.sparkSession
    key = F.xxhash64(*on)
    gone = verdicts.filter("gone")
    bits = width(gone.count())
    first = materialize(spark, bits_of(gone.select(F.pmod(key, F.lit(bits)).alias("slot"))))
    stopped = materialize(spark, tested(verdicts.filter("not gone").select(*on, F.pmod(key, F.lit(bits)).alias("__slot")), "__slot", first, "__hit").filter("__hit").select(*on))
    more = width(stopped.count())
    second = materialize(spark, bits_of(stopped.select(F.pmod(F.xxhash64(F.lit(1), *on), F.lit(more)).alias("slot"))))
    hit = tested(docs.withColumn("__slot", F.pmod(key, F.lit(bits))), "__slot", first, "__hit").drop("__slot")
    passed = hit.filter("not __hit").drop("__hit")
    held = hit.filter("__hit").drop("__hit").withColumn("__slot", F.pmod(F.xxhash64(F.lit(1), *on), F.lit(more)))
    held = tested(held, "__slot", second, "__hit").filter("__hit").drop("__hit", "__slot")
    listed = gone.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(on)]).distinct()
    same = F.lit(True)
    for i, c in enumerate(on):
        same = same & F.col(c).eqNullSafe(F.col(f"__{i}"))
    return passed.unionByName(held.join(listed, same, "left_anti"))


FILTER_BITS = 1 << 26  # 8 MiB


def bits_array(slots: DataFrame, size: int):
    """Broadcast bitmap, ``size`` bits wide (MOST_BITS at most), of the numbers in the column ``slot``."""
    import numpy as np

    found = np.zeros((size // BITMAP, BITMAP // 8), np.uint8)
    for r in bits_of(slots).toLocalIterator():  # size / 8 bytes at most
        found[r.bucket] = np.frombuffer(r.bits, np.uint8)
    return slots.sparkSession.sparkContext.broadcast(found.reshape(-1))


def id_filter(ids: DataFrame):
    """Broadcast bitmap of the ids' slots (see :func:`id_slot`): a scan skips most rows not wanted and, as slots collide,
    lets a few too many through; an exact join follows."""
    return bits_array(ids.select(id_slot(ids.columns[0]).alias("slot")), FILTER_BITS)


def id_slot(column):
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))


def passing(bitmap, slots):
    """Which slots are set."""
    return bitmap[slots >> 3] >> (slots & 7).astype("uint8") & 1 == 1


def by_key(batches, limit: int):
    """(numpy columns, hot) of Arrow batches that come in order of their first column.

    Not hot: all rows of some keys.  Hot: a part of the rows of a key that has more than ``limit``.
    Holds one batch and ``limit`` rows at most.
    """
    import numpy as np

    def dealt(rows):
        edge = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1]]))
        size = np.diff(np.append(edge, len(rows[0])))
        if size.max() <= limit:
            yield rows, False
        else:
            many = np.repeat(size > limit, size)
            for use, hot in ((~many, False), (many, True)):
                if use.any():
                    yield [r[use] for r in rows], hot

    join = lambda parts: [np.concatenate(c) for c in zip(*parts, strict=True)] if len(parts) > 1 else parts[0]
    held, count, hot = [], 0, False  # of the last key so far; a hot key's rows are not held
    key = None
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not (n := len(rows[0])):
            continue
        same = int(np.searchsorted(rows[0], key, side="right")) if key is not None and rows[0][0] == key else 0
        if same and hot:
            yield [r[:same] for r in rows], True
            rows = [r[same:] for r in rows]
        elif same < n:
            if held:
                rows, held, count = join([*held, rows]), [], 0
        if not len(rows[0]):
            continue
        if same < n:
            key, hot = rows[0][-1], False
            last = int(np.searchsorted(rows[0], key))
            if last:
                yield from dealt([r[:last] for r in rows])
            rows = [r[last:] for r in rows]
        held.append(rows)
        count += len(rows[0])
        if count > limit:
            yield join(held), True
            held, count, hot = [], 0, True
    if held:
        yield join(held), False
