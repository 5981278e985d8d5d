"""Files of one table whose schemas drifted, and their rewrite to the evolved schema, matched by field ids.

Ranks without a global sort: a histogram over the high 16 bits of the key's crc32 (65,536 counts, however many rows),
exclusive prefix sums over it in two levels, and row_number within a bucket.  Rows then go to the task of their file,
sorted, and stream through it: batches are written as they come, a file never lies in memory whole.

A key that holds a large part of the rows would make its bucket one task's: keys with more than one row in HOT_SHARE are
counted apart (HOT_SHARE of them at most), their rows are dealt by a hash of the whole row to PIECES ordered pieces, and
ranked within those.

Defined cases: a null key counts as crc32 0 and comes before key values of the same crc32; rows equal in the key are
ordered by a hash of all columns, then by the columns; an empty table gives no file; further columns are not written.  A
float that is no number has no integer: NaN and infinities stand in the digest as ``nan``, ``inf`` and ``-inf``.

Lost executors: a task writes under a name of its own attempt and renames it, so a repeated task leaves one whole file;
the drifted files are removed only after every rewrite is done.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, shared_dir

HIGH = 16  # bits of the histogram
HOT_SHARE = 1024
HOT_LEAST = 10_000  # rows; fewer are no burden
PIECES = 256
FILES = 250

#: The evolved schema; field ids 1 to 10 in this order.
FIELDS = [("client_id", "int64"), ("master_id", "int64"), ("source", "string"), ("updated_at", "timestamp"), ("name", "string"), ("email", "string"), ("city", "string"), ("nation_id", "int64"), ("segment", "string"), ("balance", "double")]
SQL_TYPES = {"int64": "bigint", "string": "string", "timestamp": "timestamp_ntz", "double": "double"}
MISSING = {"nation_id": -1, "segment": "none"}
ROWS_A_GROUP = 1 << 16

SWAPPED, REVERSED, NARROWED_OUT, NARROWED = 1, 2, 4, 8  # bits of a version


# ---------------------------------------------------------------- exact ranks


def _crc(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")), F.lit(0))


def ranked(spark: SparkSession, df: DataFrame, key: str) -> tuple[DataFrame, int]:
    """``df`` with ``__rank`` (from 0) in the order of (crc32 of the decimal key, key), and the number of rows."""
    columns = df.columns
    rows = df.withColumn("__crc", _crc(F.col(key))).withColumn("__bucket", F.shiftright("__crc", 32 - HIGH).cast("int"))
    before = materialize(spark, prefix_sums(rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n"))))
    total = before.agg(F.sum("n")).first()[0] or 0
    tie = F.xxhash64(*columns)
    order = [F.col("__crc"), F.col(key).asc_nulls_first(), F.col("__tie"), *[F.col(c) for c in columns]]
    rows = rows.withColumn("__tie", tie)
    hot = _hot_keys(before, rows, key, total)
    if hot:
        return _ranked_hot(spark, rows, key, before, hot, order).select(*columns, "__rank"), total
    placed = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__bucket").orderBy(*order)))
    placed = placed.join(F.broadcast(before.select("__bucket", "before")), "__bucket")  # 2 ** HIGH rows at most
    return placed.withColumn("__rank", F.col("before") + F.col("__n") - 1).select(*columns, "__rank"), total


def prefix_sums(counts: DataFrame) -> DataFrame:
    """(__bucket, n, before) of (__bucket, n): sums of the buckets before, within 256 coarse buckets and over these."""
    coarse = F.shiftright("__bucket", HIGH - 8)
    fine = counts.withColumn("__coarse", coarse)
    sums = fine.groupBy("__coarse").agg(F.sum("n").alias("m"))  # 256 rows
    over = F.sum("m").over(Window.orderBy("__coarse").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("__coarse", F.coalesce(over, F.lit(0)).alias("start"))
    within = F.sum("n").over(Window.partitionBy("__coarse").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    return fine.withColumn("within", F.coalesce(within, F.lit(0))).join(F.broadcast(sums), "__coarse").select("__bucket", "n", (F.col("start") + F.col("within")).alias("before"))


def _hot_keys(before: DataFrame, rows: DataFrame, key: str, total: int) -> list:
    """(bucket, crc, key, rows) of the keys with more than one row in HOT_SHARE, in order: HOT_SHARE at most."""
    least = max(total // HOT_SHARE, HOT_LEAST)
    buckets = [r[0] for r in before.filter(F.col("n") > least).select("__bucket").collect()]  # HOT_SHARE at most
    if not buckets:
        return []
    counts = rows.filter(F.col("__bucket").isin(buckets)).groupBy("__bucket", "__crc", key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least)
    return sorted(counts.collect(), key=lambda r: (r[1], r[2] is not None, r[2] or 0))


def _ranked_hot(spark, rows: DataFrame, key: str, before: DataFrame, hot: list, order: list) -> DataFrame:
    """Ranks where some keys are hot: their rows are numbered by piece, the others by bucket, and each takes what precedes it."""
    number = F.lit(-1)
    for i, r in enumerate(hot):
        number = F.when(F.col(key).eqNullSafe(F.lit(r[2])), i).otherwise(number)
    rows = rows.withColumn("__hot", number).withColumn("__piece", F.when(F.col("__hot") >= 0, F.shiftright("__tie", 56).cast("int")).otherwise(0))  # the sign orders as the hash does
    unit = ["__bucket", "__hot", "__piece"]
    placed = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*unit).orderBy(*order)))
    # cold rows before each hot key, and rows of its pieces before each piece: HOT_SHARE * PIECES counts at most
    bucket_hot = spark.createDataFrame([(r[0], i, r[1], r[2], r[3]) for i, r in enumerate(hot)], "__bucket int, h int, hcrc bigint, hkey bigint, hn bigint")
    precedes = (F.col("__crc") < F.col("hcrc")) | ((F.col("__crc") == F.col("hcrc")) & (F.col("hkey").isNotNull() & (F.col(key).isNull() | (F.col(key) < F.col("hkey")))))
    cold = rows.filter("__hot < 0").join(F.broadcast(bucket_hot), "__bucket").filter(precedes).groupBy("h").agg(F.count(F.lit(1)).alias("cold"))
    pieces = rows.filter("__hot >= 0").groupBy("__hot", "__piece").agg(F.count(F.lit(1)).alias("n"))
    pieces = pieces.withColumn("in_key", F.coalesce(F.sum("n").over(Window.partitionBy("__hot").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    earlier = F.coalesce(F.sum("hn").over(Window.partitionBy("__bucket").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = bucket_hot.withColumn("earlier", earlier).join(cold, "h", "left").select(F.col("h").alias("__hot"), (F.col("earlier") + F.coalesce("cold", F.lit(0))).alias("base"))
    pieces = materialize(spark, pieces.join(F.broadcast(starts), "__hot").select("__hot", "__piece", (F.col("base") + F.col("in_key")).alias("offset")))
    placed = placed.join(F.broadcast(before.select("__bucket", "before")), "__bucket").join(F.broadcast(pieces), ["__hot", "__piece"], "left")
    # a cold row comes after the hot keys of its bucket that precede it
    after = F.lit(0)
    for r in hot:
        larger = F.col(key).isNotNull() if r[2] is None else F.coalesce(F.col(key) > r[2], F.lit(False))
        follows = (F.col("__crc") > r[1]) | ((F.col("__crc") == r[1]) & larger)
        after = after + F.when((F.col("__bucket") == r[0]) & follows, r[3]).otherwise(0)
    rank = F.col("before") + F.col("__n") - 1 + F.when(F.col("__hot") >= 0, F.col("offset")).otherwise(after)
    return placed.withColumn("__rank", rank)


# ---------------------------------------------------------------- files


def version_of(file_no: int) -> int:
    v = zlib.crc32(f"19:{file_no}".encode()) % 24
    return v if v <= 15 else 0


def _arrow(kind: str) -> pa.DataType:
    return {"int64": pa.int64(), "string": pa.string(), "timestamp": pa.timestamp("us"), "double": pa.float64(), "int32": pa.int32(), "float": pa.float32()}[kind]


def _field(name: str, kind: str, field_id: int) -> pa.Field:
    return pa.field(name, _arrow(kind), True, {b"PARQUET:field_id": str(field_id).encode()})


def evolved() -> pa.Schema:
    return pa.schema([_field(n, k, i) for i, (n, k) in enumerate(FIELDS, 1)])


def drifted(version: int) -> pa.Schema:
    """The evolved schema as a file of this version has it: the same ids, other names, order, columns or types."""
    fields = [[n, k, i] for i, (n, k) in enumerate(FIELDS, 1)]
    if version & NARROWED:
        fields = [[n, {"balance": "float", "nation_id": "int32"}.get(n, k), i] for n, k, i in fields]
    if version & NARROWED_OUT:
        fields = [f for f in fields if f[0] not in MISSING]
    if version & SWAPPED:
        fields = [[{"name": "email", "email": "name"}.get(n, n), k, i] for n, k, i in fields]
    if version & REVERSED:
        fields = [fields[0], *fields[:0:-1]]
    return pa.schema([_field(*f) for f in fields])


def ids_of(schema: pa.Schema) -> list[int]:
    return [int((f.metadata or {})[b"PARQUET:field_id"]) for f in schema]


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _written(path: str, schema: pa.Schema, batches) -> int:
    """Rows written to ``path``, batch by batch, under a name of this attempt first."""
    import pyarrow.parquet as pq

    store, place = _store(path)
    folder, _, name = place.rpartition("/")
    own, rows = f"{folder}/_{name}.{uuid.uuid4().hex}", 0
    with store.open_output_stream(own) as sink, pq.ParquetWriter(sink, schema) as out:
        for batch in batches:
            out.write_batch(batch, row_group_size=ROWS_A_GROUP)
            rows += batch.num_rows
    store.move(own, place)
    return rows


def _cast(column: pa.Array, kind: pa.DataType) -> pa.Array:
    return column if column.type == kind else column.cast(kind, safe=False)


def _gathered(batches, least: int = ROWS_A_GROUP):
    """Batches of some ``least`` rows."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= least:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _as(batch: pa.RecordBatch, schema: pa.Schema, by_id: dict[int, str]) -> pa.RecordBatch:
    """``batch`` in ``schema``: columns by their field id; those it lacks take their default."""
    names = dict(enumerate((n for n, _ in FIELDS), 1))
    columns = []
    for f, i in zip(schema, ids_of(schema), strict=True):
        if i in by_id:
            columns.append(_cast(batch.column(by_id[i]), f.type))
        else:
            columns.append(pa.array([MISSING[names[i]]], f.type).take(pa.array([0] * batch.num_rows, pa.int32())))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def integer_text(column: pa.Array, factor: int = 1 << 20) -> pa.Array:
    """floor(factor * x) in decimal; exact, as the factor is a power of two."""
    import math

    import numpy as np

    x = column.cast(pa.float64()).to_numpy(zero_copy_only=False)
    with np.errstate(all="ignore"):
        y = np.floor(x * factor)
        small = np.abs(y) < 2.0**62  # not so for NaN
    text = np.where(small, y, 0).astype(np.int64).astype(str).astype(object)
    for i in np.flatnonzero(~small):
        text[i] = str(math.floor(y[i])) if math.isfinite(y[i]) else str(y[i])
    text[np.asarray(column.is_null())] = None
    return pa.array(text, pa.string())


def row_texts(batch: pa.RecordBatch) -> pa.Array:
    """A row's fields, ``|``-joined; null is ``?``, times are microseconds since 1970, floats :func:`integer_text`."""
    import pyarrow.compute as pc

    parts = []
    for c in batch.columns:
        if pa.types.is_timestamp(c.type):
            c = c.cast(pa.int64())
        parts.append(pc.fill_null(integer_text(c) if pa.types.is_floating(c.type) else c.cast(pa.string()), "?"))
    return pc.binary_join_element_wise(*parts, "|")


def digest(path: str) -> dict:
    """Counts, digests and columns of a file, read batch by batch."""
    import hashlib

    import pyarrow.parquet as pq

    store, place = _store(path)
    ids, rows, n, nulls = hashlib.sha256(), hashlib.sha256(), 0, 0
    with store.open_input_file(place) as source:
        file = pq.ParquetFile(source)
        for batch in file.iter_batches(batch_size=ROWS_A_GROUP):
            for h, texts, mark in ((ids, batch.column(0).cast(pa.string()).fill_null("?"), b","), (rows, row_texts(batch), b"\n")):
                h.update((mark if n else b"") + mark.decode().join(texts.to_pylist()).encode())
            n += batch.num_rows
            nulls += sum(c.null_count for c in batch.columns)
        names = file.schema_arrow.names
    return {"n_rows": n, "n_nulls": nulls, "ids_sha256": ids.hexdigest(), "rows_sha256": rows.hexdigest(), "columns": ",".join(names)}


def _name(folder: str, file_no: int, kind: str) -> str:
    return f"{folder}/{kind}-{file_no:05d}.parquet"


STARTED = "file_no int, version int, start_columns string, start_path string, written bigint"


def write_drifted(spark: SparkSession, df: DataFrame, folder: str, key: str = "client_id", files: int = FILES) -> DataFrame:
    """Write ``df`` to at most ``files`` files of ``folder``, in order, each in the schema of its version: a row a file."""
    plain = df.select(*[F.col(n).cast(SQL_TYPES[k]).alias(n) for n, k in FIELDS])
    placed, total = ranked(spark, plain, key)
    size = 1 + total // files
    placed = placed.withColumn("file_no", F.expr(f"cast(__rank div {size} as int)"))
    by_file = placed.repartitionById(files, "file_no").sortWithinPartitions("file_no", "__rank")

    def write(key_: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_no = key_[0].as_py()
        version = version_of(file_no)
        schema = drifted(version)
        by_id, state = dict(enumerate((n for n, _ in FIELDS), 1)), file_no * size

        def in_order():
            nonlocal state
            for batch in _gathered(batches):
                rank = batch.column(batch.schema.get_field_index("__rank")).to_numpy()
                if rank[0] != state or (rank[1:] - rank[:-1] != 1).any():
                    raise ValueError(f"rows of file {file_no} come out of order")
                state = int(rank[-1]) + 1
                yield _as(batch, schema, by_id)

        path = _name(folder, file_no, "part")
        n = _written(path, schema, in_order())
        yield pa.RecordBatch.from_pydict({"file_no": pa.array([file_no], pa.int32()), "version": pa.array([version], pa.int32()), "start_columns": [",".join(schema.names)], "start_path": [path], "written": [n]})

    return materialize(spark, by_file.groupBy("file_no").applyInArrow(write, STARTED))


def rewrite(spark: SparkSession, started: DataFrame, folder: str, files: int = FILES) -> DataFrame:
    """Turn every drifted file of ``started`` into one of the evolved schema; then remove the drifted ones: a row a final file."""

    def one(key_: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            for row in batch.to_pylist():  # one
                path = row["start_path"]
                if row["version"]:
                    store, place = _store(path)
                    with store.open_input_file(place) as source:
                        file = pq.ParquetFile(source)
                        by_id = dict(zip(ids_of(file.schema_arrow), file.schema_arrow.names, strict=True))
                        path = _name(folder, row["file_no"], "evolved")
                        n = _written(path, evolved(), (_as(b, evolved(), by_id) for b in file.iter_batches(batch_size=ROWS_A_GROUP)))
                    if n != row["written"]:
                        raise ValueError(f"file {row['file_no']} has {n} rows of {row['written']}")
                found = {**row, **digest(path), "path": path, "rewritten": row["version"] != 0}
                yield pa.RecordBatch.from_pylist([{f.name: found[f.name] for f in out}], schema=out)

    out = pa.schema(
        [("file_no", pa.int32()), ("version", pa.int32()), ("n_rows", pa.int64()), ("n_nulls", pa.int64()), ("ids_sha256", pa.string()), ("rows_sha256", pa.string()), ("start_columns", pa.string()), ("columns", pa.string()), ("path", pa.string()), ("rewritten", pa.bool_())]
    )
    kinds = {"int32": "int", "int64": "bigint", "string": "string", "bool": "boolean"}
    schema = ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in out)
    done = materialize(spark, started.repartitionById(files, "file_no").groupBy("file_no").applyInArrow(one, schema))
    _clean(spark, folder, [r.start_path for r in started.filter("version <> 0").select("start_path").collect()])  # ``files`` at most
    return done


def _clean(spark: SparkSession, folder: str, drifted_paths: list[str]) -> None:
    """Remove the drifted files, and what lost attempts left."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    for p in drifted_paths:
        store.delete(spark._jvm.org.apache.hadoop.fs.Path(p), False)
    for status in store.listStatus(place):
        if status.getPath().getName().startswith("_"):
            store.delete(status.getPath(), False)


def new_folder(spark: SparkSession) -> str:
    """A new folder under the shared one."""
    folder = f"{shared_dir(spark)}/drift-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
    return folder
