"""Stored detection results: upsert by file, read the latest, get one.

The table is a log of versions, partitioned by (bucket of the file id, version).  An upsert overwrites the partitions of its
own version alone (dynamic partition overwrite), so an upsert that is repeated after a failure, or a micro-batch that is run
again, leaves what it left the first time; no lock and no rewrite of what others wrote.  Readers take each file's row of the
largest version: a map-side maximum, no join.  ``get`` reads one bucket.  ``compact`` folds versions into the last of them.

Defined cases: a null file id is refused; of rows that repeat a file id in one upsert the largest by ``order`` (else by all
columns) stays; a store that was never written is empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import shared_dir


def records(found: DataFrame, key: str = "doc_id", user: Column | None = None, high: float = 0.8) -> DataFrame:
    """What is stored of :func:`engine.detect`'s rows: file_id, user_id, entity_count, a summary and the candidates."""
    spans = F.col("spans")
    types = F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["type"])))
    by_type = F.map_from_arrays(types, F.transform(types, lambda t: F.size(F.filter(spans, lambda s: s["type"] == t)).cast("long")))
    summary = F.struct(
        F.size(spans).cast("long").alias("total_entities"), types.alias("entity_types"), by_type.alias("by_type"),
        F.size(F.filter(spans, lambda s: s["confidence"] >= high)).cast("long").alias("high_confidence_entities"), F.length("text").cast("long").alias("text_length"),
    )
    return found.select(F.col(key).cast("string").alias("file_id"), (F.lit(None) if user is None else user).cast("string").alias("user_id"), F.size(spans).cast("long").alias("entity_count"), summary.alias("summary"), spans.alias("candidates"))


class ResultStore:
    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.path = path or f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"

    def _bucket(self, file_id: Column) -> Column:
        return F.pmod(F.xxhash64(file_id), F.lit(self.buckets)).cast("int")

    def _folder(self):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _exists(self) -> bool:
        store, place = self._folder()
        return store.exists(place) and any(s.getPath().getName().startswith("bucket=") for s in store.listStatus(place))

    def upsert(self, rows: DataFrame, version: int, order: tuple[str, ...] = ()) -> None:
        """Store ``rows`` (file_id and any columns) as ``version``, larger than those before, or the same again."""
        names = [c for c in rows.columns if c != "file_id"]
        kept = F.struct(*names)
        by = F.struct(*order) if order else F.to_json(kept, {"ignoreNullFields": "false"})
        checked = F.when(F.col("file_id").isNull(), F.raise_error(F.lit("a stored result needs a file id"))).otherwise(F.col("file_id"))
        one = rows.withColumn("file_id", checked).groupBy("file_id").agg(F.max_by(kept, by).alias("r")).select("file_id", "r.*")
        placed = one.withColumn("bucket", self._bucket(F.col("file_id"))).withColumn("version", F.lit(version).cast("long"))
        self._write(placed)

    def _write(self, placed: DataFrame) -> None:
        placed.repartition("bucket").write.partitionBy("bucket", "version").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def versions(self) -> DataFrame:
        """Every stored row, with its version."""
        stored = self.spark.read.option("mergeSchema", True).parquet(self.path)  # a later version may have more columns
        return stored.withColumns({"bucket": F.col("bucket").cast("int"), "version": F.col("version").cast("long")})

    def latest(self, schema: T.StructType | str | None = None) -> DataFrame:
        """Each file's last row; ``schema`` is that of an empty store."""
        if not self._exists():
            return self.spark.createDataFrame([], schema or "file_id string")
        return self._last(self.versions()).drop("bucket", "version")

    def _last(self, rows: DataFrame) -> DataFrame:
        names = [c for c in rows.columns if c != "file_id"]
        return rows.groupBy("file_id").agg(F.max_by(F.struct(*names), "version").alias("r")).select("file_id", "r.*")

    def get(self, file_id: str) -> dict | None:
        """One file's last row, from its bucket alone."""
        if not self._exists():
            return None
        own = self.versions().filter((F.col("bucket") == self._bucket(F.lit(file_id))) & (F.col("file_id") == file_id))
        row = own.orderBy(F.col("version").desc()).drop("bucket").first()
        return row.asDict(recursive=True) if row else None

    def compact(self) -> int:
        """Fold all versions into the last one of each bucket; returns how many version folders went.

        The last version's partitions are overwritten with the folded rows when these are all written; the earlier ones go
        after that, and are no more than repeated reading if a failure leaves them.
        """
        rows = self.versions()
        tops = {r.bucket: r.top for r in rows.groupBy("bucket").agg(F.max("version").alias("top")).collect()}  # a row a bucket
        top = F.lit(None).cast("long")
        for bucket, version in tops.items():
            top = F.when(F.col("bucket") == bucket, version).otherwise(top)
        self._write(self._last(rows).withColumn("version", top))
        store, place = self._folder()
        gone = 0
        for status in store.listStatus(place):
            name = status.getPath().getName()
            if name.startswith("bucket="):
                for inner in store.listStatus(status.getPath()):
                    at = inner.getPath().getName()
                    if at.startswith("version=") and int(at.removeprefix("version=")) < tops[int(name.removeprefix("bucket="))]:
                        gone += store.delete(inner.getPath(), True)
        return gone
