"""Streams: chunks by count, running counters, rates by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chunk_batch(df: DataFrame, key: str, order: str, text_col: str = "text", size: int = 1000) -> DataFrame:
    """Every ``size`` rows of a key, in order, as one text; the rest of a key is its last chunk."""
    numbered = df.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / size).cast("long"))
    parts = numbered.groupBy(key, "chunk").agg(F.array_sort(F.collect_list(F.struct(order, text_col))).alias("rows"))
    return parts.select(key, "chunk", F.size("rows").alias("n"), F.array_join(F.transform("rows", lambda r: r[text_col]), "").alias("text"))


def running_counts(spans: DataFrame, *by: str) -> DataFrame:
    """Counters for update or complete mode."""
    return spans.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def rates(events: DataFrame, ts: str, window: str = "1 hour", late: str = "2 hours", *by: str) -> DataFrame:
    """Extension: counts by event-time window under a watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(spark) -> None:
    """State stores of the session's new queries are RocksDB: state variables and timers need it, and it spills to disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def chunk_stream(chunks: DataFrame, key: str = "key", order: str = "at", text_col: str = "text", size: int = 1000, flush_ms: int = 10_000) -> DataFrame:
    """Streaming form of :func:`chunk_batch`: a key's rows are held, in the order of ``order``, until ``size`` have come, or until
    ``flush_ms`` of processing time pass without one; a timer then hands on the rest.

    The number of a key's next chunk outlives the rest that a timer hands on, so (key, chunk) never repeats.  Rows of a
    micro-batch are put in order together with those held; a row that comes after later ones were handed on joins the next
    chunk.  Held are ``size`` rows a key at most; a micro-batch's rows of a key meet in one task, so bound the source
    (``maxFilesPerTrigger`` and the like) where a key is hot.  A null text counts as empty.
    """
    from pyspark.sql import types as T
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    stateful(chunks.sparkSession)
    kinds = {f.name: f.dataType for f in chunks.schema.fields}
    held_type = T.StructType([T.StructField("at", kinds[order]), T.StructField("text", T.StringType())])
    number_type = T.StructType([T.StructField("next", T.LongType())])
    out = T.StructType([T.StructField(key, kinds[key]), T.StructField("chunk", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("text", T.StringType())])

    name = key

    class Chunks(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.held = handle.getListState("held", held_type)
            self.number = handle.getValueState("number", number_type)

        def _out(self, key, texts):
            import pandas as pd

            n = self.number.get()[0] if self.number.exists() else 0
            self.number.update((n + 1,))
            return pd.DataFrame({name: [key[0]], "chunk": [n], "n": [len(texts)], "text": ["".join(texts)]})

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802
            import pandas as pd

            held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
            for pdf in rows:
                held += [(at, t if isinstance(t, str) else "") for at, t in zip(pdf[order].tolist(), pdf[text_col].tolist(), strict=True)]
            held.sort(key=lambda r: (not pd.isna(r[0]), r[0] if not pd.isna(r[0]) else 0))
            full = len(held) - len(held) % size
            for i in range(0, full, size):
                yield self._out(key, [t for _, t in held[i : i + size]])
            rest = held[full:]
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
            if rest:
                self.held.put(rest)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + flush_ms)
            else:
                self.held.clear()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
            if self.held.exists():
                texts = [r[1] for r in self.held.get()]
                self.held.clear()
                yield self._out(key, texts)

        def close(self):
            pass

    return chunks.groupBy(key).transformWithStateInPandas(Chunks(), out, "Append", "ProcessingTime")


class Counters:
    """Running counters of a stream with snapshots and resets, read from the query's own state.

    ``stream(spans)`` is what the query writes (update or complete mode); a snapshot reads the state store of its checkpoint.
    A reset keeps the present snapshot as the base of a new epoch; later counts are what came since.  The counters themselves
    never stop, so neither needs the query to.
    """

    def __init__(self, spark, checkpoint: str, bases: str):
        self.spark, self.checkpoint, self.bases = spark, checkpoint, bases

    @staticmethod
    def stream(spans: DataFrame) -> DataFrame:
        from ..operators.report import statistics

        return statistics(spans)

    def _total(self) -> DataFrame:
        state = self.spark.read.format("statestore").load(self.checkpoint)
        return state.select("key.kind", "key.name", F.col("value.count").alias("n"))

    def _epoch(self) -> int:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.bases)
        store = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in store.listStatus(place)] if store.exists(place) else []
        return max((int(n.removeprefix("epoch=")) for n in names if n.startswith("epoch=")), default=0)

    def get(self) -> DataFrame:
        """kind, name, n since the last reset."""
        total, epoch = self._total(), self._epoch()
        if not epoch:
            return total
        base = self.spark.read.schema("kind string, name string, n long").parquet(f"{self.bases}/epoch={epoch}").withColumnRenamed("n", "before")
        return total.join(base, ["kind", "name"], "left").select("kind", "name", (F.col("n") - F.coalesce("before", F.lit(0))).alias("n")).filter("n > 0")

    def reset(self) -> int:
        """Begin a new epoch; its number.  A reset that failed half way leaves the former epoch in force."""
        epoch = self._epoch() + 1
        self._total().write.mode("overwrite").parquet(f"{self.bases}/_epoch={epoch}")
        place = self.spark._jvm.org.apache.hadoop.fs.Path
        store = place(self.bases).getFileSystem(self.spark._jsc.hadoopConfiguration())
        store.rename(place(f"{self.bases}/_epoch={epoch}"), place(f"{self.bases}/epoch={epoch}"))
        return epoch
