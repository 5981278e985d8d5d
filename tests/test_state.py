"""The stateful chunks against the batch form, and the result store: upsert, repeat, get, compact, micro-batches."""

import time

import pytest
from pyspark.sql import functions as F

from maskwell import queries as Q
from maskwell.plans import engine
from maskwell.sources import store
from maskwell.streaming import streams

# ---------------------------------------------------------------- chunks

ROWS = [("a", i, f"a{i} ") for i in range(11)] + [("b", 0, None), ("b", 1, "b1")] + [("c", i, f"c{i}") for i in range(4)]


def running(spark, folder, table, size=4, flush_ms=1500):
    source = spark.readStream.schema("key string, at long, text string").option("maxFilesPerTrigger", 1).parquet(folder)
    q = streams.chunk_stream(source, "key", "at", size=size, flush_ms=flush_ms).writeStream.format("memory").queryName(table).outputMode("append").trigger(processingTime="200 milliseconds").start()
    return q


def until(spark, table, n, most=60):
    end = time.time() + most
    while time.time() < end:
        if spark.table(table).agg(F.sum("n")).first()[0] == n:
            return
        time.sleep(0.3)
    raise AssertionError(f"{spark.table(table).collect()}")


def test_chunk_stream_equals_the_batch_and_numbers_go_on(spark, tmp_path):
    folder, kinds = str(tmp_path / "in"), "key string, at long, text string"
    shuffled = [ROWS[i] for i in (5, 2, 9, 0, 14, 1, 3, 12, 8, 4, 6, 16, 7, 10, 11, 13, 15)]
    spark.createDataFrame(shuffled, kinds).repartition(1).write.parquet(folder)
    q = running(spark, folder, "chunks")
    try:
        until(spark, "chunks", len(ROWS))  # the rests came by timers
        batch = streams.chunk_batch(spark.createDataFrame(ROWS, kinds).fillna("", ["text"]), "key", "at", size=4)
        got = lambda: sorted(tuple(r) for r in spark.table("chunks").select("key", "chunk", "n", "text").collect())
        assert got() == sorted(tuple(r) for r in batch.collect())
        more = [("a", i, f"a{i} ") for i in range(20, 25)]
        spark.createDataFrame(more, kinds).repartition(1).write.mode("append").parquet(folder)
        until(spark, "chunks", len(ROWS) + len(more))
        rows = got()
        assert len({r[:2] for r in rows}) == len(rows)  # no chunk of a key comes twice, after a timeout too
        assert [r for r in rows if r[0] == "a"][3:] == [("a", 3, 4, "a20 a21 a22 a23 "), ("a", 4, 1, "a24 ")]
    finally:
        q.stop()


# ---------------------------------------------------------------- the result store


def rows(spark, *r):
    return spark.createDataFrame(list(r), "file_id string, entity_count long, note string")


def seen(s):
    return sorted((r.file_id, r.entity_count, r.note) for r in s.latest().collect())


def test_store(spark, tmp_path):
    s = store.ResultStore(spark, f"file://{tmp_path}/store", buckets=4)
    assert s.latest().count() == 0 and s.get("a") is None
    s.upsert(rows(spark, ("a", 1, "x"), ("b", 2, None), ("c", 3, "z"), ("c", 4, "y")), 1, order=("entity_count",))
    s.upsert(rows(spark, ("b", 5, "new"), ("d", 6, "d")), 2)
    want = [("a", 1, "x"), ("b", 5, "new"), ("c", 4, "y"), ("d", 6, "d")]
    assert seen(s) == want
    s.upsert(rows(spark, ("b", 5, "new"), ("d", 6, "d")), 2)  # a repeated upsert
    assert seen(s) == want and s.versions().count() == 5
    got = s.get("b")
    assert (got["entity_count"], got["version"]) == (5, 2) and s.get("zz") is None
    plan = s.versions().filter(F.col("bucket") == s._bucket(F.lit("b")))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan  # one bucket is read
    assert s.compact() >= 1
    assert seen(s) == want and s.versions().count() == 4 and s.get("a")["entity_count"] == 1
    s.upsert(rows(spark, ("a", 9, None)).withColumn("more", F.lit(1)), 3)  # further columns
    assert s.get("a")["more"] == 1 and s.get("d")["more"] is None
    with pytest.raises(Exception, match="needs a file id"):
        s.upsert(rows(spark, (None, 1, "x")), 4)


def test_store_of_a_stream(spark, tmp_path):
    s = store.ResultStore(spark, f"file://{tmp_path}/store", buckets=2)
    docs = spark.createDataFrame([("f1", "mail ann@mail.org"), ("f2", "nothing"), ("f1", "10.0.0.1 and ann@mail.org")], "file_id string, text string").coalesce(1)
    docs.limit(2).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run has nothing new
        source = spark.readStream.schema("file_id string, text string").parquet(f"{tmp_path}/in")
        found = engine.detect(source, types={"email", "ip_address"})
        q = found.writeStream.foreachBatch(lambda b, i: s.upsert(store.records(b, "file_id"), i)).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(90)
    assert sorted((r.file_id, r.entity_count) for r in s.latest().collect()) == [("f1", 1), ("f2", 0)]
    assert s.get("f1")["summary"]["by_type"] == {"email": 1} and s.get("f1")["candidates"][0]["text"] == "ann@mail.org"


def test_store_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = {}
    for user, found in (("first", engine.detect(docs, ("rule_based",))), ("second", engine.detect(docs, strict=True))):
        for r in found.collect():
            high = sum(s.confidence >= 0.8 for s in r.spans)
            if user == "first" or high:
                want[r.doc_id] = (user, len(r.spans), ",".join(sorted({s.type for s in r.spans})), high, len(r.text))
    got = {r.doc_id: (r.user_id, r.entity_count, r.types, r.high_confidence_entities, r.text_length) for r in Q.QUERIES["result_store"](spark, sf).collect()}
    assert got == want and {v[0] for v in got.values()} == {"first", "second"}
