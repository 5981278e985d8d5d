"""How filters interact: what each keeps, removes or repeats at every place of every order of application.

A document fails some of five filters: a mask of 32.  Each part's histograms of masks (all documents, good ones, toxic
ones) are stacked as rows and multiplied by integer 32-by-600 matrices, a column for every order and step, so no order is
ever played through on documents.

Whether a text is a copy is decided without bringing copies together: the first of each text is a map-side minimum of
(text digest, id), and the documents are held against these firsts by id, so a text with very many copies is one row a
task.  Documents that are not first have their copy filter's bit set.

Defined cases: null texts count as empty; a null ``lang`` joins the part of the empty string; a null id neither copies nor
is copied; rows that agree in id and text are no copies of each other; labels that repeat an id count as good or toxic if
any of them is; an empty table has no part and gives no row; further columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ranges

FILTERS = "ABCDE"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
CONTINUED = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no code point
MARKS = b"#$%&*|"
AUDIT = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def text_mask(data: bytes) -> int:
    """Bits 1, 2, 4 and 8 for the failing filters A to D of a text in UTF-8."""
    words = data.split()  # at the six ASCII white spaces, as the contract has it
    capitals, points = len(data) - len(data.translate(None, CAPITALS)), len(data.translate(None, CONTINUED))
    marked = len(data.translate(None, MARKS)) < len(data)
    return (len(words) < 100) + 2 * (100 * len(set(words)) < 80 * len(words)) + 4 * (100 * capitals > 10 * points) + 8 * marked


def _texts(batches):
    """Digest and mask beside id and part, in place of the text."""
    import hashlib

    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        raw = pc.fill_null(batch.column("text").cast(pa.binary()), b"")
        for a, b in ranges(pc.binary_length(raw).to_pylist()):
            texts = raw.slice(a, b - a).to_pylist()
            columns = [batch.column(c).slice(a, b - a) for c in ("doc_id", "part")]
            columns += [pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array([text_mask(t) for t in texts], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "digest", "mask"])


def masks(spark, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): each part's histograms."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), "text")
    rows = materialize(spark, rows.mapInArrow(_texts, "doc_id long, part string, digest binary, mask int"))  # texts are read once
    first = rows.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    met = rows.join(first, ["doc_id", "digest"], "left").join(known, "doc_id", "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    of = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return met.groupBy("part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask")).agg(F.count(F.lit(1)).alias("n"), of("good").alias("good"), of("toxic").alias("toxic"))


def matrices():
    """Integer matrices of 32 masks by 600 (order, step) columns: kept after the step, removed at it, failing its filter but
    removed before, failing its filter alone; and which filter each column's step has."""
    import numpy as np

    mask = np.arange(32)[:, None]
    orders = ["".join(o) for o in permutations(FILTERS)]
    steps = [(o, s) for o in orders for s in range(5)]
    own = np.array([1 << FILTERS.index(o[s]) for o, s in steps])
    before = np.array([sum(1 << FILTERS.index(c) for c in o[:s]) for o, s in steps])
    fails, gone = (mask & own) != 0, (mask & before) != 0
    kept, removed, redundant, unique = ~fails & ~gone, fails & ~gone, fails & gone, (mask == own) & fails
    return steps, own, *(m.astype(np.int64) for m in (kept, removed, redundant, unique))


def audit(spark, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step."""
    bins = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic"))))  # 32 at most
    by_part = masks(spark, docs, labels).groupBy("part").agg(bins.alias("bins"))
    at = lambda name: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda m: F.coalesce(F.element_at("bins", m)[name], F.lit(0))).alias(name)
    stacked = by_part.select("part", at("n"), at("good"), at("toxic"))

    def multiplied(batches):
        import numpy as np
        import pyarrow as pa

        steps, own, kept, removed, redundant, unique = matrices()
        orders, places = pa.array([o for o, _ in steps]), pa.array([s + 1 for _, s in steps], pa.int32())
        letters = own[:, None] == own  # columns of one filter, whatever the place
        for batch in batches:
            parts = batch.column(0).to_pylist()
            n, good, toxic = (batch.column(i).flatten().to_numpy().reshape(-1, 32) for i in (1, 2, 3))
            lost = n @ removed
            tables = [n @ kept, lost, n @ redundant, n @ unique, good @ removed, toxic @ removed, lost @ letters.astype(np.int64)]
            for i, part in enumerate(parts):
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(steps)), orders, places, *[pa.array(t[i]) for t in tables]], names=names)

    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return stacked.mapInArrow(multiplied, AUDIT)
