"""Approximate nearest neighbours by largest inner product: a navigable small-world graph a shard, shard results merged.

Each distinct vector is one node, with the smallest ids that carry it (a copy beyond them can never be among the nearest,
as ties go to the smaller id), so a very common vector is no hot node.  Nodes are dealt to shards by hash; one task builds
a shard's graph, which is stored as flat neighbour arrays in a table of the shared folder.  Blocks of query vectors meet
every shard; each hands on its nearest ``k + 1`` ids a query, and these are merged.

Defined cases: rows whose id or vector is null, whose vector is empty, zero or holds null or non-finite components take no
part; rows equal in id and vector count once; an id with several vectors is a query and a candidate with each of them, but
never its own neighbour; vectors of different lengths never meet; fewer candidates than ``k`` give fewer rows; an empty
table gives none; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

BUILD_BEAM = 96  # candidates from which a new node's links are chosen
SEARCH_BEAM = 128  # candidates that a query holds in each shard
SHARD_BYTES = 64 << 20  # of a shard's vectors, at most
BLOCK = 1 << 14  # query vectors that meet a shard at once, about

INDEX = "dim int, shard int, held array<bigint>, n_held binary, vectors binary, links array<binary>, entry int"
NEAREST = "array<struct<far:double,vec_id:bigint>>"


def shards_of(n: int, dim: int) -> int:
    """Shards for ``n`` vectors.  A shard's size grows with the square root of ``n`` up to SHARD_BYTES: a query visits all
    shards, so their number must grow slower than the table does."""
    return max(1, math.ceil(n / min(max(2048, 24 * math.isqrt(n)), max(1, SHARD_BYTES // (4 * dim)))))


def usable(vec: Column) -> Column:
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def nodes(df: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    """(dim, vec, held): the distinct vectors with their ``k`` smallest ids.  A common vector's ids are cut to ``k`` before the
    exchange too."""
    rows = df.filter(F.col(id_col).isNotNull() & usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("vec_id"), _plain(vec_col).alias("vec"))
    once = rows.groupBy("vec", "vec_id").agg(F.lit(1).alias("n"))
    first = once.withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).filter(F.col("n") <= k)
    return first.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("held")).select(F.size("vec").alias("dim"), "vec", "held")


def _plain(vec_col: str) -> Column:
    """The vector in double precision, without negative zeros."""
    return F.transform(F.col(vec_col), lambda x: x.cast("double") + 0.0)


def _key(vec: Column) -> Column:
    return F.sha2(F.concat_ws(",", vec.cast("array<string>")), 256)


def index(spark, found: DataFrame) -> DataFrame:
    """A row a shard: its nodes' ids and vectors and its graph's neighbours, flat; written to the shared folder."""
    found = materialize(spark, found)
    dims = {r.dim: r.n for r in found.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a length of vectors
    count = F.lit(1)
    for dim, n in dims.items():
        count = F.when(F.col("dim") == dim, shards_of(n, dim)).otherwise(count)
    dealt = found.withColumn("shard", F.pmod(F.xxhash64("vec"), count).cast("int"))

    def built(key, batches):
        import numpy as np
        import pyarrow as pa

        from . import graph

        dim, shard = (k.as_py() for k in key)
        table = pa.Table.from_batches(list(batches)).combine_chunks()  # SHARD_BYTES of single precision, twice that here
        vec, held = (table.column(c).chunk(0) for c in ("vec", "held"))
        x = vec.flatten().to_numpy().reshape(-1, dim)
        n_held = np.diff(held.offsets.to_numpy()).astype(np.int32)
        ids = held.flatten().to_numpy()
        first = ids[np.cumsum(n_held) - n_held]
        order = np.lexsort((*x.T[:4], first))  # so that the graph does not depend on the order of rows
        starts = (np.cumsum(n_held) - n_held)[order]
        take = np.repeat(starts - (np.cumsum(n_held[order]) - n_held[order]), n_held[order]) + np.arange(len(ids))
        tables, entry = graph.build(graph.unit(x[order]), BUILD_BEAM)
        out = [[dim], [shard], [ids[take]], [n_held[order].tobytes()], [x[order].tobytes()], [[t.tobytes() for t in tables]], [entry]]
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=["dim", "shard", "held", "n_held", "vectors", "links", "entry"])

    return materialize(spark, dealt.groupBy("dim", "shard").applyInArrow(_streamed(built), INDEX))


def _streamed(f):
    """``f`` with the hints by which Spark hands a group over in batches."""
    from collections.abc import Iterator

    import pyarrow as pa

    def run(key, batches):
        yield from f(key, batches)

    run.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def search(spark, shards: DataFrame, queries: DataFrame, k: int, width: int = SEARCH_BEAM) -> DataFrame:
    """(qkey, nearest): for each distinct query vector (qkey, dim, vec) the ``k`` nearest ids found, nearest first; ``far`` is
    the negated inner product."""
    blocks = max(1, math.ceil(queries.count() / BLOCK))
    sizes = shards.groupBy("dim").agg(F.collect_list("shard").alias("shards"))  # a row a length of vectors
    q = queries.join(F.broadcast(sizes), "dim").withColumn("block", F.pmod(F.xxhash64("qkey"), F.lit(blocks)).cast("int"))
    q = q.select("dim", F.explode("shards").alias("shard"), "block", "qkey", "vec")
    s = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def found(key, left, right):
        import numpy as np
        import pyarrow as pa

        from . import graph

        out = pa.schema([("qkey", pa.string()), ("nearest", pa.list_(pa.struct([("far", pa.float64()), ("vec_id", pa.int64())])))])
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        row = left.slice(0, 1).to_pydict()
        dim, entry = row["dim"][0], row["entry"][0]
        x = np.frombuffer(row["vectors"][0], np.float64).reshape(-1, dim)
        held, n_held = np.array(row["held"][0], np.int64), np.frombuffer(row["n_held"][0], np.int32)
        tables = [np.frombuffer(t, np.int32).reshape(len(x), -1) for t in row["links"][0]]
        keys = right.column("qkey").combine_chunks()
        q = right.column("vec").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        # the completing component of a query is zero; its length does not matter to the order
        unit_q = np.concatenate([q / np.abs(q).max(1, keepdims=True), np.zeros((len(q), 1))], 1).astype(np.float32)
        got, _ = graph.search(graph.unit(x), tables, entry, unit_q, width)
        starts = np.cumsum(n_held) - n_held
        offsets, far, ids = [0], [], []
        for a in range(0, len(q), 256):
            node = got[a : a + 256]
            score = np.where(node >= 0, (x[node] * q[a : a + 256, None, :]).sum(2), -np.inf)  # on the original vectors
            for nodes_, scores in zip(node, score, strict=True):
                order = np.lexsort((held[starts[nodes_]], -scores))[:k]
                order = order[nodes_[order] >= 0]
                own = nodes_[order]
                s = np.repeat(-scores[order], n_held[own])
                i = np.concatenate([held[starts[v] : starts[v] + n_held[v]] for v in own])
                best = np.lexsort((i, s))[:k]
                far.append(s[best])
                ids.append(i[best])
                offsets.append(offsets[-1] + len(best))
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(far)), pa.array(np.concatenate(ids))], fields=list(out.field("nearest").type.value_type))
        return pa.Table.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs).cast(out.field("nearest").type)], schema=out)

    parts = s.groupBy("dim", "shard", "block").cogroup(q.groupBy("dim", "shard", "block")).applyInArrow(found, f"qkey string, nearest {NEAREST}")
    return parts.groupBy("qkey").agg(F.slice(F.array_sort(F.flatten(F.collect_list("nearest"))), 1, k).alias("nearest"))  # k places a shard


def nearest(spark, df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows of ``df`` that are queries the ``k`` nearest other ids found, ties to the
    smaller id.  The index is over every row."""
    shards = index(spark, nodes(df, id_col, vec_col, k + 1))
    asked = df.filter(is_query & F.col(id_col).isNotNull() & usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("query_id"), _plain(vec_col).alias("vec"))
    asked = materialize(spark, asked.withColumn("qkey", _key(F.col("vec"))).groupBy("query_id", "qkey").agg(F.first("vec").alias("vec")))
    distinct = asked.groupBy("qkey").agg(F.first("vec").alias("vec")).withColumn("dim", F.size("vec"))
    found = materialize(spark, search(spark, shards, distinct, k + 1))
    rows = asked.select("query_id", "qkey").join(found, "qkey")
    others = F.slice(F.filter("nearest", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return rows.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))
