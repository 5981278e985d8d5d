"""The filter audit, the drifted schema rewrite and the nearest neighbours against brute force, edge cases included."""

import itertools
import os
import zlib
from datetime import datetime

import numpy as np
import pyarrow.dataset as ds
import pytest
from brute_drift import NAMES, expected
from pyspark.sql import functions as F

from maskwell.llm import ann, audit, drift, graph
from maskwell.llm import queries as Q

# ---------------------------------------------------------------- op11


def played(docs, labels):
    """Every order played through on the documents."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, lang in docs:
        t = text or ""
        w = t.encode().split()
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t)}
        fails["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        rows.append((lang or "", i, {f for f, x in fails.items() if x}))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[2]]
                left = [r for r in left if f not in r[2]]
                redundant = sum(f in r[2] for r in own) - len(gone)
                out[part, order, step] = [len(left), len(gone), redundant, sum(r[2] == {f} for r in own), sum(r[1] in good for r in gone), sum(r[1] in toxic for r in gone), 0]
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                out[part, order, step][6] = sum(out[part, o, o.index(f) + 1][1] for o in map("".join, itertools.permutations("ABCDE")))
    return out


COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def result(df):
    return {(r.part, r.filter_order, r.step): [r[c] for c in COLUMNS] for r in df.collect()}


LONG = " ".join(f"w{i}" for i in range(150))
DOCS = [(1, None, None), (2, "", ""), (3, "short", "en"), (4, LONG, "en"), (5, LONG, "de"), (6, LONG, "en"), (6, LONG, "en"), (7, LONG + " $", "en"), (None, LONG, "en"), (8, LONG.upper(), "de"), (9, "a b " * 200, "en"), (10, "é\x1c x y" * 3, "fr"), (11, "AB é\x0b" * 60 + "x" * 90_000, "fr"), (12, "\t \n", "fr")]
LABELS = [(3, 1, 0), (4, 1, 1), (5, 0, 1), (6, None, 1), (6, 1, None), (None, 1, 1), (8, 1, 0), (99, 1, 1)]


def test_audit_edge_cases(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string").withColumn("mask", F.lit("x")).withColumn("part", F.lit(1)).withColumn("n", F.lit(2))
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert result(audit.audit(spark, docs, labels)) == played(DOCS, LABELS)
    assert result(audit.audit(spark, docs.limit(0), labels)) == {}
    assert result(audit.audit(spark, docs, labels.limit(0))) == played(DOCS, [])


def test_audit_query(spark, sf):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert result(Q.QUERIES["op11_filter_audit"](spark, sf)) == played(docs, labels)


# ---------------------------------------------------------------- op12


def check(got, want):
    assert sorted(r.file_no for r in got) == sorted(want)
    for r in got:
        assert {k: r[k] for k in want[r.file_no]} == want[r.file_no]
    if got:
        folder = os.path.dirname(got[0].path).removeprefix("file://")
        assert sorted(os.listdir(folder)) == sorted(os.path.basename(r.path) for r in got)


def test_drift_query(spark, sf):
    got = Q.QUERIES["op12_drift_rewrite"](spark, sf).collect()
    check(got, expected(ds.dataset(f"{sf}/clients.parquet").to_table().to_pylist()))
    import pyarrow.parquet as pq

    for r in got[:40]:
        schema = pq.ParquetFile(r.path.removeprefix("file://")).schema_arrow
        assert schema.equals(drift.evolved()) and drift.ids_of(schema) == list(range(1, 11))
    assert {r.version for r in got} == {drift.version_of(f) for f in range(len(got))}
    again = Q.QUERIES["op12_drift_rewrite"](spark, sf).collect()
    assert os.path.dirname(again[0].path) != os.path.dirname(got[0].path)


ODD = [
    [None, 1, "crm", datetime(1969, 12, 31, 23, 59, 59, 1), "a|b", None, "é\n", None, None, None],
    [-5, None, None, None, None, "", "", 2, "x", float("nan")],
    [0, 2, "web", datetime(2024, 2, 29), "n", "e", "c", 3, "s", float("inf")],
    [7, 2, "web", datetime(2024, 2, 29), "n", "e", "c", 3, "s", -0.1],
    [2**62, 2, "web", datetime(2024, 2, 29), "n", "e", "c", 3, "s", 1e300],
    [8, 2, "web", datetime(2024, 2, 29), "n", "e", "c", 3, "s", -123456.789],
]
KINDS = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"


@pytest.mark.parametrize("n", [0, len(ODD)])
def test_drift_edge_cases(spark, n):
    df = spark.createDataFrame(ODD[:n], KINDS).withColumn("__rank", F.lit(1)).withColumn("file_no", F.lit("x"))
    folder = drift.new_folder(spark)
    got = drift.rewrite(spark, drift.write_drifted(spark, df, folder), folder).collect()
    check(got, expected([dict(zip(NAMES, r, strict=True)) for r in ODD[:n]]))


def test_drift_rewrite_can_be_repeated(spark):
    """A rewrite that ran before, as a repeated task's did, changes nothing."""
    df = spark.createDataFrame(ODD, KINDS)
    folder = drift.new_folder(spark)
    started = drift.write_drifted(spark, df, folder)
    kept, drift._clean = drift._clean, lambda *_: None
    try:
        first = drift.rewrite(spark, started, folder).collect()
    finally:
        drift._clean = kept
    assert sorted(map(tuple, drift.rewrite(spark, started, folder).collect())) == sorted(map(tuple, first))


def test_ranks_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(drift, "HOT_LEAST", 30)
    keys = [5] * 400 + [None] * 60 + [77] * 50 + list(range(300))
    rows = [(k, i % 97) for i, k in enumerate(keys)] + [(5, 1)] * 40
    df = spark.createDataFrame(rows, "client_id long, v long")
    placed, total = drift.ranked(spark, df, "client_id")
    got = sorted((r["__rank"], r.client_id, r.v) for r in placed.collect())
    assert total == len(rows) and [r[0] for r in got] == list(range(total))
    crc = lambda k: zlib.crc32(str(k).encode()) if k is not None else 0
    assert [r[1] for r in got] == sorted((k for k, _ in rows), key=lambda k: (crc(k), k is not None, k or 0))
    monkeypatch.setattr(drift, "HOT_LEAST", 10**9)
    cold, _ = drift.ranked(spark, df, "client_id")
    assert sorted((r["__rank"], r.client_id, r.v) for r in cold.collect()) == got  # hot or not, the same order


def test_prefix_sums(spark):
    counts = {b: 1 + b % 7 for b in [0, 1, 255, 256, 257, 70, 65_535, 40_000]}
    got = drift.prefix_sums(spark.createDataFrame(list(counts.items()), "__bucket int, n long")).collect()
    assert {r["__bucket"]: r.before for r in got} == {b: sum(n for c, n in counts.items() if c < b) for b in counts}


# ---------------------------------------------------------------- op13


def nearest(rows, k, is_query):
    """rows: (id, vector), each usable and once."""
    out = {}
    for i, v in rows:
        if is_query(i):
            far = sorted((-float(np.dot(np.array(v, float), np.array(w, float))), j) for j, w in rows if j != i and len(w) == len(v))
            out[i] = far[:k]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    for i, own in out.items():
        assert [r for r, _, _ in sorted(own)] == list(range(1, len(own) + 1))
        out[i] = [(s, v) for _, s, v in sorted(own)]
    return out


def same(got, want):
    assert got.keys() == {i for i, own in want.items() if own}
    for i, own in got.items():
        assert [v for _, v in own] == [v for _, v in want[i]], i
        assert np.allclose([s for s, _ in own], [s for s, _ in want[i]], rtol=1e-12, atol=1e-12)


def test_neighbours_edge_cases(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(x) for x in np.float32(rng.normal(size=4) * 10 ** (i % 3))]) for i in range(0, 60)]
    good += [(100 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(50)]  # a common vector: ties go to the smaller id
    good += [(200, [1.0, 2.0]), (220, [3.0, -0.0]), (240, [2.0, 0.0])]
    bad = [(None, [1.0, 1.0, 1.0, 1.0]), (400, None), (420, []), (440, [0.0] * 4), (460, [1.0, None, 1.0, 1.0]), (480, [float("nan"), 1.0, 1.0, 1.0]), (500, [float("inf"), 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(good + bad + good[:5], "vec_id long, embedding array<float>").withColumn("dim", F.lit("x")).withColumn("vec", F.lit(1)).withColumn("shard", F.lit(2))
    query = F.col("vec_id") % 20 == 0
    same(found(ann.nearest(spark, df, query, 20)), nearest(good, 20, lambda i: i % 20 == 0))
    few = [r for r in good if r[0] < 9]
    same(found(ann.nearest(spark, spark.createDataFrame(few, "vec_id long, embedding array<double>"), query, 20)), nearest(few, 20, lambda i: i % 20 == 0))
    assert found(ann.nearest(spark, df.limit(0), query, 20)) == {} and found(ann.nearest(spark, df.filter("vec_id = 0"), query, 20)) == {}


def test_neighbours_recall(spark):
    """The registered query on 2,000 vectors against brute force."""
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = found(Q.QUERIES["op13_nearest_neighbours"](spark, sf)), nearest(rows, 20, lambda i: i % 20 == 0)
    assert got.keys() == want.keys() and all(len(own) == 20 for own in got.values())
    hits = sum(len({v for _, v in got[i]} & {v for _, v in want[i]}) for i in want)
    assert hits >= 0.95 * 20 * len(want)


def test_graph_of_several_levels_and_norms():
    rng = np.random.default_rng(5)
    raw = rng.normal(size=(4000, 24)) * rng.lognormal(size=(4000, 1))
    x = graph.unit(raw)
    assert np.allclose((x**2).sum(1), 1, atol=1e-5)
    tables, entry = graph.build(x)
    assert len(tables) > 2 and all(t.dtype == np.int32 for t in tables) and (tables[0] >= 0).sum(1).min() > 0
    q = rng.normal(size=(100, 24))
    nodes, _ = graph.search(x, tables, entry, np.concatenate([q, np.zeros((100, 1))], 1).astype(np.float32), 128)
    best = np.argsort(-(q @ raw.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:128]) & set(b)) / 10 for a, b in zip(nodes, best, strict=True)]) > 0.95
