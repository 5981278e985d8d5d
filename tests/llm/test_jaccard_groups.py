"""Groups of near copies: exact classes, every branch of dealing by blocks, and work in proportion to the group."""

import re

import numpy as np
import pytest

from maskwell.llm import jaccard


def near_copies(count, seed=1, words=120):
    rng = np.random.default_rng(seed)
    base, out = [f"w{i}" for i in rng.integers(0, 5000, words)], []
    for _ in range(count):
        own = list(base)
        for _ in range(rng.integers(1, 5)):
            own[rng.integers(0, words)] = f"x{rng.integers(0, 100_000)}"
        out.append(" ".join(own))
    return out


def classes_by_force(texts, n, percent):
    """Overlaps of all pairs from a dense incidence matrix, then labels spread until nothing changes."""
    sets = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", t)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
    number = {s: i for i, s in enumerate(set().union(*sets))}
    x = np.zeros((len(sets), len(number)), np.float32)
    for i, s in enumerate(sets):
        x[i, [number[z] for z in s]] = 1
    both, size = (x @ x.T).astype(int), np.array([len(s) for s in sets])
    linked = 100 * both >= percent * (size[:, None] + size - both)
    label = np.arange(len(texts))
    while True:
        low = np.where(linked, label, len(texts)).min(axis=1)
        if (low == label).all():
            return label.tolist()
        label = low


@pytest.mark.parametrize(("n", "percent", "block"), [(5, 80, 2048), (4, 85, 30)])
def test_group_is_exact(spark, n, percent, block):
    texts = near_copies(200)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = jaccard.link(df, n, percent, block=block).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == classes_by_force(texts, n, percent)


def test_hot_shingles_across_groups_are_exact(spark, monkeypatch):
    """Without groups everything goes through the product; shingles of more rows than a block are dealt by pairs of blocks."""
    monkeypatch.setattr(jaccard, "grouped_by_minima", lambda reps: reps.select("rep", reps["rep"].alias("root")).filter("false"))
    for block in (2048, 20):
        texts = near_copies(110, seed=4, words=60)
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = jaccard.link(df, 5, 80, block=block).orderBy("doc_id").collect()
        assert [r.component_id for r in got] == classes_by_force(texts, 5, 80)


def test_rows_grow_with_the_group(spark, monkeypatch):
    """Pairs whose whole sets are compared, terms of the product, and links handed on."""
    seen = {}
    product, verified, classes = jaccard.product, jaccard.verified, jaccard.classes

    def count(name, frame):
        seen[name] = seen.get(name, 0) + frame.count()
        return frame

    monkeypatch.setattr(jaccard, "product", lambda *a: count("terms", product(*a)))
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *a: verified(count("pairs", pairs), *a))
    monkeypatch.setattr(jaccard, "classes", lambda links, *a, **k: classes(count("links", links), *a, **k))
    rows = {}
    for size in (200, 400, 800, 1600):
        seen.clear()
        df = spark.createDataFrame(list(enumerate(near_copies(size))), "doc_id long, text string")
        assert jaccard.link(df, 5, 80).count() == size
        rows[size] = dict(seen)
    assert all(rows[n][k] <= 4 * n for n in rows for k in ("terms", "pairs", "links")), rows


def test_hub_lies_amid_its_group(spark, monkeypatch):
    """Before, the hub was the least id: where that one was edited most, the group fell apart and its pairs met one by one in the product."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in rng.integers(0, 5000, 120)]

    def edited(count):
        own = list(base)
        for at in rng.choice(120, count, replace=False):
            own[at] = f"x{rng.integers(0, 1_000_000)}"
        return " ".join(own)

    texts = [edited(14) for _ in range(100)] + [edited(int(rng.integers(4, 8))) for _ in range(500)]
    product, seen = jaccard.product, []

    def counted(*a):
        frame = product(*a)
        seen.append(frame.count())
        return frame

    monkeypatch.setattr(jaccard, "product", counted)
    got = jaccard.link(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, 80).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == classes_by_force(texts, 5, 80)
    assert seen[0] <= 4 * len(texts), seen
