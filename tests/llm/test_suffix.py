"""Suffix deduplication: the transforms carry the merge; hot anchors, long texts and repeated ids against brute force."""

import numpy as np
import pytest

from maskwell.llm import suffix_dedup


def by_force(texts, n=100):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, np.int32)
        for k in range(len(b) - n + 1):
            w = b[k : k + n]
            if w in seen:
                gone[k] += 1
                gone[k + n] -= 1
            else:
                seen.add(w)
        hit = np.cumsum(gone)[:-1] > 0
        runs = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        out.append((len(b), int(hit.sum()), runs, np.frombuffer(b, np.uint8)[~hit].tobytes()))
    return out


def strings(seed, count=12, size=90, alphabet="abc"):
    rng = np.random.default_rng(seed)
    part = "".join(rng.choice(list(alphabet), 40))
    return [("".join(rng.choice(list(alphabet), size)) + part).encode() for _ in range(count)]


def groups(found):
    out = {}
    for s, k, b in zip(*(x.tolist() for x in found), strict=True):
        out.setdefault(b, set()).add((s, k))
    return sorted(sorted(g) for g in out.values() if len(g) > 1)


def test_merge_depends_on_the_transforms(monkeypatch):
    own = strings(1)
    windows = np.array([len(s) - 7 for s in own])
    right = groups(suffix_dedup.repeats(own, windows, 8, 300))
    assert right
    suffixes = suffix_dedup.suffixes
    monkeypatch.setattr(suffix_dedup, "suffixes", lambda *a: suffixes(*a)[::-1])
    assert groups(suffix_dedup.repeats(own, windows, 8, 300)) != right


def test_common_prefixes():
    own = strings(2, 6, 60)
    text = np.frombuffer(b"\0".join(own) + b"\0", np.uint8).astype(np.int16) + 1
    size = np.array([len(s) + 1 for s in own])
    begin = np.cumsum(size) - size
    text[begin + size - 1] = 0
    order = suffix_dedup.suffixes(text, begin, size)
    _, _, shared = suffix_dedup.merge([suffix_dedup.transform(text, order)], 8)
    tails = [s[k:] for s in own for k in range(len(s) + 1)]  # by place
    by = [tails[p] for p in order]
    for i, x in enumerate(by):
        best = max(next((k for k, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y))) for j, y in enumerate(by) if j != i)
        assert shared[i] == min(8, best) // 4 * 4


@pytest.mark.parametrize("hot", [2000, 3])
def test_common_passage(spark, hot):
    rng = np.random.default_rng(7)
    letters = list("abcdefghij ")
    passage = "".join(rng.choice(letters, 400))
    texts = []
    for i in range(40):
        own = "".join(rng.choice(letters, rng.integers(0, 300)))
        at = rng.integers(0, 200)
        texts.append(own + passage[at : at + rng.integers(90, 400)] + own[::-1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = suffix_dedup.cut_out(df, hot_contexts=hot).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got] == by_force(texts)


def test_text_longer_than_a_piece(spark):
    rng = np.random.default_rng(3)
    long = "".join(rng.choice(list("abcdefgh"), 1_250_000))
    long = long[:600_000] + long[:700] + long[600_000:] + long[524_000:525_200]
    texts = ["x" + long[1_000_000:1_000_500], long, long[5_000:5_400]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffix_dedup.cut_out(df).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got] == by_force(texts)


def test_repeated_ids_and_clashing_columns(spark):
    a, b = "first text " * 30, "".join(chr(97 + i * i % 26) for i in range(300))
    rows = [(1, a, 5), (1, a, 5), (1, b, 6), (2, b + a, 7), (None, a, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = sorted(((r.doc_id or 0, r.text, r.spans, r.n_removed) for r in suffix_dedup.cut_out(df).collect()), key=str)
    alone = by_force([a])[0][1]
    in_order = {t: g[1] for t, g in zip((a, b), by_force([a, b]), strict=True)}
    want = [(1, a, 5, in_order[a]), (1, a, 5, in_order[a]), (1, b, 6, in_order[b]), (2, b + a, 7, by_force([a, b, b + a])[2][1]), (0, a, 8, 0)]
    assert alone == in_order[a] and got == sorted(want, key=str)
