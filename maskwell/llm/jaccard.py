"""Exact n-gram Jaccard join as a blocked sparse product, with connected classes.

A document is the set of its distinct n-word shingles (64-bit hashes); a pair is linked
when ``100 * overlap >= percent * union``.  Steps:

1. *Sets.*  One pass gives each document its set's size, a digest of the set and a few
   minima under different permutations, and a count sketch of how many documents hold
   each shingle.  Documents with equal sets are one representative from here on.
2. *Groups.*  Representatives that share minima with a hub, and at least a third of all
   shingles of the two, are its group, and are rewritten as their difference from it;
   the hub is one whose minima many hold, whatever its id;
   those that share less look for another hub among themselves.
   Those that reach the threshold with the hub are linked at once (a star, never all pairs).
3. *Products within groups.*  The symmetric difference of two members is that of their
   differences, so the product of the narrow incidence of members and differences counts
   every overlap in a group exactly.  It is taken block by block, only for pairs of which
   one is not linked to the hub; a task contracts the links that it finds and gives at
   most one row a member.
4. *Product across groups.*  The sketch (a fixed width, broadcast) orders shingles from
   rare to common.  By the size bound, two linked documents share one of the first
   ``size - ceil(t * size) + 1`` shingles of both, so only these enter the product, which
   is dealt by shingle; a term is emitted only if groups and classes differ and the sizes
   and places allow the overlap asked for.  Terms are added up by pair, and pairs with fewer
   than their sizes ask for are discarded.  A shingle with more rows than a block is dealt
   again by pairs of blocks.
5. *Check and classes.*  Overlaps of the distinct pairs left are counted on whole sets;
   the links make classes by star contraction, with every round's result written to the
   shared folder.

Defined results: null, empty and blank texts have no shingles and are their own class;
fewer words than n make one shingle; equal ids are one document each, their class is
shared; a null id is its own class, null.  Ids may be any ordered type.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, id_filter, id_slot, materialize, passing, ranges, release, spread

WORDS, PERCENT = 5, 80
MINIMA = 6
ROUNDS = 2  # of looking for hubs; what stays without one goes through the product across groups
SKETCH_BITS = 22
BLOCK = 2048  # rows of a shingle multiplied at once
PAIRS = 1 << 18  # pairs of rows looked at together; some 150 bytes each
GROUP, WIDTH = 1024, 1 << 18  # rows of a group multiplied at once, and hashes in their differences

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x2545F4914F6CDD1D
_ODD = [int(x) | 1 for x in _mix(np.arange(MINIMA, dtype=np.uint64), 99)]  # multipliers that permute hashes
PART = 1 << 19  # bytes of text hashed at once


def _powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.empty(n, np.uint64)
    out[0] = 1
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
        have += more
    return out


_UP, _DOWN = np.empty(0, np.uint64), np.empty(0, np.uint64)


def shingles(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the n-word shingles of each text, sorted, one text after another, and how many each has.

    A-Z in lower case, words between ASCII white space.  A word's hash is its part of a running polynomial sum.
    """
    global _UP, _DOWN
    raw = [(t or "").encode() for t in texts]
    b = _LOWER[np.frombuffer(b" ".join(raw), np.uint8)]
    if len(b) > len(_UP):
        _UP, _DOWN = _powers(max(len(b), 2 * PART), _BASE), _powers(max(len(b), 2 * PART), pow(_BASE, -1, 1 << 64))
    gap = np.ones(len(b) + 2, np.int8)
    gap[1:-1] = _SPACE[b]
    turn = np.diff(gap)
    first, stop = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _UP[: len(b)], out=total[1:])
    word = _mix((total[stop] - total[first]) * _DOWN[first])
    ends = np.cumsum([len(r) + 1 for r in raw])
    doc = np.searchsorted(ends, first, side="right")
    words = np.bincount(doc, minlength=len(raw))
    last = np.cumsum(words)

    def hashed(at: np.ndarray, k: int) -> np.ndarray:
        """Of the k words from each place on."""
        h = np.zeros(len(at), np.uint64)
        for i in range(k):
            h = h * np.uint64(0xD6E8FEB86659FD93) + word[at + i]
        return _mix(h, 7 + k)

    at = np.flatnonzero(np.arange(len(word)) + n <= last[doc])
    value, owner = hashed(at, n), doc[at]
    if len(short := np.flatnonzero((words > 0) & (words < n))):
        value, owner = [value], [owner]
        for k in range(1, n):
            few = short[words[short] == k]
            value.append(hashed(last[few] - k, k))
            owner.append(few)
        value, owner = np.concatenate(value), np.concatenate(owner)
        by = np.argsort(owner, kind="stable")
        value, owner = value[by], owner[by]
    cuts = np.searchsorted(owner, np.arange(len(raw) + 1)).tolist()
    for lo, hi in zip(cuts, cuts[1:]):
        value[lo:hi].sort()
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.bincount(owner[new], minlength=len(raw))


def _texts(batch, column: int):
    """(row range, texts) in parts of about PART bytes."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for a, b in ranges(sizes, PART):
        yield a, b, batch.column(column).slice(a, b - a).to_pylist()


def _lists(values: np.ndarray, counts: np.ndarray):
    """Arrow lists of ``counts`` values each."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def profiles(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, digest and minima of every document, and, with null ids and ``part`` set, parts of the task's count sketch."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        import hashlib
        import zlib

        import pyarrow as pa

        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)  # a task's counts; those of 255 and more are sent as 255
        names = ["doc_id", "n_shingles", "digest", "minima", "part", "counts"]
        id_type = pa.null()
        for batch in batches:
            id_type = batch.column(0).type
            for a, b, texts in _texts(batch, 1):
                s, size = shingles(texts, n)
                stop = np.cumsum(size)
                digest = [hashlib.blake2b(s[hi - k : hi].tobytes(), digest_size=16).digest() for hi, k in zip(stop.tolist(), size.tolist(), strict=True)]
                some = np.flatnonzero(size)
                least = np.empty((len(some), MINIMA), np.int64)
                for i, odd in enumerate(_ODD if len(some) else ()):
                    least[:, i] = (np.minimum.reduceat(s * np.uint64(odd), (stop - size)[some]) ^ np.uint64(1 << 63)).view(np.int64)
                np.add.at(sketch, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
                m = b - a
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, m), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), _lists(least.reshape(-1), MINIMA * (size > 0)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        for i, part in enumerate(np.split(np.minimum(sketch, 255).astype(np.uint8), 64)):
            if part.any():
                row = [pa.nulls(1, id_type), pa.array([0], pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.list_(pa.int64())), pa.array([i], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)])]
                yield pa.RecordBatch.from_arrays(row, names=names)

    return docs.mapInArrow(run, f"doc_id {kind}, n_shingles long, digest binary, minima array<long>, part int, counts binary")


def sketch_of(rows: DataFrame) -> np.ndarray:
    """Ranks of the sketch's places, from few to many documents.  The tasks' sketches are added up on the executors by part, then 64 parts
    come to the driver.  A shingle's own count stands out of its place's noise, so even a crowded sketch orders common ones last."""

    def add(parts):
        import zlib

        import pandas as pd

        total = {}
        for pdf in parts:
            for i, raw in zip(pdf["part"], pdf["counts"], strict=True):
                x = np.frombuffer(zlib.decompress(raw), np.uint8).astype(np.uint32)
                total[i] = total[i] + x if i in total else x
        yield pd.DataFrame({"part": [*total], "counts": [x.tobytes() for x in total.values()]})

    dealt = rows.filter("part is not null").select("part", "counts").repartition(64, "part")
    total = np.zeros((64, (1 << SKETCH_BITS) // 64), np.uint32)
    for r in dealt.mapInPandas(add, "part int, counts binary").toLocalIterator():  # 16 MiB
        total[r.part] = np.frombuffer(r.counts, np.uint32)
    values, rank = np.unique(total.reshape(-1), return_inverse=True)
    return (rank * 65535 // max(65535, len(values))).astype(np.uint16)


def _need(a, b, percent: int):
    """Least overlap of linked sets of sizes a and b."""
    return -(-(percent * (a + b)) // (100 + percent))


def prefixes(docs: DataFrame, shared, n: int, percent: int) -> DataFrame:
    """doc_id, size, prefix: the first shingles of each document (doc_id, text), from rare to common."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        import pyarrow as pa

        rarity = shared.value
        for batch in batches:
            for a, b, texts in _texts(batch, 1):
                s, size = shingles(texts, n)
                common = rarity[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                keep = np.where(size > 0, size - -(-percent * size // 100) + 1, 0)
                stop, parts = np.cumsum(size), [np.empty(0, np.int64)]
                for lo, hi, k in zip((stop - size).tolist(), stop.tolist(), keep.tolist(), strict=True):
                    parts.append(lo + np.argsort(common[lo:hi], kind="stable")[:k])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(size, pa.int32()), _lists(s[np.concatenate(parts)].view(np.int64), keep)], names=["doc_id", "size", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, size int, prefix array<long>")


ROW = ("shingle", "rep", "size", "place", "label", "root")


def _terms(left: list, right: list, percent: int):
    """Batches (a, b, least) from places ``left`` and ``right`` of rows ROW that share a shingle."""
    import pyarrow as pa

    (rep, size, place, label, root), (rep2, size2, place2, label2, root2) = left, right
    si, sj = size.astype(np.int64), size2.astype(np.int64)
    need = _need(si, sj, percent)
    room = np.minimum(si - place, sj - place2) + np.minimum(place, place2)
    ok = (label != label2) & (root != root2) & (np.minimum(si, sj) >= need) & (room >= need)
    if ok.any():
        a, b, si, sj = rep[ok], rep2[ok], si[ok], sj[ok]
        low = a < b
        outside = np.maximum(-(-percent * si // 100), -(-percent * sj // 100)) - 1
        yield pa.RecordBatch.from_arrays([pa.array(np.where(low, a, b)), pa.array(np.where(low, b, a)), pa.array(need[ok] - outside)], names=["a", "b", "least"])


def product(incidence: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Terms (a, b, least) of the product from incidence rows ROW: one a shared prefix shingle of representatives of different
    classes and groups; a linked pair has ``least`` terms or more.

    Linked sets share ``need`` shingles, of which at most the rest beyond the longer-lasting prefix lies outside both
    prefixes; and at a shared shingle, those before and after it in both must suffice.  A task multiplies shingles of up
    to ``block`` rows; the rows of others are handed on and dealt by pairs of blocks.
    """
    spark = incidence.sparkSession
    kinds = dict(incidence.dtypes)
    kind = kinds["rep"]
    rows = ", ".join(f"{c} {kinds[c]}" for c in ROW)

    def pairs(rows):
        """Index pairs within runs of equal shingle; long runs only across groups."""
        shingle, root = rows[0], rows[5]
        edge = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
        count = np.diff(np.append(edge, len(shingle)))
        for k in np.unique(count[count > 1]):
            runs = edge[count == k]
            if k <= 64:
                i, j = np.triu_indices(k, 1)
                for part in np.array_split(runs, -(-len(runs) * len(i) // PAIRS)):
                    yield (part[:, None] + i).ravel(), (part[:, None] + j).ravel()
            else:
                for start in runs:
                    order = start + np.argsort(root[start : start + k], kind="stable")
                    own = root[order]
                    cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), k]
                    for p, q in zip(cuts, cuts[1:]):
                        step = max(1, PAIRS // max(1, k - q))
                        for at in range(p, q if q < k else p, step):
                            x, y = order[at : min(at + step, q)], order[q:]
                            yield np.repeat(x, len(y)), np.tile(y, len(x))

    def run(batches):
        import pyarrow as pa

        fill = lambda n, names, types: [pa.nulls(n, t) for t in types]
        names = [*ROW, "a", "b", "least"]
        for batch in batches:
            types = [c.type for c in batch.columns]
            break
        else:
            return

        def all_batches():
            yield batch
            yield from batches

        for columns, hot in by_key(all_batches(), block):
            if hot:
                n = len(columns[0])
                yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(columns, types, strict=True)], pa.nulls(n, types[1]), pa.nulls(n, types[1]), pa.nulls(n, pa.int64())], names=names)
            else:
                for i, j in pairs(columns):
                    for t in _terms([c[i] for c in columns[1:]], [c[j] for c in columns[1:]], percent):
                        yield pa.RecordBatch.from_arrays([*fill(t.num_rows, ROW, types), *[c.cast(x) for c, x in zip(t.columns, (types[1], types[1], pa.int64()), strict=True)]], names=names)

    out = materialize(spark, incidence.select(*ROW).mapInArrow(run, f"{rows}, a {kind}, b {kind}, least long"))
    terms, hot = out.filter("shingle is null").select("a", "b", "least"), out.filter("shingle is not null").select(*ROW)

    # Shingles of more than a block: every pair of blocks in a task.
    blocks = hot.groupBy("shingle").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).select(F.col("shingle").alias("key"), "blocks")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    tasks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least(other, F.col("block")).alias("p"), F.greatest(other, F.col("block")).alias("q")))
    dealt = hot.join(blocks, F.col("shingle") == F.col("key")).withColumn("block", own).withColumn("task", F.explode(tasks))
    dealt = dealt.select(*ROW, (F.col("block") == F.col("task.p")).alias("left"), F.struct("shingle", "task.p", "task.q").alias("task"))

    def cross(table):
        import pyarrow as pa

        columns = [table[c].to_numpy() for c in ROW[1:]]
        left, found = table["left"].to_numpy(), [pa.RecordBatch.from_arrays([pa.array([], pa_type(table)), pa.array([], pa_type(table)), pa.array([], pa.int64())], names=["a", "b", "least"])]
        task = table["task"][0].as_py()
        one = task["p"] == task["q"]
        x, y = np.flatnonzero(left), np.arange(len(left)) if one else np.flatnonzero(~left)
        step = max(1, PAIRS // max(1, len(y)))
        for at in range(0, len(x), step):
            part = x[at : at + step]
            i, j = np.repeat(part, len(y)), np.tile(y, len(part))
            if one:
                i, j = i[i < j], j[i < j]
            for t in _terms([c[i] for c in columns], [c[j] for c in columns], percent):
                found.append(pa.RecordBatch.from_arrays([c.cast(x) for c, x in zip(t.columns, found[0].schema.types, strict=True)], names=["a", "b", "least"]))
        return pa.Table.from_batches(found)

    def pa_type(table):
        return table.schema.field("rep").type

    return terms.unionByName(dealt.groupBy("task").applyInArrow(cross, f"a {kind}, b {kind}, least long"))


def summed(terms: DataFrame) -> DataFrame:
    """Pairs (a, b) with ``least`` terms or more; terms are counted map-side first."""
    return terms.groupBy("a", "b", "least").agg(F.count(F.lit(1)).alias("n")).filter("n >= least").select("a", "b")


def differences(docs: DataFrame, grouped: DataFrame, n: int, percent: int) -> DataFrame:
    """rep, root, size, linked, delta of the representatives ``grouped`` (rep, root) that share a third of all shingles with their root
    (so that a difference is no longer than the sets are, on average):
    whether the two reach the threshold, and the shingles that one of them has."""
    spark = docs.sparkSession
    sets = materialize(spark, sets_of(docs, grouped, n))
    roots = sets.filter("rep = root").select(F.col("root").alias("__root"), F.col("shingles").alias("__hub"))
    both = sets.join(roots, F.col("root") == F.col("__root")).withColumn("__less", F.array_except("__hub", "shingles")).withColumn("__more", F.array_except("shingles", "__hub"))
    overlap, size, hub = F.size("__hub") - F.size("__less"), F.size("shingles"), F.size("__hub")
    near = both.filter(4 * overlap >= size + hub)
    out = materialize(spark, near.select("rep", "root", size.alias("size"), ((100 + percent) * overlap >= percent * (size + hub)).alias("linked"), F.concat("__less", "__more").alias("delta")))
    release(sets)
    return out


def within(members: DataFrame, percent: int, block: int = GROUP, width: int = WIDTH) -> DataFrame:
    """Links (a, b) that together connect what the members (see :func:`differences`) of each group link to.

    Members linked to their root are one class already, so only those that are not (free) meet others: every block of
    free ones meets the free blocks and the blocks of linked ones.
    """
    kind = dict(members.dtypes)["rep"]
    count = lambda which: F.greatest(F.ceil(F.sum(F.when(which, 1).otherwise(0)) / block), F.ceil(F.sum(F.when(which, F.size("delta")).otherwise(0)) / width)).cast("int")
    sizes = members.groupBy("root").agg(count(~F.col("linked")).alias("free"), count(F.col("linked")).alias("tied")).filter("free > 0").withColumnRenamed("root", "__root")
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("linked"), F.col("tied")).otherwise(F.col("free"))).cast("int")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    place = lambda p, q, left, right: F.struct(p.alias("p"), q.alias("q"), left.alias("left"), right.alias("right"))
    b, yes, no = F.col("block"), F.lit(True), F.lit(False)
    free = F.concat(
        F.transform(upto(F.col("free")), lambda o: place(F.least(o, b), F.greatest(o, b), o >= b, o <= b)),
        F.transform(upto(F.col("tied")), lambda o: place(b, F.col("free") + o, yes, no)),
    )
    tied = F.transform(upto(F.col("free")), lambda o: place(o, F.col("free") + b, no, yes))
    dealt = members.join(sizes, F.col("root") == F.col("__root")).withColumn("block", own)
    dealt = dealt.withColumn("task", F.explode(F.when(F.col("linked"), tied).otherwise(free)))
    # One key, a struct: rows dealt by root alone, as the join may leave them, would all be one task's.
    dealt = dealt.select(F.struct("root", "task.p", "task.q").alias("key"), "task.left", "task.right", "rep", "size", "linked", "delta")

    def work(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        rep, size = table["rep"], table["size"].to_numpy().astype(np.int32)
        delta = table["delta"].combine_chunks()
        long = pc.list_value_length(delta).to_numpy(zero_copy_only=False).astype(np.int32)
        x, y = np.flatnonzero(table["left"].to_numpy()), np.flatnonzero(table["right"].to_numpy())
        of = np.repeat(np.arange(len(long)), long)
        _, element, many = np.unique(delta.flatten().to_numpy(), return_inverse=True, return_counts=True)
        shared = many[element] > 1  # others cannot add to an overlap
        names, element = np.unique(element[shared], return_inverse=True)
        of = of[shared]
        common = np.zeros((len(x), len(y)), np.float32)
        at_x, at_y = np.full(len(long), -1), np.full(len(long), -1)
        at_x[x], at_y[y] = np.arange(len(x)), np.arange(len(y))
        step = max(1, (1 << 21) // max(1, len(x) + len(y)))
        by = np.argsort(element, kind="stable")
        of, element = of[by], element[by]
        for lo in range(0, len(names), step):
            s, e = np.searchsorted(element, (lo, lo + step))
            rows, columns = of[s:e], element[s:e] - lo
            width_now = min(step, len(names) - lo)
            dense = []
            for at, many_rows in ((at_x, len(x)), (at_y, len(y))):
                d = np.zeros((many_rows, width_now), np.float32)
                use = at[rows] >= 0
                d[at[rows[use]], columns[use]] = 1
                dense.append(d)
            common += dense[0] @ dense[1].T
        # |A xor B| is |dA xor dB|, so the sizes give the overlap (twice, here).
        both = (size[x][:, None] + size[y]).astype(np.int64)
        twice = both - long[x][:, None] - long[y] + 2 * common.astype(np.int32)
        linked = (100 + percent) * twice >= 2 * percent * both
        tied = table["linked"].to_numpy()[y]
        label = np.arange(len(long))
        # Tied members are one class: one link to them is enough.  The rest are contracted.
        a, b = [], []
        to = linked & tied
        hit = np.flatnonzero(to.any(axis=1))
        a.append(x[hit])
        b.append(y[to[hit].argmax(axis=1)])
        rest = linked[:, ~tied]
        if rest.any():
            y = y[~tied]
            while True:
                low = label.copy()
                best = np.where(rest, label[y], len(long)).min(axis=1)
                low[x] = np.minimum(low[x], best)
                np.minimum.at(low, y, np.where(rest, low[x][:, None], len(long)).min(axis=0))
                low = low[low]
                if (low == label).all():
                    break
                label = low
            moved = np.flatnonzero(label != np.arange(len(long)))
            a.append(moved)
            b.append(label[moved])
        a, b = pa.array(np.concatenate(a)), pa.array(np.concatenate(b))
        return pa.table({"a": rep.take(a), "b": rep.take(b)})

    return dealt.groupBy("key").applyInArrow(work, f"a {kind}, b {kind}")


def sets_of(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """Columns of ``ids`` (rep, ...) and shingles of the documents (doc_id, text) whose id is in them.  Texts are not shuffled."""
    kind = dict(docs.dtypes)["doc_id"]
    wanted = id_filter(ids.select("rep"))

    def run(batches):
        import pyarrow as pa

        bitmap = wanted.value
        for batch in batches:
            use = passing(bitmap, batch.column(2).to_numpy(zero_copy_only=False))
            batch = batch.filter(pa.array(use))
            for a, b, texts in _texts(batch, 1):
                s, size = shingles(texts, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _lists(s.view(np.int64), size)], names=["rep", "shingles"])

    found = docs.select("doc_id", "text", id_slot("doc_id").alias("slot")).mapInArrow(run, f"rep {kind}, shingles array<long>")
    return found.join(ids, "rep")


def verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    spark = pairs.sparkSession
    ids = materialize(spark, pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct())
    sets = materialize(spark, sets_of(docs, ids, n))
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("__x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("__y")), "b")
    overlap = F.size(F.array_intersect("__x", "__y"))
    links = materialize(spark, both.filter((100 + percent) * overlap >= percent * (F.size("__x") + F.size("__y"))).select("a", "b"))
    release(sets, ids)
    return links


def classes(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """node, label: the least node each reaches over links (a, b); with ``rounds``, labels may stay finer than classes.

    Star contraction: every node's larger neighbours are tied to its least neighbour, then every node to its
    least one, until the links are stars: every node has one link, to a node that has none itself.  A hot node's links
    are aggregated map-side and joined back split.
    """
    spark = links.sparkSession
    edges = materialize(spark, links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    done = 0
    while True:
        # Large star: tie each larger neighbour of a node to the node's least neighbour (or itself).
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(spark, large)
        release(edges)
        # Small star: tie each smaller neighbour of a node, and the node, to its least neighbour.
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        tied = large.join(low, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = tied.union(low.select(F.col("c").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = materialize(spark, small)
        release(large)
        done += 1
        if rounds and done >= rounds:
            break
        several = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if several.isEmpty() and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    return edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")


def grouped_by_minima(reps: DataFrame) -> DataFrame:
    """rep, root: of representatives (rep, n_shingles, minima) that share two minima with a hub, and of these hubs.

    Of the holders of a minimum the hub is the one whose minima are held by most: edits change minima, so it lies amid its near
    copies, whatever the ids are.  A member has the hub that it shares most minima with.  Two neighbouring minima are looked up
    together too, as documents put together of common passages have another hub for each.  A hub that has a hub itself hands its
    members on, twice.  Sizes are within a factor of two of each other.
    """
    spark = reps.sparkSession
    spot = lambda i, j: F.struct(F.lit(i).alias("which"), F.col("minima")[i].alias("least"), (F.col("minima")[j] if j is not None else F.lit(None).cast("long")).alias("next"))
    spots = F.array(*[spot(i, None) for i in range(MINIMA)], *[spot(i, (i + 1) % MINIMA) for i in range(MINIMA)])
    spots = reps.select("rep", "n_shingles", F.explode(spots).alias("spot"))
    held = materialize(spark, spots.groupBy("spot").agg(F.count(F.lit(1)).alias("many")).filter("many > 1"))
    shared = materialize(spark, spots.join(held, "spot"))
    # Similar pairs share most minima; one alone is mostly a passage in common, which the product looks at anyway.
    alone = F.col("spot.next").isNull()
    order = shared.groupBy("rep").agg((-F.sum(F.when(alone, F.col("many")).otherwise(0))).alias("order"))
    shared = materialize(spark, shared.join(order, "rep").select("rep", "n_shingles", "spot", "order"))
    # Many may hold all minima of their group: any of them, but not those of the least ids, which may be the most edited.
    shared = shared.withColumn("order", F.struct("order", F.xxhash64("rep").alias("turn"), "rep"))
    star = shared.groupBy("spot").agg(F.min(F.struct("order", "n_shingles")).alias("hub"))
    met = shared.join(star, "spot").filter("hub.order < order").filter(2 * F.least("n_shingles", "hub.n_shingles") >= F.greatest("n_shingles", "hub.n_shingles"))
    pairs = met.groupBy(F.col("hub.order").alias("root"), "rep").agg(F.sum(F.when(alone, 1).otherwise(2)).alias("same")).filter("same > 1")
    higher = materialize(spark, pairs.groupBy("rep").agg(F.min(F.struct((-F.col("same")).alias("same"), "root")).alias("best")).select("rep", F.col("best.root.rep").alias("root")))
    for _ in range(2):
        above = higher.select(F.col("rep").alias("__rep"), F.col("root").alias("__root"))
        higher = materialize(spark, higher.join(above, F.col("root") == F.col("__rep"), "left").select("rep", F.coalesce("__root", "root").alias("root")))
    hubs = higher.select(F.col("root").alias("rep"), "root").distinct()
    return materialize(spark, higher.join(hubs.select("rep"), "rep", "left_anti").unionByName(hubs))


def link(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(spark, profiles(own, n))
    shared = spark.sparkContext.broadcast(sketch_of(rows))
    docs_only = rows.filter("part is null").select("doc_id", "n_shingles", "digest", "minima")

    # Equal sets: the least id stands for all.
    full = docs_only.filter("n_shingles > 0 and doc_id is not null")
    reps = materialize(spark, full.groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min("minima").alias("minima")))

    members, left = None, reps.select("rep", "n_shingles", "minima")
    for _ in range(ROUNDS):  # those too far from their hub look for another among themselves
        grouped = grouped_by_minima(left)
        near = differences(own, grouped, n, percent)
        members = near if members is None else members.unionByName(near)
        apart = materialize(spark, grouped.join(near.select("rep"), "rep", "left_anti"))
        if apart.isEmpty():
            break
        left = materialize(spark, left.join(apart.select("rep"), "rep", "left_semi"))
    first = members.filter("linked and rep <> root").select(F.col("root").alias("a"), F.col("rep").alias("b"))
    first = materialize(spark, first.unionByName(within(members, percent, min(block, GROUP))))
    early = classes(first, rounds=3)

    # The product across groups.
    labelled = reps.select("rep").join(early.select(F.col("node").alias("rep"), "label"), "rep", "left").join(members.select("rep", "root"), "rep", "left")
    labelled = labelled.select(F.col("rep").alias("doc_id"), F.coalesce("label", "rep").alias("label"), F.coalesce("root", "rep").alias("root"))
    packed = prefixes(own, shared, n, percent).join(labelled, "doc_id")
    incidence = packed.select(F.posexplode("prefix").alias("place", "shingle"), F.col("doc_id").alias("rep"), "size", "label", "root")
    dealt = incidence.repartition(spread(spark), "shingle").sortWithinPartitions("shingle")
    more = materialize(spark, summed(product(dealt, percent, block)))
    second = verified(more, own, n, percent)
    found = classes(first.union(second)).withColumnRenamed("node", "rep")

    known = reps.join(found, "rep", "left").select(F.col("digest").alias("__digest"), F.col("n_shingles").alias("__n"), F.coalesce("label", "rep").alias("component_id"))
    known = known.withColumn("__key", F.concat(F.hex("__digest"), F.lit(":"), F.col("__n")))
    out = docs_only.withColumn("__key", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.concat(F.hex("digest"), F.lit(":"), F.col("n_shingles"))))
    return out.join(known.select("__key", "component_id"), "__key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
