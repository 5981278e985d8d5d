"""Removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

Every byte covered by a string of ``LENGTH`` bytes that also starts earlier (in a
document of a smaller id, or earlier in the same one) is removed; strings are judged
on the input.  Steps:

1. *Anchors.*  Each window of LENGTH bytes chooses its least hashed gram of ``SEEDS[0]``
   bytes (leftmost on ties), a function of the window's bytes alone, so equal windows choose
   equal anchors.  The windows of an anchor are consecutive; the bytes they cover are
   the anchor's context.  One pass emits a narrow row an anchor; no text is shuffled.
2. *Copies.*  Rows of equal anchor and equal context are summed in the task to the first
   of them, and then by group; every other one repeats it, window for window.
3. *Merging.*  First contexts whose anchor has other contexts too are dealt by anchor.
   A task cuts them into shards, sorts the suffixes of each shard alone and keeps its
   Burrows-Wheeler transform.  All transforms are merged by interleave refinement, from
   the transforms alone: a round deals the interleaving stably by the characters before
   each suffix, which leads through each shard's own last-to-first mapping and leaves it
   ordered by as many characters more; the block borders that appear tell how long the
   common prefixes are, and blocks of one row are done.  Suffixes with a common prefix of
   LENGTH are the repeated intervals.  Suffixes are never sorted again.
4. *Hot anchors*, of more than ``HOT`` different contexts, do not fit a task: the windows of their
   first contexts choose longer anchors, the next of ``SEEDS``, and go through steps 1 to 3 again,
   as a table of their own.  The last seed is the window itself, whose contexts are all equal,
   so this ends.
5. *Removal.*  Repeated windows go to their documents as ranges, which are joined and cut out.

The places whose bytes are merged reach the scan as a bitmap of 128 MiB at most; what it lets
through too much is dropped against the list of places before it is merged.

Defined results: null text is empty; texts shorter than LENGTH lose nothing; a text of
any length is read whole, in overlapping pieces of ``PIECE`` bytes; rows that agree in id and
text are one document (their results are equal); rows that agree in id alone are different
documents, in order of a hash of their text; a null id neither removes nor loses anything;
other columns are handed on by :func:`cut_out`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bits_array, bits_of, by_key, id_slot, materialize, passing, ranges, release, spread, tested, width

LENGTH, SEEDS = 100, (32, 64, 96, 100)
HOT = 2000  # contexts of an anchor that one task merges
CACHE = 1 << 17  # contexts that a task remembers
SHARD, UNIT = 1 << 18, 1 << 21  # bytes of a shard, and of the shards merged at once
PIECE = 1 << 19


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _grams(b: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all ``size``-grams, by doubling."""
    have, h = 1, _mix(b.astype(np.uint64) + np.uint64(0x1F123BB5))
    while have < size:
        step = min(have, size - have)
        h = _mix(h[: len(h) - step] * np.uint64(0x9E3779B97F4A7C15) + h[step:] + np.uint64(have))
        have += step
    return h


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        v = np.minimum(v[: len(v) - step], v[step:])
        have += step
    return v


_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2 ** 64."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            out, have = np.empty(n, np.uint64), 1
            out[0] = 1
            while have < n:
                more = min(have, n - have)
                out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
                have += more
            _POWERS.append(out)
    return _POWERS[0][:n], _POWERS[1][:n]


def anchors(b: np.ndarray, ends: np.ndarray, length: int = LENGTH, seed: int = SEEDS[0]):
    """Of documents joined in ``b``, each up to its entry of ``ends``: anchor hash, context digest, first and last window start of each anchor.

    Windows that leave their document are none.
    """
    nothing = (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
    if len(b) < length:
        return nothing
    h = _grams(b, seed)
    low = np.uint64(24)
    v = (h >> low << low) | np.arange(len(h), dtype=np.uint64)
    at = (_least(v, length - seed + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
    start = np.arange(len(at))
    ok = np.flatnonzero(ends[np.searchsorted(ends, start, side="right")] - start >= length)
    at = at[ok]
    if not len(ok):
        return nothing
    edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    first, last = ok[edge], ok[np.append(edge[1:], len(at)) - 1]
    eight = _grams(b, 8)
    up, down = _powers(len(eight) + 1)
    total = np.zeros(len(eight) + 1, np.uint64)
    np.cumsum(eight * up[:-1], out=total[1:])
    stop = last + length - 7
    digest = _mix((total[stop] - total[first]) * down[first] + (last - first).astype(np.uint64))
    return _mix(h[at[edge]]), digest, first, last


def _parts(column, length: int):
    """(row, offset, joined bytes, ends, starts) of texts in parts of about PIECE bytes; a longer text gives overlapping parts."""
    texts = [t.encode() if isinstance(t, str) else (t or b"") for t in column]
    for lo, hi in ranges([len(t) for t in texts], PIECE):
        group = texts[lo:hi]
        if hi - lo == 1 and len(group[0]) > 2 * PIECE:
            for at in range(0, max(1, len(group[0]) - length + 1), PIECE):
                part = group[0][at : at + PIECE + length - 1]
                yield np.array([lo]), np.array([at]), np.frombuffer(part, np.uint8), np.array([len(part)])
        else:
            sizes = np.array([len(t) for t in group])
            yield np.arange(lo, hi), np.zeros(hi - lo, np.int64), np.frombuffer(b"".join(group), np.uint8), np.cumsum(sizes)


REMOVED, LISTED, TOO_MANY, CONTEXT = 0, 1, 2, 3
_ROWS = "key long, kind byte, digest long, doc_id long, first long, more short"


def _later(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows [keys..., doc, first]: an order by all, and which rows in it equal an earlier place's keys (its own place does not count)."""
    order = np.lexsort(columns[::-1])
    *keys, doc, first = (c[order] for c in columns)
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    return order, (doc != doc[head]) | (first != first[head])


def _rows(key, kind, digest, doc, first, more, raw=None):
    import pyarrow as pa

    n = len(doc)
    full = lambda x, t: pa.array(np.broadcast_to(np.asarray(x, t), n))
    columns = [full(key, np.int64), full(kind, np.int8), full(digest, np.int64), full(doc, np.int64), full(first, np.int64), full(more, np.int16)]
    names = ["key", "kind", "digest", "doc_id", "first", "more"]
    if raw is not None:
        columns.append(pa.array(raw, pa.binary()))
        names.append("bytes")
    return pa.RecordBatch.from_arrays(columns, names=names)


class _Seen:
    """A task's memory of contexts, a place for each slot of a fixed table: most copies of a frequent one end here."""

    def __init__(self):
        self.table = np.zeros((4, CACHE), np.int64)
        self.table[2] = np.iinfo(np.int64).max  # no document

    def later(self, key, digest, doc, first) -> np.ndarray:
        """Which rows repeat a context seen at an earlier place; the others are remembered."""
        slot = (digest.view(np.uint64) % np.uint64(CACHE)).astype(np.int64)
        k, d, o, f = self.table[:, slot]
        hit = (k == key) & (d == digest) & ((o < doc) | ((o == doc) & (f < first)))
        self.table[:, slot[~hit]] = np.stack([key, digest, doc, first])[:, ~hit]
        return hit


def _scan(own: DataFrame, length: int, seed: int) -> DataFrame:
    """First pass.  CONTEXT rows (key: anchor, digest: context), the first of a task's equal ones; most others are REMOVED rows at once."""

    def run(batches):
        seen = _Seen()
        for batch in batches:
            ids, base = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            for rows, offset, b, ends in _parts(batch.column(1).to_pylist(), length):
                h, digest, first, last = anchors(b, ends, length, seed)
                if not len(h):
                    continue
                doc = np.searchsorted(ends, first, side="right")
                start = first - (ends - np.diff(ends, prepend=0) - offset - base[rows])[doc]
                order, later = _later(h, digest, ids[rows[doc]], start)
                key, digest, own_doc, start, more = (x[order] for x in (h.view(np.int64), digest.view(np.int64), ids[rows[doc]], start, last - first))
                heads = np.flatnonzero(~later)
                later[heads] = seen.later(key[heads], digest[heads], own_doc[heads], start[heads])
                spread_out = _mix(start.astype(np.uint64)).view(np.int64)
                yield _rows(np.where(later, spread_out, key), np.where(later, REMOVED, CONTEXT), digest, own_doc, start, more)

    return own.mapInArrow(run, _ROWS)


def _first_contexts(rows: DataFrame, hot_contexts: int) -> DataFrame:
    """From CONTEXT rows in order of anchor, digest and place: REMOVED rows for copies of a context, LISTED rows for the first ones
    of anchors with several, TOO_MANY rows for those of anchors with more than ``hot_contexts``.  Holds a batch and so many rows."""

    def firsts(batches):
        """(key, doc, first, more) of first contexts, and the REMOVED rows on the way, a batch at a time."""
        head = None
        for batch in batches:
            key, kind, digest, doc, first, more = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            gone = kind == REMOVED
            removed = [(doc[gone], first[gone], more[gone])]
            key, digest, doc, first, more = (x[~gone] for x in (key, digest, doc, first, more))
            new = np.ones(len(key), bool)
            if len(key):
                new[1:] = (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])
                new[0] = head is None or (key[0], digest[0]) != head[:2]
                at = np.cumsum(new) - 1
                heads = np.flatnonzero(new)
                head_doc = np.append(doc[heads], head[2] if head else 0)[at]
                head_first = np.append(first[heads], head[3] if head else 0)[at]  # place -1: the head of the batch before
                again = ~new & ((doc != head_doc) | (first != head_first))
                removed.append((doc[again], first[again], more[again]))
                head = (key[-1], digest[-1], head_doc[-1], head_first[-1])
            yield (key[new], doc[new], first[new], more[new]), [np.concatenate(c) for c in zip(*removed, strict=True)]

    def run(batches):
        import pyarrow as pa

        pending: list = []

        def heads():
            for found, removed in firsts(batches):
                if len(removed[0]):
                    pending.append(removed)
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["key", "doc_id", "first", "more"])

        for (key, doc, first, more), hot in by_key(heads(), hot_contexts):
            while pending:
                yield _rows(0, REMOVED, 0, *pending.pop())
            if hot:
                yield _rows(key, TOO_MANY, 0, doc, first, more)
                continue
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(edge, len(key)))
            several = np.repeat(size > 1, size)
            if several.any():
                yield _rows(key[several], LISTED, 0, doc[several], first[several], more[several])
        while pending:
            yield _rows(0, REMOVED, 0, *pending.pop())

    return rows.mapInArrow(run, _ROWS)


def _bytes_of(own: DataFrame, places, length: int, seed: int) -> DataFrame:
    """Second pass: CONTEXT rows with bytes for the places in bitmap ``places``."""

    def run(batches):
        for batch in batches:
            ids, base = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            for rows, offset, b, ends in _parts(batch.column(1).to_pylist(), length):
                h, _, first, last = anchors(b, ends, length, seed)
                doc = np.searchsorted(ends, first, side="right")
                start = first - (ends - np.diff(ends, prepend=0) - offset - base[rows])[doc]
                doc = ids[rows[doc]]
                use = np.flatnonzero(passing(places.value, _place_slot(doc, start, 8 * len(places.value))))
                h, first, last, doc, start = (x[use] for x in (h, first, last, doc, start))
                raw = b.tobytes()
                yield _rows(h.view(np.int64), CONTEXT, 0, doc, start, last - first, [raw[i : j + length] for i, j in zip(first.tolist(), last.tolist(), strict=True)])

    return own.mapInArrow(run, _ROWS + ", bytes binary")


def _place_slot(doc: np.ndarray, first: np.ndarray, bits: int) -> np.ndarray:
    return (_mix(doc.astype(np.int64).view(np.uint64) * np.uint64(_BASE) + first.astype(np.uint64)) % np.uint64(bits)).astype(np.int64)


def _bitmap(places: DataFrame, count: int):
    """Broadcast bitmap, sized by their number, of the slots of places (doc_id, first)."""
    size = width(count)

    def slots(batches):
        import pyarrow as pa

        for batch in batches:
            doc, first = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_place_slot(doc, first, size)))], names=["slot"])

    return bits_array(places.select("doc_id", "first").mapInArrow(slots, "slot long"), size)


def _merged(rows: DataFrame, length: int, hot_contexts: int) -> DataFrame:
    """REMOVED rows, and TOO_MANY rows with bytes, from LISTED and TOO_MANY rows and CONTEXT rows with bytes, in order of key, place and kind."""

    def known(batches, aside: list):
        """CONTEXT rows whose place is listed, at most ``hot_contexts`` a key; those of hot anchors go aside."""
        import pyarrow as pa

        last, before = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key, kind, _, doc, first, more = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            same, ahead = np.zeros(len(key), bool), np.zeros(len(key), np.int8)
            same[1:] = (key[1:] == key[:-1]) & (doc[1:] == doc[:-1]) & (first[1:] == first[:-1])
            ahead[1:] = kind[:-1]
            same[0], ahead[0] = last == (key[0], doc[0], first[0]), before
            last, before = (key[-1], doc[-1], first[-1]), kind[-1]
            same &= kind == CONTEXT
            hot = same & (ahead == TOO_MANY)
            if hot.any():
                aside.append(_rows(0, TOO_MANY, 0, doc[hot], first[hot], more[hot], batch.column(6).filter(pa.array(hot))))
            yield batch.filter(pa.array(same & (ahead == LISTED)))

    def run(batches):
        aside: list = []
        for (key, _, _, doc, first, more, raw), _ in by_key(known(batches, aside), hot_contexts):
            while aside:
                yield aside.pop()
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(edge, len(key)))
            total = np.add.reduceat([len(x) + 1 for x in raw], edge)
            # Anchors are merged together in units; an anchor is never divided.
            groups = [(b, n, t) for b, n, t in zip(edge, size, total, strict=True) if n > 1]
            for lo, hi in ranges([t for _, _, t in groups], UNIT):
                own = np.concatenate([np.arange(b, b + n) for b, n, _ in groups[lo:hi]])
                string, start, block = repeats([raw[i] for i in own], more[own].astype(np.int64) + 1, length)
                at = own[string]
                order, later = _later(block, doc[at], first[at] + start)
                yield _rows(0, REMOVED, 0, doc[at][order][later], (first[at] + start)[order][later], 0, [None] * int(later.sum()))
        while aside:
            yield aside.pop()

    return rows.mapInArrow(run, _ROWS + ", bytes binary")


def suffixes(text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The suffixes of one shard's strings in order, by prefix doubling; ends sort before all characters, equal suffixes by string."""
    n = len(text)
    left = np.repeat(begin + size, size) - np.arange(n)  # characters up to the end, with it
    s = text.astype(np.int64)
    key = np.zeros(n, np.int64)
    for i in range(7):
        part = np.zeros(n, np.int64)
        part[: n - i] = s[i:]
        key = key << 9 | np.where(left > i, part, 0)
    have, longest = 7, int(size.max())
    while True:
        if have >= longest:
            return np.argsort(key, kind="stable")
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        after = np.zeros(n, np.int64)
        after[: n - have] = rank[have:] + 1
        key = rank << 32 | np.where(left > have, after, 0)
        have *= 2


def transform(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The Burrows-Wheeler transform of a shard: the character before each suffix in order, 0 before a string's first."""
    return text[order - 1]  # the shard's last character is an end, 0


def merge(transforms: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interleave the suffixes of shards, given by their transforms alone, by refinement, as far as they repeat.

    A suffix is its place in the transforms, one after another.  A transform's own last-to-first mapping, the stable order
    of its characters, leads from a suffix to that with the character before it.  A round deals the interleaving, stably, by the
    ``k`` characters before each suffix, k being 4, 2 or 1 as their number fits 16 bits, and follows the mapping k times: what
    was in order by h characters comes out in order by h + k, in blocks of equal ones.  A block of one is done: it can only
    lead to blocks of one.  Gives the suffixes in blocks of two and more that are left after ``rounds`` characters, in order; their
    blocks; and for every suffix how long a prefix it shares with another, rounded down to a multiple of k, at most ``rounds``.
    """
    mapping, done = [], 0
    for t in transforms:
        one = np.empty(len(t), np.int32)
        one[np.argsort(t.astype(np.uint16), kind="stable")] = np.arange(done, done + len(t), dtype=np.int32)
        mapping.append(one)
        done += len(t)
    char, before = np.concatenate(transforms).astype(np.int64), np.concatenate(mapping)
    for k in (4, 2, 1):
        if rounds % k:
            continue
        gram, leads, whole, power = char.copy(), before, char > 0, 1
        for _ in range(1, k):
            power *= 257
            here = char[leads]
            gram += here * power
            whole &= here > 0
            leads = before[leads]
        used, gram = np.unique(gram, return_inverse=True)
        if len(used) < 65536:
            break
    gram = gram.astype(np.uint16)
    order = np.arange(len(char), dtype=np.int32)
    block = np.zeros(len(order), np.int32)
    shared = np.zeros(len(order), np.int16)
    for h in range(k, rounds + 1, k):
        longer = whole[order]
        order, block = order[longer], block[longer]
        key = gram[order]
        by = np.argsort(key, kind="stable")
        order, key, block = leads[order[by]], key[by], block[by]
        edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])])) if len(order) else np.empty(0, np.int64)
        many = np.diff(np.append(edge, len(order)))
        again = np.repeat(many > 1, many)
        order, block = order[again], np.repeat(np.arange(len(many), dtype=np.int32), many)[again]
        shared[order] = h
        if not len(order):
            break
    return order, block, shared


def repeats(strings: list[bytes], windows: np.ndarray, length: int, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, block) of the windows (starts below ``windows`` of each string) whose first ``length`` characters another shares."""
    size = np.array([len(s) for s in strings]) + 1
    begin = np.cumsum(size) - size
    text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int16) + 1
    text[begin + size - 1] = 0
    places, transforms = [], []
    for a, b in ranges(size.tolist(), shard):
        lo, hi = begin[a], begin[b - 1] + size[b - 1]
        order = suffixes(text[lo:hi], begin[a:b] - lo, size[a:b])
        transforms.append(transform(text[lo:hi], order))
        places.append(order + lo)
    suffix, block, shared = merge(transforms, length)
    use = shared[suffix] >= length  # the repeated intervals
    place, block = np.concatenate(places)[suffix[use]], block[use]
    string = np.searchsorted(begin, place, side="right") - 1
    start = place - begin[string]
    use = start < windows[string]
    string, start, block = string[use], start[use], block[use]
    return string, start, block


def _joined(rows: DataFrame) -> DataFrame:
    """Maximal ranges (doc_id, first, stop) of ranges in order of document and start; holds a batch and a range."""

    def run(batches):
        import pyarrow as pa

        held = None
        for batch in batches:
            doc, first, stop = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if held is not None:
                doc, first, stop = (np.append(h, x) for h, x in zip(held, (doc, first, stop), strict=True))
            if not len(doc):
                continue
            other = np.concatenate([[True], doc[1:] != doc[:-1]])
            # The running end within a document: documents are set apart by a step longer than any text.
            apart = np.cumsum(other).astype(np.int64) << 40
            reach = np.maximum.accumulate(apart + stop)
            new = other.copy()
            new[1:] |= (apart + first)[1:] > reach[:-1]
            head = np.flatnonzero(new)
            end = (reach - apart)[np.append(head[1:], len(doc)) - 1]
            doc, first = doc[head], first[head]
            held = doc[-1:], first[-1:], end[-1:]
            if len(doc) > 1:
                yield pa.RecordBatch.from_arrays([pa.array(x[:-1]) for x in (doc, first, end)], names=["doc_id", "first", "stop"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["doc_id", "first", "stop"])

    return rows.mapInArrow(run, "doc_id long, first long, stop long")


def removed(docs: DataFrame, length: int = LENGTH, seeds: tuple[int, ...] | None = None, id_col: str = "doc_id", text_col: str = "text", hot_contexts: int = HOT) -> DataFrame:
    """doc_id, spans: the maximal ranges of bytes to remove, array<struct<first, stop>>, of the documents that have any."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.lit(0).cast("long").alias("base"))
    own = own.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    parts = spread(spark)
    found, written = [], []
    for seed in seeds or (*[s for s in SEEDS if s < length], length):
        rows = _scan(own, length, seed).repartition(parts, "key").sortWithinPartitions("key", "digest", "doc_id", "first")
        one = materialize(spark, _first_contexts(rows, hot_contexts))
        written.append(one)
        found.append(one.filter(F.col("kind") == REMOVED))
        places = one.filter(F.col("kind") != REMOVED)
        if not (count := places.count()):
            break
        both = _bytes_of(own, _bitmap(places, count), length, seed).unionByName(places.withColumn("bytes", F.lit(None).cast("binary")))
        two = materialize(spark, _merged(both.repartition(parts, "key").sortWithinPartitions("key", "doc_id", "first", "kind"), length, hot_contexts))
        written.append(two)
        found.append(two.filter(F.col("kind") == REMOVED).drop("bytes"))
        hot = two.filter(F.col("kind") == TOO_MANY)
        if hot.isEmpty():
            break
        own = hot.select("doc_id", F.col("bytes").alias("text"), F.col("first").alias("base"))
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    rows = rows.select("doc_id", "first", (F.col("first") + F.col("more") + length).alias("stop"))
    whole = _joined(rows.repartition(parts, "doc_id").sortWithinPartitions("doc_id", "first"))
    spans = materialize(spark, whole.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first", "stop"))).alias("spans")))
    release(*written)
    return spans


def _told_apart(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with long ``__id``: the id, or, where ids repeat with other texts, a number in order of id and a hash of the text."""
    spark = docs.sparkSession
    own = docs.withColumn("__id", F.col(id_col).cast("long"))
    tag = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    several = own.select("__id", tag.alias("tag")).filter("__id is not null").groupBy("__id").agg(F.min("tag").alias("a"), F.max("tag").alias("b")).filter("a <> b")
    if several.isEmpty():
        return own
    numbers = own.select("__id", tag.alias("__tag")).filter("__id is not null").distinct().sort("__id", "__tag").withColumn("__number", F.monotonically_increasing_id())
    numbers = materialize(spark, numbers)
    return own.withColumn("__tag", tag).join(numbers, ["__id", "__tag"], "left").withColumn("__id", F.col("__number")).drop("__tag", "__number")


def cut_out(docs: DataFrame, length: int = LENGTH, seeds: tuple[int, ...] | None = None, id_col: str = "doc_id", text_col: str = "text", hot_contexts: int = HOT) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and binary ``kept`` (the bytes left, joined); columns of these names are replaced.

    Texts of documents that lose nothing are not shuffled.
    """
    new = ("n_bytes", "n_removed", "n_spans", "kept")
    docs = docs.select(*[c for c in docs.columns if c.lower() not in new])
    own = _told_apart(docs, id_col, text_col)
    spans = removed(own.select("__id", text_col), length, seeds, "__id", text_col, hot_contexts)
    filter_ = materialize(docs.sparkSession, bits_of(spans.select(id_slot("doc_id").alias("slot"))))
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("spans").alias("__spans"))
    marked = tested(own.withColumn("__slot", id_slot("__id")), "__slot", filter_, "__hit").drop("__slot")
    hit = marked.filter("__hit").drop("__hit").join(spans, "__id", "left").drop("__id")
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    calm = marked.filter("not __hit").select(*docs.columns, F.octet_length(raw).cast("long").alias("n_bytes"), *[F.lit(0).cast("long").alias(c) for c in new[1:3]], raw.alias("kept"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            at, text_at = batch.schema.names.index("__spans"), batch.schema.names.index(text_col)
            for a, b in ranges([len(t.as_py() or "") for t in batch.column(text_at)]):
                part = batch.slice(a, b - a)
                total, gone, many, kept = [], [], [], []
                for text, spans in zip(part.column(text_at).to_pylist(), part.column(at).to_pylist(), strict=True):
                    raw, runs = (text or "").encode(), [(x["first"], x["stop"]) for x in spans or ()]
                    ends = [0, *[e for _, e in runs]]
                    left = b"".join(raw[e:s] for e, s in zip(ends, [*[s for s, _ in runs], len(raw)], strict=True))
                    total.append(len(raw))
                    gone.append(len(raw) - len(left))
                    many.append(len(runs))
                    kept.append(left)
                rest = [c for i, c in enumerate(part.columns) if i != at]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(many, pa.int64()), pa.array(kept, pa.binary())], names=[*[n for n in batch.schema.names if n != "__spans"], "n_bytes", "n_removed", "n_spans", "kept"])

    schema = kinds + ", n_bytes long, n_removed long, n_spans long, kept binary"
    return hit.select(*docs.columns, "__spans").mapInArrow(cut, schema).unionByName(calm)
