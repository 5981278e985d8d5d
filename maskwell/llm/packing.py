"""Best-fit packing into sequences of a fixed length by linear grouping.

Tokenizing yields pieces (a document's ids, a closing id, cut into ``capacity`` from
the end).  The plan is made on the histogram of piece lengths, which has at most
``capacity`` entries however many documents there are:

1. full pieces take a sequence each;
2. lengths of ``capacity * small`` and more are cut, in order of length, into ``groups``
   groups of equal cardinality and rounded up to the largest of their group;
3. configurations of these few sizes are optimised: the linear programme of the fewest
   sequences starts from the fullest combinations (subset sums as bit sets), makes further columns as
   its prices ask for them (a knapsack each round), and is rounded down; the few slots left over
   are filled one sequence after another, again with the fullest combination;
4. every slot of a configuration takes actual lengths of its group, which leaves true gaps;
5. the small lengths, largest first, go where they fit best; what is left opens new sequences.

Few groups lose more to rounding up, many more to rounding down.  A plan is made for each number in
``GROUPS``, by the same steps, and the one with the fewest sequences is taken.

The plan maps (length, rank among the pieces of that length) to (sequence, offset); its
size depends on ``capacity`` and ``groups`` only, so it is broadcast.  Ranks come from
counts by (length, hash block) and a window within each, so that neither a frequent
length nor a hot document meets in one task.

Defined results: a null or empty text is the closing id alone; an added token of the
tokenizer's file that occurs in a text (``<|endoftext|>``) is its one id, as the library has
it; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ranges, spread
from .pretokens import splitter

CAPACITY, GROUPS, SMALL = 2048, (512, 96), 1 / 8
NEAR = 2e-4  # how much above the optimum the fractional plan may stay
ROUNDS = 400  # knapsacks of the programme at most; any number of them gives a plan
A_ROUND = 8  # configurations that a knapsack may add
CENTRE = 0.5  # weight of the best prices so far in those of a knapsack, which keeps them from swinging
CLOSING_ID = 0
ROWS_A_BLOCK = 20_000
MEMO = 100_000  # distinct pre-tokens in each of two memos


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for) of every piece.

    The tokenizer file is read on the driver and broadcast.  Its pre-tokenizer splits at ``pattern``; each distinct
    pre-token of a task goes through the tokenizer once.
    """
    with open(path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        encode, closing = _encoder(shared, pattern), _packed([CLOSING_ID])
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for a, b in ranges(sizes):
                out: dict[str, list] = defaultdict(list)
                for doc_id, text in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), strict=True):
                    array = np.frombuffer((encode(text) if text else b"") + closing, "<u4")
                    n, at = len(array), 0
                    size = n % capacity or capacity
                    for k in range(-(-n // capacity)):
                        part = array[at : at + size]
                        for name, v in (("doc_id", doc_id), ("piece", k), ("start", at), ("length", len(part)), ("ids_crc32", zlib.crc32(part.tobytes()))):
                            out[name].append(v)
                        if with_ids:
                            out["ids"].append(part.astype(np.int32))
                        at, size = at + size, capacity
                columns = [pa.array(out["doc_id"], batch.column(0).type), pa.array(out["piece"], pa.int32()), *[pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32")]]
                if with_ids:
                    columns.append(pa.array(out["ids"], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 itself, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def piece_encoder(tokenizer: str):
    """(bytes -> ids of one pre-token, texts of the added tokens) of a tokenizer's file.

    Where it is a plain byte-level BPE whose merges number its tokens, the ids are the merges' ranks, and the rank-driven encoder
    of tiktoken gives the same ids without offsets.  Elsewhere the first is None.
    """
    import json

    import tiktoken

    file = json.loads(tokenizer)
    model, plain, added = file["model"], byte_of_character(), [t["content"] for t in file["added_tokens"]]
    vocab, merges = model.get("vocab"), [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", ())]
    extra = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    level = file["pre_tokenizer"] or {}
    if model.get("type") != "BPE" or file["normalizer"] or level.get("type") != "ByteLevel" or level["add_prefix_space"] or any(model.get(k) for k in extra):
        return None, added
    if any(vocab.get(c) is None or vocab[c] > 255 for c in plain) or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None, added
    ranks = {bytes(plain[c] for c in t): i for t, i in vocab.items() if i < 256 + len(merges)}
    return tiktoken.Encoding("piece", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece, added


_encoders: dict = {}


def _packed(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def _encoder(shared, pattern: str):
    """One encoder, to packed ids, a worker process and broadcast."""
    key = id(shared.value)
    if key not in _encoders:
        find, (piece, added) = splitter(pattern), piece_encoder(shared.value)
        memo: dict[str, bytes] = {}
        before: dict[str, bytes] = {}  # the memo filled last
        library: list = []

        def tokenizer():
            """The library's, made when a text asks for it: it takes some tens of MB."""
            if not library:
                from tokenizers import Tokenizer

                library.append(Tokenizer.from_str(shared.value))
            return library[0]

        def learn(new: list[str]) -> None:
            """Ids of pre-tokens not met yet."""
            if piece:
                memo.update((w, _packed(piece(w.encode()))) for w in new)
            else:
                memo.update(zip(new, [_packed(e.ids) for e in tokenizer().encode_batch(new, add_special_tokens=False)], strict=True))

        def encode(text: str) -> bytes:
            nonlocal memo, before
            if any(t in text for t in added):  # the tokenizer takes these out before it splits
                return _packed(tokenizer().encode(text, add_special_tokens=False).ids)
            found = find(text)
            new = {*found}.difference(memo)
            if new:
                memo.update((w, before[w]) for w in new if w in before)
                if fresh := [w for w in new if w not in before]:
                    learn(fresh)
            out = b"".join(map(memo.__getitem__, found))
            if len(memo) > MEMO:
                before, memo = memo, {}
            return out

        _encoders.clear()
        _encoders[key] = (shared.value, encode)
    return _encoders[key][1]


def fullest(sizes: list[int], have: list[int], top: int, capacity: int) -> dict[int, int]:
    """The fullest set of pieces with one of group ``top`` in it: reachable sums as bits of an integer, walked back."""
    space = capacity - sizes[top]
    mask = (1 << space + 1) - 1
    reach, items, seen = 1, [], []
    for g in range(top, len(sizes)):
        size = sizes[g]
        if not size or size > space:
            continue
        for _ in range(min(have[g] - (g == top), space // size)):
            seen.append(reach)
            items.append(g)
            reach |= reach << size & mask
        if reach >> space & 1:
            break
    chosen = {top: 1}
    at = reach.bit_length() - 1
    for i in range(len(items) - 1, -1, -1):
        if not seen[i] >> at & 1:
            chosen[items[i]] = chosen.get(items[i], 0) + 1
            at -= sizes[items[i]]
    return chosen


def first_basis(sizes: list[int], counts: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns, amounts): the fullest combinations, each used until it exhausts a group, whose column it becomes.

    A column holds nothing of groups exhausted before, so the basis is triangular in that order.
    """
    left = np.array(counts, float)
    basis, amount = np.diag([float(capacity // s) for s in sizes]), np.zeros(len(sizes))
    top = 0
    while True:
        while top < len(sizes) and left[top] <= 1e-9:
            top += 1
        if top == len(sizes):
            return basis, amount
        chosen = fullest(sizes, [int(np.ceil(x)) if x > 1e-9 else 0 for x in left], top, capacity)
        last = min(chosen, key=lambda g: left[g] / chosen[g])
        times = left[last] / chosen[last]
        basis[:, last] = 0
        for g, k in chosen.items():
            basis[g, last] = k
            left[g] -= k * times
        left[last], amount[last] = 0, times


def knapsack(sizes: list[int], price: np.ndarray, capacity: int) -> tuple[np.ndarray, list]:
    """(worth of the dearest set by room, the steps that made it).  A copy at a time, from the row before it; a size worth
    no more than a shorter one takes no part."""
    best, steps, dear = np.zeros(capacity + 1), [], 1e-12
    for g in sorted(range(len(sizes)), key=sizes.__getitem__):
        if price[g] <= dear:
            continue
        size, dear = sizes[g], price[g]
        for _ in range(capacity // size):
            more = best[:-size] + dear
            better = more > best[size:] + 1e-12
            if not better.any():
                break
            best[size:] = np.where(better, more, best[size:])
            steps.append((g, size, better))
    return best, steps


def inverted(matrix: np.ndarray) -> np.ndarray:
    """The inverse by elimination with row exchanges, in element-wise steps of numpy alone: its threaded routines can stop for
    good in a driver that has trained a model before."""
    n = len(matrix)
    work = np.hstack([matrix, np.eye(n)])
    for i in range(n):
        at = i + int(np.abs(work[i:, i]).argmax())
        if at != i:
            work[[i, at]] = work[[at, i]]
        work[i] /= work[i, i]
        rows = np.flatnonzero(work[:, i])
        rows = rows[rows != i]
        work[rows] -= work[rows, i, None] * work[i]
    return work[:, n:].copy()


def optimal(sizes: list[int], counts: list[int], capacity: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], float]]:
    """(configuration, how often) that hold ``counts`` pieces of ``sizes`` in the fewest sequences, in fractions.

    Column generation: the basis gives each size a price, and a knapsack finds the dearest configurations; those worth
    more than a sequence enter the basis.  The prices also bound the optimum from below, which ends the search.
    """
    n, need = len(sizes), np.array(counts, float)
    basis, amount = first_basis(sizes, counts, capacity)
    inverse, bound, centre = inverted(basis), 0.0, None
    for turn in range(rounds):
        price = inverse.sum(0)
        asked = np.maximum(0, price if centre is None else CENTRE * centre + (1 - CENTRE) * price)
        best, steps = knapsack(sizes, asked, capacity)
        if best[-1] > 0 and (asked * need).sum() / best[-1] > bound:
            bound, centre = (asked * need).sum() / best[-1], asked / best[-1]
        if amount.sum() <= bound * (1 + NEAR):
            break
        rooms = np.flatnonzero(np.diff(best) > 0) + 1
        entered = False
        for room in rooms[np.argsort(-best[rooms], kind="stable")][:A_ROUND]:
            column, at = np.zeros(n), int(room)
            for g, size, better in reversed(steps):
                if at >= size and better[at - size]:
                    column[g] += 1
                    at -= size
            if (inverse.sum(0) * column).sum() <= 1 + 1e-7:
                continue
            change = (inverse * column).sum(1)
            ratio = np.where(change > 1e-9, amount / np.where(change > 1e-9, change, 1), np.inf)
            out = int(ratio.argmin())
            if not np.isfinite(ratio[out]):
                continue
            amount = np.maximum(0, amount - ratio[out] * change)
            amount[out] = ratio[out]
            basis[:, out] = column
            row = inverse[out] / change[out]
            inverse -= np.outer(change, row)
            inverse[out] = row
            entered = True
        if not entered:
            if centre is None or np.allclose(asked, price):
                break
            centre = price  # next time at the basis's own prices
        if turn % 25 == 24:  # against rounding
            inverse = inverted(basis)
            amount = np.maximum(0, (inverse * need).sum(1))
    return [({g: int(k) for g, k in enumerate(basis[:, c]) if k}, amount[c] + 1e-9) for c in np.argsort(-amount, kind="stable")]


class Plan:
    """Rows (length, first rank, count, first sequence, offset), made from a histogram of lengths."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS[0], small: float = SMALL):
        self.capacity, self.rows, self.sequences = capacity, [], 0
        self.used: dict[int, int] = defaultdict(int)  # ranks given out, by length
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs (first sequence, count)
        left = {n: c for n, c in histogram.items() if c}
        if full := left.pop(capacity, 0):
            self._slot(capacity, self._new(full), full, 0)
        least = max(1, int(capacity * small))
        self._large({n: c for n, c in left.items() if n >= least}, groups)
        for n in sorted((n for n in left if n < least), reverse=True):
            self._best_fit(n, left[n])

    def _new(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def _slot(self, length: int, sequence: int, count: int, offset: int) -> None:
        self.rows.append((length, self.used[length], count, sequence, offset))
        self.used[length] += count

    def _large(self, counts: dict[int, int], groups: int) -> None:
        total = sum(counts.values())
        share = max(1, -(-total // groups))
        members: list[list[list[int]]] = [[]]  # by group: runs [length, count], longest first
        room = share
        for n in sorted(counts, reverse=True):
            c = counts[n]
            while c:
                if not room:
                    members.append([])
                    room = share
                take = min(c, room)
                members[-1].append([n, take])
                c, room = c - take, room - take
        for i in range(len(members) - 1, 0, -1):  # groups of one size, that of a frequent length, are one
            if members[i][0][0] == members[i - 1][0][0]:
                members[i - 1] += members.pop(i)
        sizes = [runs[0][0] if runs else 0 for runs in members]
        have = [sum(c for _, c in runs) for runs in members]
        if total:
            for chosen, times in optimal(sizes, have, self.capacity):
                times = min(int(times), *(have[g] // k for g, k in chosen.items()))
                if times:
                    self._fill(chosen, times, members, have)
        top = 0
        while True:
            while top < len(sizes) and not have[top]:
                top += 1
            if top == len(sizes):
                return
            chosen = fullest(sizes, have, top, self.capacity)
            self._fill(chosen, min(have[g] // k for g, k in chosen.items()), members, have)

    def _fill(self, chosen: dict[int, int], times: int, members: list, have: list[int]) -> None:
        slots = []
        for g, k in chosen.items():
            have[g] -= k * times
            for _ in range(k):
                slots.append(self._take(members[g], times))
        self._substitute(slots, times)

    @staticmethod
    def _take(runs: list[list[int]], count: int) -> list[tuple[int, int]]:
        out = []
        while count:
            n, c = runs[0]
            take = min(c, count)
            out.append((n, take))
            count -= take
            if take == c:
                runs.pop(0)
            else:
                runs[0][1] -= take
        return out

    def _substitute(self, slots: list[list[tuple[int, int]]], times: int) -> None:
        """Fill ``times`` sequences with the actual lengths of each slot, run by run."""
        first, done = self._new(times), 0
        slots = [[[n, c] for n, c in runs] for runs in slots]
        while done < times:
            count = min(runs[0][1] for runs in slots)
            offset = 0
            for runs in slots:
                self._slot(runs[0][0], first + done, count, offset)
                offset += runs[0][0]
                runs[0][1] -= count
                if not runs[0][1]:
                    runs.pop(0)
            if offset < self.capacity:
                self.open[self.capacity - offset].append((first + done, count))
            done += count

    def _best_fit(self, length: int, count: int) -> None:
        gap = length
        while count and gap <= self.capacity:
            runs = self.open.get(gap)
            if not runs:
                gap += 1
                continue
            first, many = runs.pop()
            take = min(many, count)
            if take < many:
                runs.append((first + take, many - take))
            self._slot(length, first, take, self.capacity - gap)
            count -= take
            if gap > length:
                self.open[gap - length].append((first, take))
                if gap - length >= length:
                    gap = length  # these gaps hold one more
        if count:
            each = self.capacity // length
            for many, k in ((count // each, each), (1 if count % each else 0, count % each)):
                if many:
                    first = self._new(many)
                    for i in range(k):
                        self._slot(length, first, many, i * length)
                    if rest := self.capacity - k * length:
                        self.open[rest].append((first, many))


def best_plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS) -> Plan:
    """The plan of the fewest sequences among the numbers of groups."""
    return min((Plan(histogram, capacity, g) for g in groups), key=lambda p: p.sequences)


def place(cut: DataFrame, plan: Plan) -> DataFrame:
    """``cut`` (pieces with a rank among those of their length) with sequence_id and offset."""
    spark = cut.sparkSession
    table = spark.createDataFrame(plan.rows or [(0, 0, 0, 0, 0)], "__length long, __first long, __count long, __sequence long, __offset long")
    here = (F.col("length") == F.col("__length")) & (F.col("rank") >= F.col("__first")) & (F.col("rank") < F.col("__first") + F.col("__count"))
    met = cut.join(F.broadcast(table), here)  # a few runs a length, whatever the number of documents
    kept = [c for c in cut.columns if c != "rank"]
    return met.select(*kept, (F.col("__sequence") + F.col("rank") - F.col("__first")).alias("sequence_id"), F.col("__offset").alias("offset"))


def ranked(cut: DataFrame, rows: int) -> DataFrame:
    """Adds ``rank``: a number from 0 among the pieces of the same length."""
    spark = cut.sparkSession
    blocks = max(spread(spark), -(-rows // ROWS_A_BLOCK))
    dealt = cut.withColumn("__block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))
    earlier = Window.partitionBy("length").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    counted = dealt.groupBy("length", "__block").agg(F.count(F.lit(1)).alias("n"))
    base = materialize(spark, counted.select("length", "__block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__base")))
    own = Window.partitionBy("length", "__block").orderBy("doc_id", "piece")
    return dealt.withColumn("__own", F.row_number().over(own) - 1).join(base, ["length", "__block"]).withColumn("rank", (F.col("__base") + F.col("__own")).cast("long")).drop("__block", "__own", "__base")


def pack(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS, with_ids: bool = False, **columns) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset of every piece."""
    spark = docs.sparkSession
    cut = materialize(spark, pieces(docs, path, pattern, capacity, with_ids=with_ids, **columns))  # tokenized once
    histogram = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}  # capacity rows at most
    plan = best_plan(histogram, capacity, groups)
    return place(ranked(cut, sum(histogram.values())), plan)
