"""Best-fit packing of token pieces into sequences of fixed capacity.

Lengths are whole numbers up to the capacity, so the whole instance is a histogram with one count per length: that is
all the driver holds, whatever the number of documents. On it, ``reduce_dominated`` fixes small sets of lengths that
provably dominate every other set with the same length (Martello and Toth), and ``best_fit`` packs the rest, longest
first. The resulting bins are laid over the pieces by each piece's rank among the pieces of its length; ranks come
from per-task counters and prefix sums over tasks, so no length is ever gathered in one place.

Defined cases: a null text is an empty one and gives a single piece with the end id; a repeated row is packed once
for each copy; an empty table gives no rows; ties in rank follow the order of the input's tasks; other columns are
ignored, and only the key and the text are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import chunks, encoder
from .common import Stored

CAPACITY = 1024
END_ID = 2

#: One kind of bin: its lengths with multiplicities, longest first, and how many bins of it there are.
Pattern = tuple[tuple[tuple[int, int], ...], int]


def _fits(n: list[int], most: int, without: dict[int, int]) -> int:
    """The largest length up to ``most`` of which a piece is left besides ``without``; 0: none."""
    for t in range(min(most, len(n) - 1), 0, -1):
        if n[t] > without.get(t, 0):
            return t
    return 0


def _smallest(n: list[int], k: int, without: dict[int, int]) -> list[int]:
    out: list[int] = []
    for t in range(1, len(n)):
        free = n[t] - without.get(t, 0)
        if free > 0:
            out += [t] * min(free, k - len(out))
        if len(out) == k:
            break
    return out


def reduce_dominated(hist: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Pattern], dict[int, int]]:
    """Bins that some best packing has, and the histogram of what is left.

    For a length s with room r = capacity - s, and t the largest other length that fits: s alone if nothing fits;
    {s, t} if t = r, if no two others fit, or if no three fit and t is at least the sum of any two that fit;
    {s, t, t} if no three fit and two of t do. Each set dominates all sets with s: their other members can be
    exchanged for it, part by part. A pass goes from the longest to the shortest, until a pass fixes nothing.
    """
    n = [0] * (capacity + 1)
    for s, c in hist.items():
        n[s] = c
    fixed: list[Pattern] = []
    again = True
    while again:
        again = False
        for s in range(capacity, 0, -1):
            while n[s]:
                r, own = capacity - s, {s: 1}
                t = _fits(n, r, own)
                if not t:
                    group, times = (s,), 1 if 2 * s <= capacity else n[s]
                else:
                    low = _smallest(n, 3, own)
                    ok = t == r or len(low) < 2 or low[0] + low[1] > r
                    group = (s, t)
                    if not ok and (len(low) < 3 or sum(low) > r):
                        if 2 * t <= r and n[t] - (t == s) >= 2:
                            ok, group = True, (s, t, t)
                        else:
                            ok = t >= _best_pair(n, r, own)
                    if not ok:
                        break
                    need = {x: group.count(x) for x in group}
                    times = min(n[x] // k for x, k in need.items())
                need = {x: group.count(x) for x in group}
                for x, k in need.items():
                    n[x] -= k * times
                fixed.append((tuple(sorted(need.items(), reverse=True)), times))
                again = True
    return fixed, {s: c for s, c in enumerate(n) if c}


def _best_pair(n: list[int], r: int, without: dict[int, int]) -> int:
    """The largest sum up to r of two pieces that are left."""
    best = 0
    for a in range(1, r // 2 + 1):
        if n[a] > without.get(a, 0):
            b = _fits(n, r - a, without | {a: without.get(a, 0) + 1})
            if b:
                best = max(best, a + b)
    return best


def best_fit(hist: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Best fit, longest first, on counts: equal bins move together."""
    open_bins: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, items: tuple[tuple[int, int], ...], count: int) -> None:
        if count:
            if room not in open_bins:
                open_bins[room] = []
                rooms.insert(bisect_left(rooms, room), room)
            open_bins[room].append((items, count))

    for s in sorted(hist, reverse=True):
        left = hist[s]
        while left:
            i = bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                items, count = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(i)
            else:
                room, items, count = capacity, (), left
            k = room // s
            full = min(count, left // k)
            put(room - k * s, (*items, (s, k)), full)
            left -= full * k
            count -= full
            if count and left and left < k:
                put(room - left * s, (*items, (s, left)), 1)
                left, count = 0, count - 1
            if items:
                put(room, items, count)
    return [(items, count) for bins in open_bins.values() for items, count in bins]


def solve(hist: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, rest = reduce_dominated(hist, capacity)
    return fixed + best_fit(rest, capacity)


class Layout:
    """Where the piece of a length and rank goes."""

    def __init__(self, patterns: list[Pattern]):
        slots: dict[int, list[tuple[int, int, int, int]]] = {}
        rank: dict[int, int] = {}
        base = 0
        for items, count in patterns:
            at = 0
            for s, k in items:
                slots.setdefault(s, []).append((rank.get(s, 0), base, at, k))
                rank[s] = rank.get(s, 0) + k * count
                at += s * k
            base += count
        self.sequences = base
        self.slots = {s: np.array(v, np.int64).T for s, v in slots.items()}

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of each."""
        seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for s in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == s)
            r0, base, at, k = self.slots[s]
            j = np.searchsorted(r0, ranks[own], "right") - 1
            local = ranks[own] - r0[j]
            seq[own] = base[j] + local // k[j]
            off[own] = at[j] + local % k[j] * s
        return seq, off


def _crcs(ids: np.ndarray, offs: np.ndarray) -> pa.Array:
    data = memoryview(ids.astype("<u4")).cast("B")
    return pa.array([zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(offs[:-1].tolist(), offs[1:].tolist())], pa.int64())


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, crc: bool = False) -> DataFrame:
    """(key, piece, start, length, ids, task, nth): the token pieces of each text, and the how-many-eth of its length it is in its task.

    With ``crc`` the CRC-32 of the ids, as little-endian 32-bit numbers, stands in their place, as ids_crc32.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        task = TaskContext.get().partitionId()
        counters = np.zeros(capacity + 1, np.int64)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in chunks(texts):
                ids, n = enc.encode(texts[lo:hi])
                ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
                k = -(-n // capacity)
                doc = np.repeat(np.arange(hi - lo), k)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
                short = n - (k - 1) * capacity
                length = np.where(piece == 0, short[doc], capacity)
                start = np.where(piece == 0, 0, short[doc] + (piece - 1) * capacity)
                order = np.argsort(length, kind="stable")
                ls = length[order]
                runs = np.flatnonzero(np.concatenate([[True], ls[1:] != ls[:-1]]))
                size = np.diff(np.append(runs, len(ls)))
                nth = np.empty(len(ls), np.int64)
                nth[order] = np.arange(len(ls)) - np.repeat(runs, size) + counters[ls]
                counters[ls[runs]] += size
                offs = np.concatenate([[0], np.cumsum(length)])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()),
                        _crcs(ids, offs) if crc else pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32())), pa.array(np.full(len(doc), task), pa.int32()), pa.array(nth, pa.int64()),
                    ],
                    names=[key, "piece", "start", "length", "ids_crc32" if crc else "ids", "task", "nth"],
                )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, piece int, start long, length int, {'ids_crc32 long' if crc else 'ids array<int>'}, task int, nth long")


class Packed:
    """The packing of a table: ``stored.df`` has the pieces with their ids (or CRCs), ``place`` lays them out."""

    def __init__(self, df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, crc: bool = False):
        self.stored = Stored(pieces(df, key, text, capacity, end_id, path, crc), "pieces")
        self.by_task = Stored(self.stored.df.groupBy("task", "length").count(), "lengths").df
        hist = {r["length"]: r["n"] for r in self.by_task.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # a row for each length at most
        self.histogram = hist
        self.layout = Layout(solve(hist, capacity))

    def place(self) -> DataFrame:
        """The stored pieces with sequence_id and offset."""
        before = F.sum("count").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
        ranks = self.by_task.select("task", "length", F.coalesce(before, F.lit(0)).alias("before"))
        joined = self.stored.df.join(ranks, ["task", "length"]).withColumn("rank", F.col("before") + F.col("nth")).drop("before", "task", "nth")
        layout = self.layout
        names = joined.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    seq, off = layout.place(b.column("length").to_numpy().astype(np.int64), b.column("rank").to_numpy())
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields)
        return joined.mapInArrow(run, f"{fields}, sequence_id long, offset long").drop("rank")


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """(length, key, piece, start, ids, sequence_id, offset): every piece of every text with its ids and its place."""
    return Packed(df, key, text, capacity, end_id, path).place()


def digest(df: DataFrame) -> DataFrame:
    """Each piece with the CRC of its ids instead of them: they needn't be written."""
    return Packed(df, crc=True).place().select("doc_id", F.col("piece").cast("int"), "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
