"""Counting with words packed two bits a base, 32 bases a number, for every k: Arrow batches in, rows of counts out.

A batch's sequences lie end to end with a break between them. The codes of all blocks come from doublings, windows with
another byte inside drop out. A word is held as its key: blocks of 32 bases, each read from its last base, so that the
order of keys is the reference order; ``order="lex"`` above 32 bases holds blocks read from the first base.

Up to ``DENSE`` bases a task counts into one array over all words. Above it, below ``STRETCHED`` bases, each slice of
windows is sorted and its distinct words go out with their counts. What goes out is a row per part, not per word: the
words are dealt into parts by a hash and each part of a slice is one block of bytes. A reducer merges whole parts, as
many at once as fill ``MERGE`` numbers, and spells each distinct word once.

From ``STRETCHED`` bases on no words go out but stretches: the bases of consecutive windows that have the same least
hash of m bases, four to a byte. That hash is the same for a word and its images, so all windows of a word or class are
in one part. Equal stretches of a slice go out once with their number. So the one shuffle carries one byte and a half a
window or less, whatever k is; reducers take the words out of the stretches, those of a part in several passes if it has
more than ``MERGE`` windows twice over (fewer if a word takes three numbers or more), each for the words of one remainder of their hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna

U = np.uint64
#: Windows that are sorted at once.
SLICE = 1 << 21
#: Longest words that are counted in one array a task.
DENSE = 11
#: Least length of words that are sent as stretches of windows, and the most bases whose hash deals them.
STRETCHED, CORE = 21, 19
#: Windows of a stretch at most: their number is one byte.
LONGEST = 255
#: Numbers of 8 bytes that the words take that a reducer merges at once, if they are of several parts.
MERGE = 1 << 20
#: Windows whose words are taken out of stretches at once: few enough for a core's cache.
STEP = 1 << 15
#: Rows of a result's batch times the numbers of a word.
OUT = 1 << 18
#: Parts into which words are dealt: one for about so many bytes of input, between these bounds.
PART_BYTES, PARTS = 1 << 20, (1 << 8, 1 << 18)
#: Bytes of input times bases of a word for which a reducer spells words, where that makes more reducers than the session's.
SPELLED = 1 << 28
#: Transforms in the order of their counters.
TAGS = ("i", "r", "c", "rc")

_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate(b"ACGT"):
    _CODE[_c] = _CODE[_c + 32] = _i
_LETTER = np.frombuffer(b"ACGT", np.uint8)
_FOUR = np.stack([_LETTER[np.arange(256) >> s & 3] for s in (6, 4, 2, 0)], 1)
#: The letters of two bytes, the lower one first: each byte read from its first base, and from its last.
_EIGHT = [np.concatenate([np.tile(x, (256, 1)), np.repeat(x, 256, 0)], 1).view(np.uint64).ravel() for x in (_FOUR, np.ascontiguousarray(_FOUR[:, ::-1]))]


def _join(arr: pa.Array) -> np.ndarray:
    """Base codes of all texts, each followed by a break."""
    arr = arr.cast(pa.large_binary())
    n = len(arr)
    if arr.null_count:
        arr = arr.fill_null(b"")
    offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
    data = arr.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return np.insert(_CODE[data], offs[1:] - offs[0], 4)


def _mask(m: int) -> np.uint64:
    return U((1 << 2 * m) - 1)


def codes(base: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(forward, reverse complement) codes of the m bases from each place on, m up to 32; the first base is the most significant."""
    n = len(base) - m + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, U)
    f = (base & 3).astype(U)
    r = U(3) - f
    done_f = done_r = None
    done, have, left = 0, 1, m
    while left:
        if left & 1:
            if done_f is None:
                done_f, done_r = f, r
            else:
                size = len(done_f) - have
                done_f = (done_f[:size] << U(2 * have)) | f[done : done + size]
                done_r = done_r[:size] | (r[done : done + size] << U(2 * done))
            done += have
        left >>= 1
        if left:
            size = len(f) - have
            f, r = (f[:size] << U(2 * have)) | f[have:], r[:size] | (r[have:] << U(2 * have))
            have *= 2
    return done_f[:n], done_r[:n]


def words(base: np.ndarray, k: int, keys: bool = True) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The blocks of each window free of breaks and those of its reverse complement, as keys or read from the first base."""
    n = len(base) - k + 1
    if n <= 0:
        return ([np.zeros(0, U)] * (-(-k // 32)),) * 2
    broken = np.zeros(len(base) + 1, np.int32)
    np.cumsum(base > 3, out=broken[1:])
    at = np.flatnonzero(broken[k:] == broken[:-k])
    whole = (k - 1) // 32
    rest = k - 32 * whole
    f0, r0 = codes(base, 32) if whole else (None, None)
    f1, r1 = codes(base, rest)
    here = [f0[at + 32 * b] for b in range(whole)] + [f1[at + 32 * whole]]
    back = [r0[at + (k - 32 * (b + 1))] for b in range(whole)] + [r1[at]]
    if not keys:
        return here, back
    # A block read from its last base is the complement of its reverse complement.
    size = [32] * whole + [rest]
    return [~r0[at + 32 * b] for b in range(whole)] + [~r1[at + 32 * whole] & _mask(rest)], [~f0[at + (k - 32 * (b + 1))] for b in range(whole)] + [~f1[at] & _mask(size[-1])]


def _less(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    less, equal = a[0] < b[0], a[0] == b[0]
    for x, y in zip(a[1:], b[1:]):
        less |= equal & (x < y)
        equal &= x == y
    return less


def _pick(take: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return [np.where(take, x, y) for x, y in zip(a, b)]


def canonical(own: list[np.ndarray], back: list[np.ndarray]) -> list[np.ndarray]:
    return [np.minimum(own[0], back[0])] if len(own) == 1 else _pick(_less(back, own), back, own)


def classes(own: list[np.ndarray], back: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The least of the four images, ties in the order I, RC, C, R, with the transform: below 32 bases in the lowest two bits, else as one number more."""
    masks = [_mask(32)] * (len(own) - 1) + [_mask(k - 32 * (len(own) - 1))]
    best, tag = own, np.zeros(len(own[0]), U)
    for t, image in ((3, back), (2, [~x & m for x, m in zip(own, masks)]), (1, [~x & m for x, m in zip(back, masks)])):
        less = _less(image, best)
        best, tag = _pick(less, image, best), np.where(less, U(t), tag)
    return [best[0] << U(2) | tag] if k < 32 else [*best, tag]


def spell(blocks: list[np.ndarray], k: int, keys: bool = True) -> pa.Array:
    """The words of blocks."""
    n = len(blocks[0])
    out = np.empty((n, k), np.uint8)
    eight = _EIGHT[keys]
    for b, x in enumerate(blocks):
        size = min(32, k - 32 * b)
        x = np.ascontiguousarray(x if keys else (x << U(64 - 2 * size)).byteswap())
        out[:, 32 * b : 32 * b + size] = eight[x.view(np.uint16)].view(np.uint8).reshape(n, 32)[:, :size]
    return pa.StringArray.from_buffers(n, pa.py_buffer((np.arange(n + 1) * k).astype(np.int32)), pa.py_buffer(out))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(27))


def _hash(lanes: list[np.ndarray], shift: int = 0) -> np.ndarray:
    h = np.zeros(len(lanes[0]), U)
    for x in lanes:
        h = _mix(h ^ (x >> U(shift)) * U(0x9E3779B97F4A7C15))
    return h


def _merge(lanes: list[np.ndarray], n: np.ndarray | None, tagged: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows, and the sums of their counts (None: one each); rows that differ only in the last lane, if it is a tag, follow each other.

    Words of several lanes stay in the order in which they first appear: those of one stretch share all bases but one with
    their neighbours, and a file of them takes a third or less of the bytes that it takes in the order of hashes.
    """
    if len(lanes) == 1 and n is None:
        keys, n = np.unique(lanes[0], return_counts=True)
        return [keys], n
    if not len(lanes[0]):
        return lanes, np.zeros(0, np.int64)
    words = lanes[:-1] if tagged else lanes
    h = lanes[0] if len(lanes) == 1 else _hash(words)
    if tagged:
        h = h & ~U(3) | lanes[-1]
    order = np.argsort(h)
    h = h[order]
    new = _changes([h])
    if len(lanes) > 1:
        like = np.flatnonzero(~_changes([h & ~U(3)]) if tagged else ~new)
        if any((x[order[like]] != x[order[like - 1]]).any() for x in words):  # different words with one hash may alternate
            order = np.lexsort(lanes[::-1])
            new = _changes(x[order] for x in lanes)
    first = np.flatnonzero(new)
    total = np.diff(np.append(first, len(order))) if n is None else np.add.reduceat(n[order], first)
    first = np.minimum.reduceat(order, first)
    if len(lanes) > 1:
        seat = np.full(len(order), -1)
        if tagged:
            begin = np.flatnonzero(_changes(x[first] for x in words))
            size = np.diff(np.append(begin, len(first)))
            seat[np.minimum.reduceat(first, begin)] = np.arange(len(begin))
            seat = seat[seat >= 0]
            seat = np.repeat(begin[seat], size[seat]) + _ramp(size[seat])
        else:
            seat[first] = np.arange(len(first))
            seat = seat[seat >= 0]
        first, total = first[seat], total[seat]
    return [x[first] for x in lanes], total.astype(np.int64)


def _changes(lanes: Iterable[np.ndarray]) -> np.ndarray:
    """Whether a row differs from the one before."""
    new = None
    for x in lanes:
        new = np.arange(len(x)) == 0 if new is None else new
        new[1:] |= x[1:] != x[:-1]
    return new


def _rows(lanes: list[np.ndarray], n: np.ndarray, parts: int, key_lanes: int, shift: int) -> pa.RecordBatch:
    """(part, words, n): the blocks of bytes of distinct words, by part; counts take as few bytes as the largest needs."""
    h = _hash(lanes[:key_lanes], shift)  # a class has one part, whatever the transform
    part = (h >> U(33)) & U(parts - 1)
    part = part.astype(np.uint16 if parts <= 1 << 16 else np.uint32)
    order = np.argsort(part, kind="stable")
    part = part[order]
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    cut = np.append(first, len(part))
    data = np.stack([x[order] for x in lanes], 1) if len(lanes) > 1 else lanes[0][order]
    most = int(n.max()) if len(n) else 0
    n = n[order].astype(np.uint8 if most < 1 << 8 else np.uint32 if most < 1 << 32 else np.int64)

    def binary(x: np.ndarray, size: int) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((cut * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])

    return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), binary(data, 8 * len(lanes)), binary(n, n.itemsize)], names=["part", "words", "n"])


def _least(base: np.ndarray, k: int, four: bool) -> np.ndarray:
    """For each window the least hash of the words of m bases in it, the same for the window's images."""
    m = min(CORE, k // 2 + 1)
    f, r = codes(base, m)
    least = np.minimum(f, r)
    if four:
        least = np.minimum(least, np.minimum(~f & _mask(m), ~r & _mask(m)))
    h = (_mix(least * U(0x9E3779B97F4A7C15)) >> U(32)).astype(np.uint32)
    size, w = 1, k - m + 1
    while 2 * size <= w:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (w - size)], h[w - size :]) if size < w else h


def _ramp(n: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each number."""
    end = np.cumsum(n)
    return np.arange(end[-1] if len(n) else 0) - np.repeat(end - n, n)


def _stretches(base: np.ndarray, k: int, four: bool, parts: int) -> pa.RecordBatch | None:
    """(part, words, sizes, n): the stretches of a slice by part, as bytes of four bases, their numbers of windows and how often they occur."""
    broken = np.zeros(len(base) + 1, np.int32)
    np.cumsum(base > 3, out=broken[1:])
    at = np.flatnonzero(broken[k:] == broken[:-k])
    if not len(at):
        return None
    least = _least(base, k, four)[at]
    first = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1])))
    n = np.diff(np.append(first, len(at)))
    pieces = -(-n // LONGEST)
    nth = _ramp(pieces)
    start, size = np.repeat(at[first], pieces) + LONGEST * nth, np.minimum(np.repeat(n, pieces) - LONGEST * nth, LONGEST)
    part = _mix(np.repeat(least[first], pieces).astype(U) * U(0xD6E8FEB86659FD93)) >> U(20) & U(parts - 1)
    coded = np.append(base & 3, np.zeros(4, np.uint8))
    coded = coded[:-3] | coded[1:-2] << 2 | coded[2:-1] << 4 | coded[3:] << 6

    def packed(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes, the place of each within its stretch, and the first of each stretch."""
        length = _bytes(size, k)
        nth, end = _ramp(length), np.cumsum(length)
        data = coded[np.repeat(start, length) + 4 * nth]
        data[end - 1] &= np.array([255, 3, 15, 63], np.uint8)[(size + (k - 1)) % 4]
        return data, nth, end - length

    data, nth, first = packed(start, size)
    h = np.add.reduceat(data * _WEIGHT[nth], first) + size.astype(U)
    h = part << U(46) | _mix(h * U(0x9E3779B97F4A7C15)) >> U(18)
    order = np.argsort(h)
    h, part, start, size = h[order], part[order], start[order], size[order]
    new = np.append(True, (h[1:] != h[:-1]) | (size[1:] != size[:-1]))
    like = np.flatnonzero(~new)
    if len(like):
        (a, _, cut), (b, _, _) = packed(start[like], size[like]), packed(start[like - 1], size[like])
        new[like[~np.logical_and.reduceat(a == b, cut)]] = True
    kept = np.flatnonzero(new)
    times = np.diff(np.append(kept, len(new)))
    part, start, size = part[kept], start[kept], size[kept]
    data, _, offs = packed(start, size)
    first = np.flatnonzero(_changes([part]))
    most = int(times.max())
    times = times.astype(np.uint8 if most < 1 << 8 else np.uint32)

    def binary(x: np.ndarray, cut: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(x)])

    ends = np.append(first, len(kept))
    columns = [pa.array(part[first].astype(np.int32)), binary(data, np.append(offs[first], len(data))), binary(size.astype(np.uint8), ends), binary(times, ends * times.itemsize)]
    return pa.RecordBatch.from_arrays(columns, names=["part", "words", "sizes", "n"])


#: Odd numbers that a stretch's bytes are multiplied by for its hash.
_WEIGHT = _mix(np.arange(1, 1 + (LONGEST + 127) // 4 + 2, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def _bytes(size: np.ndarray, k: int) -> np.ndarray:
    """Bytes of stretches of so many windows."""
    return (size + (k + 2)) // 4


def _turned(x: np.ndarray) -> np.ndarray:
    """The 32 bases of a number in the other direction."""
    x = x.byteswap()
    for s, m in ((U(4), U(0x0F0F0F0F0F0F0F0F)), (U(2), U(0x3333333333333333))):
        x = x >> s & m | (x & m) << s
    return x


def _unpacked(data: np.ndarray, at: np.ndarray, k: int, keys: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """As ``words``, for windows that begin at bases ``at`` of bytes with 8 to spare."""
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    whole = (k - 1) // 32
    rest = k - 32 * whole

    def blocks(at: np.ndarray, n: int) -> list[np.ndarray]:
        byte, shift = at >> 2, ((at & 3) << 1).astype(U)
        return [eight[byte + 8 * b] >> shift | data[byte + 8 * (b + 1)].astype(U) << U(64) - shift for b in range(n)]

    own = blocks(at, whole + 1)
    back = [~x for x in [*blocks(at + rest, whole)[::-1], own[0]]]
    back[-1] = back[-1] & _mask(rest)
    own[-1] = own[-1] & _mask(rest)
    turn = back if keys else own
    turn[:] = [_turned(x) for x in turn]
    turn[-1] = turn[-1] >> U(64 - 2 * rest)
    return own, back


def _size(df: DataFrame) -> int | None:
    """Bytes of the input as far as the planner knows it: it counts stored columns by their types, four times too little for texts."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return None if size > 1 << 60 else 4 * size


def _parts(size: int | None) -> int:
    """Parts for an input of ``size`` bytes; None: 16384."""
    size = 16384 * PART_BYTES if size is None else size
    return min(max(1 << max(0, (size // PART_BYTES - 1).bit_length()), PARTS[0]), PARTS[1])


def cut(df: DataFrame, k: int, seq: str = "seq", chunk: int = 1 << 20) -> DataFrame:
    """(seq): pieces of the bytes of each text, such that every window begins in exactly one; in one pass, however long a text is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arr = b.column(0).cast(pa.large_binary())
            held, size = [], 0
            for x in arr:
                if not x.is_valid:
                    continue
                data = memoryview(x.as_buffer())
                for lo in range(0, max(len(data) - k + 1, 0), chunk):
                    held.append(data[lo : lo + chunk + k - 1])
                    size += len(held[-1])
                    if size > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["seq"])
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["seq"])

    return df.select(F.col(seq).alias("seq")).mapInArrow(run, "seq binary")


def _counted(df: DataFrame, k: int, seq: str, four: bool, order: str, chunk: int, spread: int | None, partitions: int | None, size: int | None) -> DataFrame:
    dna.check_k(k)
    dna.check_order(order)
    keys = four or order == "reference" or k <= 32
    n_words = -(-k // 32)
    lanes_of = n_words + (four and k >= 32)
    shift, tagged = 2 if four and k < 32 else 0, four and k >= 32
    step = SLICE // 2 if k >= STRETCHED else max(1, SLICE // n_words)
    hold, most, batch = max(1, MERGE // lanes_of), max(1, 2 * MERGE // -(-lanes_of // 2)), OUT // lanes_of
    rows = cut(df, k, seq, chunk).repartition(spread) if spread else df.select(F.col(seq).alias("seq"))
    size = _size(df) if size is None else size
    parts, stretched = _parts(size), k >= STRETCHED
    if not partitions and stretched and size:
        need = -(-size * k // SPELLED)
        partitions = need if need > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None

    def lanes(base: np.ndarray) -> list[np.ndarray]:
        own, back = words(base, k, keys)
        return classes(own, back, k) if four else canonical(own, back)

    def bases(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        """Stretches of at most ``step`` windows; those of a longer one overlap."""
        held, size = [], 0

        def cuts() -> Iterator[np.ndarray]:
            whole = np.concatenate(held)
            for lo in range(0, max(len(whole) - k + 1, 0), step):
                yield whole[lo : lo + step + k - 1]

        for b in batches:
            for lo in range(0, b.num_rows, 64):
                held.append(_join(b.column(0).slice(lo, 64)))
                size += len(held[-1])
                if size >= step:
                    yield from cuts()
                    held, size = [], 0
        if held:
            yield from cuts()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if k <= DENSE:
            total = np.zeros(4**k, np.int64)
            for base in bases(batches):
                got = words(base, k, False)[0][0].astype(np.int64)
                if 8 * len(got) > len(total):
                    total += np.bincount(got, minlength=len(total))
                else:
                    np.add.at(total, got, 1)
            seen = np.flatnonzero(total)
            if len(seen):
                letters = np.stack([(seen >> 2 * (k - 1 - i) & 3) for i in range(k)] + [np.full(len(seen), 4)], 1).astype(np.uint8).ravel()
                yield _rows(*_merge(lanes(letters), total[seen]), parts, n_words, shift)
            return
        for base in bases(batches):
            if stretched:
                found = _stretches(base, k, four, parts)
                if found:
                    yield found
                continue
            found = lanes(base)
            if len(found[0]):
                yield _rows(*_merge(found, None), parts, n_words, shift)

    def numbers(x: pa.Scalar, rows: int) -> np.ndarray:
        data = x.as_buffer()
        return np.frombuffer(data, {1: np.uint8, 4: np.uint32, 8: np.int64}[len(data) // rows]).astype(np.int64)

    def merged(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        data = np.concatenate([np.frombuffer(w.as_buffer(), U) for w, _ in held]).reshape(-1, lanes_of)
        n = [numbers(c, len(w.as_buffer()) // (8 * lanes_of)) for w, c in held]
        yield from out(*_merge([np.ascontiguousarray(data[:, i]) for i in range(lanes_of)], np.concatenate(n), tagged))

    def taken(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """The words of whole parts' stretches."""
        data = np.concatenate([*(np.frombuffer(w.as_buffer(), np.uint8) for w, _, _ in held), np.zeros(16, np.uint8)])
        size = np.concatenate([np.frombuffer(z.as_buffer(), np.uint8) for _, z, _ in held]).astype(np.int64)
        times = np.concatenate([numbers(c, len(z.as_buffer())) for _, z, c in held])
        end, length = np.cumsum(size), _bytes(size, k)
        start = 4 * (np.cumsum(length) - length)
        passes = max(1, int(end[-1]) // most)
        cuts = np.unique(np.append(np.searchsorted(end, np.arange(0, end[-1], STEP)), len(size))).tolist()
        once = bool((times == 1).all())
        for nth in range(passes):
            found, n = [], []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                own, back = _unpacked(data, np.repeat(start[lo:hi], size[lo:hi]) + _ramp(size[lo:hi]), k, keys)
                some = classes(own, back, k) if four else canonical(own, back)
                many = None if once else np.repeat(times[lo:hi], size[lo:hi])
                if passes > 1:
                    here = np.flatnonzero(_hash(some[:n_words], shift) % U(passes) == nth)
                    some, many = _merge([x[here] for x in some], many if once else many[here], tagged)
                found.append(some)
                n.append(many)
            del own, back, some, many
            found, n = [np.concatenate(x) for x in zip(*found)], None if n[0] is None else np.concatenate(n)
            found, n = _merge(found, n, tagged)
            yield from out(found, n)

    def out(found: list[np.ndarray], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not four:
            for lo in range(0, len(n), batch):
                yield pa.RecordBatch.from_arrays([spell([x[lo : lo + batch] for x in found], k, keys), pa.array(n[lo : lo + batch])], names=["kmer", "count"])
            return
        tag = (found[0] & U(3) if k < 32 else found[-1]).astype(np.int64)
        blocks = [found[0] >> U(2)] if k < 32 else found[:-1]
        new = _changes(blocks)
        at = np.cumsum(new) - 1
        counters = np.zeros((int(new.sum()), 4), np.int64)
        counters[at, tag] = n
        blocks = [x[new] for x in blocks]
        for lo in range(0, len(counters), batch):
            each = [pa.array(np.ascontiguousarray(counters[lo : lo + batch, t])) for t in range(4)]
            yield pa.RecordBatch.from_arrays([spell([x[lo : lo + batch] for x in blocks], k), *each], names=["class_kmer", *(f"count_{t}" for t in TAGS)])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for b in batches:
            for part, *x in zip(b.column(0).to_pylist(), *b.columns[1:]):
                if part != last and size >= hold:
                    yield from (taken if stretched else merged)(held)
                    held, size = [], 0
                held.append(x)
                size += int(np.frombuffer(x[1].as_buffer(), np.uint8).sum(dtype=np.int64)) if stretched else len(x[0].as_buffer()) // (8 * lanes_of)
                last = part
        if held:
            yield from (taken if stretched else merged)(held)

    blocks = rows.mapInArrow(count, "part int, words binary, sizes binary, n binary" if stretched else "part int, words binary, n binary")
    dealt = (blocks.repartition(partitions, "part") if partitions else blocks.repartition("part")).sortWithinPartitions("part")
    return dealt.mapInArrow(merge, "class_kmer string, " + ", ".join(f"count_{t} long" for t in TAGS) if four else "kmer string, count long")


def count_packed(df: DataFrame, k: int, seq: str = "seq", order: str = "reference", chunk: int = 1 << 20, spread: int | None = None, partitions: int | None = None, size: int | None = None) -> DataFrame:
    """(kmer, count) under reverse complement. ``spread`` deals chunks of the sequences to that many tasks, ``partitions`` the words; ``size``: bytes of input."""
    return _counted(df, k, seq, False, order, chunk, spread, partitions, size)


def count_classes_packed(df: DataFrame, k: int, seq: str = "seq", chunk: int = 1 << 20, spread: int | None = None, partitions: int | None = None, size: int | None = None) -> DataFrame:
    """(class_kmer, count_i, count_r, count_c, count_rc): a row per class under all four symmetries."""
    return _counted(df, k, seq, True, "reference", chunk, spread, partitions, size)
