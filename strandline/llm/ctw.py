"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions; the decision after bit prefix b in context s has a Krichevsky-Trofimov estimate at
every depth of s, and the estimates of all depths are mixed with the weights 1/2 of context-tree weighting. Contexts
are the last ``DEPTH`` bytes as they are, in upper and lower case. Byte 255, which UTF-8 never has, ends a text.

The tree grows with the corpus and is never in one place. Texts are packed into chunks; a chunk asks once for each
gram (context and byte) it has, with its count in training texts. A gram is a number whose highest byte is the
latest of the context, so each node of the tree is a range of grams: asked grams are dealt by range, evenly whatever
their frequency, and nearly all nodes lie within one range. The few that a bound cuts are summed over ranges and
finished by the driver, at most 2 * DEPTH contexts a range. Each range then answers its chunks in their own order.

``Model`` is the same mixture over classes of bytes (32, 32, 32 and 8 of them), held in memory.

Beside it stands the plain word model. Its counts are exact for every word: the commonest words, at most ``HOT`` of
them, are broadcast; all other words are looked up by a join.

Defined cases: a null or empty text is one end token; a null id counts as an empty id text; a repeated row counts and
is scored once for each copy; without training rows every probability of a bit is 1/2; other columns are ignored.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored
from .textvec import LOWER, Words, pieces

#: Classes of the last byte, of that before, and so on.
SIZES = (32, 32, 32, 8)
END = 255
#: Bound on the words whose counts are broadcast: 16 bytes each.
HOT = 1 << 19
#: Contexts whose 256 byte counts are unfolded at once.
BLOCK = 2048
#: Bytes of context; a gram has 8 * DEPTH + 8 bits.
DEPTH = 6
#: Bytes of text that ask together; a longer text asks alone.
PACK = 1 << 24
#: Positions handled at once.
WINDOW = 1 << 19
#: Ranges of a chunk's grams that are merged apart.
SHARES = 8
#: Asked grams in a range, and one of how many is looked at to find the bounds.
RANGE, STEP = 400_000, 4096


def _classes() -> np.ndarray:
    """32 classes: a-z, digits, white space, points, other ASCII, following bytes and leading bytes of UTF-8."""
    out = np.full(256, 29, np.int64)
    out[97:123] = np.arange(26)
    out[65:91] = np.arange(26)
    out[48:58] = 26
    out[[32, 9, 10, 11, 12, 13]] = 27
    out[list(b".,;:!?'\"-")] = 28
    out[128:192] = 30
    out[192:] = 31
    return out


CLASS = _classes()


def contexts(buf: np.ndarray, offs: np.ndarray, sizes: tuple[int, ...] = SIZES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, byte, offsets) of all bytes of all texts, lower-cased, each text with its end; before a text stands white space."""
    pad, n = len(sizes), len(offs) - 1
    size = np.diff(offs)
    doc = np.repeat(np.arange(n), size)
    x = np.full(len(buf) + n * (pad + 1), 32, np.uint8)
    x[np.arange(len(buf)) + (pad + 1) * doc + pad] = LOWER[buf]
    ends = np.cumsum(size + pad + 1) - 1
    x[ends] = END
    real = np.ones(len(x), bool)
    real[(ends - size - pad)[:, None] + np.arange(pad)[None]] = False
    k = CLASS[x]
    code = np.zeros(len(x) - pad, np.int64)
    for d, s in enumerate(sizes, 1):
        code = code * s + k[pad - d : len(x) - d] % s
    real = real[pad:]
    return code[real], x[pad:][real], np.concatenate([[0], np.cumsum(size + 1)])


def gram_counts(df: DataFrame, text: str = "text", sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """(code, n): how often each byte follows each context; code = 256 * context + byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            for _, _, buf, offs in pieces(b.column(0)):
                ctx, sym, _ = contexts(buf, offs, sizes)
                u, n = np.unique(ctx * 256 + sym, return_counts=True)
                held, code = np.unique(np.concatenate([held, u]), return_inverse=True)
                counts = np.bincount(code, np.concatenate([counts, n])).astype(np.int64)
        for lo in range(0, len(held), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(held[lo : lo + (1 << 16)]), pa.array(counts[lo : lo + (1 << 16)])], names=["code", "n"])

    return df.select(text).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


_LGAMMA_HALF = math.lgamma(0.5)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma of positive numbers, by Stirling's series at x + 8."""
    y = x + 8.0
    p = x.copy()
    for k in range(1, 8):
        p *= x + k
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(p)


_SMALL = [_lgamma(np.arange(4096) + 0.5), _lgamma(np.arange(4096) + 1.0)]


def _lgamma_of(n: np.ndarray, whole: int) -> np.ndarray:
    """Log gamma of the counts n plus 1/2, or plus 1."""
    small = n < 4096
    out = _SMALL[whole][np.where(small, n, 0).astype(np.int64)]
    big = np.flatnonzero(~small.ravel())
    out.ravel()[big] = _lgamma(n.ravel()[big] + (1.0 if whole else 0.5))
    return out


def _log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _lgamma_of(n0, 0) + _lgamma_of(n1, 0) - 2 * _LGAMMA_HALF - _lgamma_of(n0 + n1, 1)


def _bits(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From counts of bytes (rows, 256) the counts of zeros and ones after each of the 255 bit prefixes, which are 1, 2, 3, ..."""
    tree = np.zeros((len(n), 512))
    tree[:, 256:] = n
    for p in range(255, 0, -1):
        tree[:, p] = tree[:, 2 * p] + tree[:, 2 * p + 1]
    return tree[:, 2:512:2], tree[:, 3:512:2]


def _log_bytes(p1: np.ndarray) -> np.ndarray:
    """From the probability of a one after each prefix the log10 probability of each byte."""
    out = np.zeros((len(p1), 512))
    for p in range(1, 256):
        out[:, 2 * p] = out[:, p] + np.log10(1 - p1[:, p - 1])
        out[:, 2 * p + 1] = out[:, p] + np.log10(p1[:, p - 1])
    return out[:, 256:].astype(np.float32)


class Model:
    """``table[row[context], byte]``: log10 of the probability. Contexts not seen share the row of their longest part seen."""

    def __init__(self, code: np.ndarray, n: np.ndarray, sizes: tuple[int, ...] = SIZES):
        self.sizes = sizes
        depth = len(sizes)
        order = np.argsort(code)
        code, n = code[order], n[order].astype(np.float64)
        ctx, sym = code >> 8, code & 255
        keys = [np.unique(ctx)]
        for s in reversed(sizes):
            keys.insert(0, np.unique(keys[0] // s))
        up = [None] + [np.searchsorted(keys[d - 1], keys[d] // sizes[d - 1]) for d in range(1, depth + 1)]
        deep = np.searchsorted(keys[-1], ctx)
        total = len(keys[-1])

        def leaves(lo: int, hi: int) -> np.ndarray:
            i, j = np.searchsorted(deep, [lo, hi])
            out = np.zeros((hi - lo, 256))
            out[deep[i:j] - lo, sym[i:j]] = n[i:j]
            return out

        # Upwards: counts, and the log of the weighted probability of each node's children. The deepest contexts pass in blocks.
        below = [np.zeros((len(k), 255)) for k in keys[:-1]]
        counts = [np.zeros((len(k), 256)) for k in keys[:-1]]
        for lo in range(0, total, BLOCK):
            hi = min(lo + BLOCK, total)
            block = leaves(lo, hi)
            if depth:
                np.add.at(counts[-1], up[depth][lo:hi], block)
                np.add.at(below[-1], up[depth][lo:hi], _log_kt(*_bits(block)))
        own = [None] * depth
        for d in range(depth - 1, -1, -1):
            own[d] = _log_kt(*_bits(counts[d]))
            if d:
                np.add.at(counts[d - 1], up[d], counts[d])
                np.add.at(below[d - 1], up[d], np.logaddexp(own[d], below[d]) - math.log(2))
        # Downwards: the mixture so far, and the weight left for deeper estimates.
        mixed, left = np.zeros((1, 255)), np.ones((1, 255))
        rows, tables, shared = 0, [_log_bytes(np.full((1, 255), 0.5))], [np.zeros(1, np.int64)]
        rows = 1
        for d in range(depth):
            if d:
                mixed, left = mixed[up[d]], left[up[d]]
            n0, n1 = _bits(counts[d])
            beta = 1 / (1 + np.exp(np.clip(below[d] - own[d], -700, 700)))
            mixed = mixed + left * beta * (n1 + 0.5) / (n0 + n1 + 1)
            left = left * (1 - beta)
            tables.append(_log_bytes(mixed + left * 0.5))
            shared.append(rows + np.arange(len(keys[d])))
            rows += len(keys[d])
        for lo in range(0, total, BLOCK):
            hi = min(lo + BLOCK, total)
            n0, n1 = _bits(leaves(lo, hi))
            kt = (n1 + 0.5) / (n0 + n1 + 1)
            tables.append(_log_bytes(mixed[up[depth][lo:hi]] + left[up[depth][lo:hi]] * kt if depth else kt))
        self.table = np.concatenate(tables)
        row = np.zeros(1, np.int64)
        for d in range(depth + 1):
            if d:
                row = np.repeat(row, sizes[d - 1])
            row[keys[d]] = shared[d + 1] if d < depth else rows + np.arange(total)
        self.row = row.astype(np.int32)

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The log10 probability of each text."""
        ctx, sym, at = contexts(buf, offs, self.sizes)
        s = np.concatenate([[0.0], np.cumsum(self.table[self.row[ctx], sym], dtype=np.float64)])
        return s[at[1:]] - s[at[:-1]]


def train(df: DataFrame, text: str = "text", sizes: tuple[int, ...] = SIZES) -> Model:
    """Counts on the cluster; the driver gets a row for each byte seen in each context, of which the classes allow 2**26."""
    got = gram_counts(df, text, sizes).toArrow()
    return Model(got.column("code").to_numpy(), got.column("n").to_numpy(), sizes)


def _padded(buf: np.ndarray, offs: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts, each after ``depth`` blanks and before its end; where each text's first byte is, and one beyond."""
    n, size = len(offs) - 1, np.diff(offs)
    x = np.full(len(buf) + n * (depth + 1), 32, np.uint8)
    x[np.arange(len(buf)) + np.repeat((depth + 1) * np.arange(n) + depth, size)] = buf
    ends = np.cumsum(size + depth + 1)
    x[ends - 1] = END
    return x, np.concatenate([[depth], ends + depth])


def _windows(x: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place of the first, grams) for all places from ``depth`` on; those that begin in the blanks are there too."""
    for lo in range(depth, len(x), WINDOW):
        hi = min(lo + WINDOW, len(x))
        k = np.zeros(hi - lo, np.int64)
        for d in range(1, depth + 1):
            k <<= 8
            k |= x[lo - d : hi - d]
        yield lo, k << 8 | x[lo:hi]


def _texts(t: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pa.RecordBatch]]:
    for b in t.to_batches():
        for lo, hi, buf, offs in pieces(b.column(1)):
            yield lo, hi, buf, offs, b


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts; as few copies at a time as can be."""
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys)
    keys = keys[order]
    n = np.concatenate([n for _, n in parts])[order]
    del order
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(keys) else n


def _gathered(runs: Iterator[tuple], merge: Callable[[list[tuple]], tuple]) -> Iterator[tuple]:
    """Runs with sorted keys in front as one, in SHARES ranges of keys one after the other: merging copies only one of them at a time."""
    bounds, held, waiting = None, [], [0] * SHARES
    for run in runs:
        keys = run[0]
        if bounds is None and len(keys):
            bounds, held = keys[np.arange(1, SHARES) * len(keys) // SHARES], [[] for _ in range(SHARES)]
        cut = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)] if len(keys) else []
        for i, (lo, hi) in enumerate(zip(cut, cut[1:])):
            if lo == hi:
                continue
            held[i].append(tuple(x[lo:hi].copy() for x in run))
            waiting[i] += hi - lo
            if waiting[i] > 2 * WINDOW // SHARES:
                held[i], waiting[i] = [merge(held[i])], 0
    while held:
        if parts := held.pop(0):
            yield merge(parts)


def asked(t: pa.Table, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The grams of a chunk's texts, in order, and how often each is in training texts."""

    def runs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for lo, hi, buf, offs, b in _texts(t):
            x, first = _padded(buf, offs, depth)
            mark = np.zeros(len(x) + depth, np.int8)  # 2: no place to score, 1: held out
            out = np.repeat(b.column(2).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.int8), np.diff(first))
            mark[depth:] = out
            for d in range(1, depth + 1):
                mark[first - d] = 2
            for at, k in _windows(x, depth):
                m = mark[at : at + len(k)]
                v, n = np.unique((k << 1 | m)[m < 2], return_counts=True)
                yield v >> 1, np.where(v & 1, 0, n)

    return _gathered(runs(), _merged)


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys by a sort; numpy's own function goes by a hash table here, and takes many times as long."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def grams(t: pa.Table, depth: int) -> np.ndarray:
    """The grams of a chunk's texts, in order."""

    def runs() -> Iterator[tuple[np.ndarray]]:
        for lo, hi, buf, offs, _ in _texts(t):
            x, first = _padded(buf, offs, depth)
            real = np.ones(len(x) + depth, bool)
            for d in range(1, depth + 1):
                real[first - d] = False
            for at, k in _windows(x, depth):
                yield (_distinct(k[real[at : at + len(k)]]),)

    return np.concatenate([np.zeros(0, np.int64), *(k for k, in _gathered(runs(), lambda parts: (_distinct(np.concatenate([k for k, in parts])),)))])


_ZSTD = pa.Codec("zstd", 1)


def _press(x: np.ndarray) -> bytes:
    """Numbers by byte planes, pressed."""
    return _ZSTD.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T), asbytes=True)


def _unpress(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    got = np.frombuffer(_ZSTD.decompress(data, n * size, asbytes=True), np.uint8)
    return np.ascontiguousarray(got.reshape(size, n).T).view(kind).reshape(n)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, rows): record batches of about PACK bytes, pressed; numbered by task."""
    chunk, held, size = TaskContext.get().partitionId() << 32, [], 0

    def done() -> pa.RecordBatch:
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            for b in held:
                w.write_batch(b)
        return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([sink.getvalue()], pa.binary())], names=["chunk", "rows"])

    for b in batches:
        for lo, hi, _, offs in pieces(b.column(1)):
            if held and size + int(offs[-1]) > PACK:
                yield done()
                chunk, held, size = chunk + 1, [], 0
            held.append(b.slice(lo, hi - lo))
            size += int(offs[-1])
    if held:
        yield done()


def _unpack(data: bytes) -> pa.Table:
    with pa.ipc.open_stream(data) as r:
        return r.read_all()


def _ask(chunks: DataFrame, depth: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, data in zip(b.column(0).to_pylist(), b.column(1)):
                for k, c in ((k[lo : lo + WINDOW], n[lo : lo + WINDOW]) for k, n in asked(_unpack(data.as_py()), depth) for lo in range(0, len(k), WINDOW)):
                    yield pa.RecordBatch.from_pydict({"chunk": [chunk], "first": [int(k[0])], "n": [len(k)], "keys": [_press(np.diff(k, prepend=k[0]))], "counts": [_press(c)], "sample": [k[::STEP].tolist()]})

    return chunks.mapInArrow(run, "chunk long, first long, n long, keys binary, counts binary, sample array<long>")


def _deal(asks: DataFrame, bounds: np.ndarray) -> DataFrame:
    """(part, chunk, first, n, keys, counts): what is asked, cut at the bounds of the ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                k = _unpress(r["keys"], r["n"], np.int64).cumsum() + r["first"]
                c = _unpress(r["counts"], r["n"], np.int64)
                cut = np.concatenate([np.searchsorted(k, bounds[:-1]), [len(k)]])
                rows = [(p, r["chunk"], int(k[i]), int(j - i), _press(np.diff(k[i:j], prepend=k[i])), _press(c[i:j])) for p, (i, j) in enumerate(zip(cut[:-1], cut[1:])) if i < j]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*rows)], schema=pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))

    return asks.select("chunk", "first", "n", "keys", "counts").mapInArrow(run, "part long, chunk long, first long, n long, keys binary, counts binary")


class Range:
    """The nodes of the tree that have grams in [lo, hi), bounds at whole contexts."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, lo: int, hi: int, depth: int):
        self.depth = depth
        self.grams, self.n, self.up = [keys], [n.astype(np.float64)], []
        for _ in range(depth):
            k, at = np.unique(self.grams[0] >> 16 << 8 | self.grams[0] & 255, return_inverse=True)
            self.grams.insert(0, k)
            self.n.insert(0, np.bincount(at, self.n[0], len(k)))
            self.up.insert(0, at)
        self.up.insert(0, None)
        self.cut = []  # grams of contexts that reach beyond the range
        for d, g in enumerate(self.grams):
            s = 8 * (depth - d + 1)
            start = g >> 8 << s
            self.cut.append((start < lo) | (start + (1 << s) > hi))

    def _bit(self, i: int) -> tuple[list, list, list, list, list]:
        """For each depth, of the nodes with i bits: each gram's node, each node's first gram, zeros, ones and the log probability below."""
        node, first, n0, n1 = [], [], [], []
        for g, n in zip(self.grams, self.n):
            pre = g >> (8 - i)
            new = np.ones(len(g), bool)
            new[1:] = pre[1:] != pre[:-1]
            first.append(np.flatnonzero(new))
            node.append(np.cumsum(new) - 1)
            one = (g >> (7 - i) & 1).astype(bool)
            both = np.add.reduceat(n, first[-1])
            n1.append(np.add.reduceat(np.where(one, n, 0.0), first[-1]))
            n0.append(both - n1[-1])
        below = [np.zeros(len(f)) for f in first]
        for d in range(self.depth, 0, -1):
            own = _log_kt(n0[d], n1[d])
            whole = own if d == self.depth else np.logaddexp(own, below[d]) - math.log(2)
            f = first[d]
            below[d - 1] = np.bincount(node[d - 1][self.up[d][f]], np.where(self.cut[d][f], 0.0, whole), len(first[d - 1]))
        return node, first, n0, n1, below

    def _code(self, d: int, f: np.ndarray, i: int) -> np.ndarray:
        g = self.grams[d][f]
        return g >> 8 << 8 | 1 << i | (g & 255) >> (8 - i)

    def edges(self) -> pa.RecordBatch:
        """(depth, code, n0, n1, below) of the nodes of cut contexts, as far as this range has them."""
        cols = [[] for _ in range(5)]
        for i in range(8):
            _, first, n0, n1, below = self._bit(i)
            for d in range(self.depth):
                at = self.cut[d][first[d]]
                for c, v in zip(cols, (np.full(at.sum(), d), self._code(d, first[d][at], i), n0[d][at], n1[d][at], below[d][at])):
                    c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["depth", "code", "n0", "n1", "below"])

    def logs(self, spine: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """The log10 probability of the byte of each gram; ``spine`` has the mixture and the weight left for the nodes of cut contexts."""
        out = np.zeros(len(self.grams[-1]))
        for i in range(8):
            node, first, n0, n1, below = self._bit(i)
            mixed, left = np.zeros(len(first[0])), np.ones(len(first[0]))
            for d in range(self.depth + 1):
                f = first[d]
                if d:
                    at = node[d - 1][self.up[d][f]]
                    mixed, left = mixed[at], left[at]
                kt = (n1[d] + 0.5) / (n0[d] + n1[d] + 1)
                if d == self.depth:
                    p = mixed + left * kt
                    break
                mixed, left = _step(mixed, left, kt, n0[d], n1[d], below[d])
                at = np.flatnonzero(self.cut[d][f])
                code, m, r = spine[d]
                k = np.searchsorted(code, self._code(d, f[at], i))
                mixed[at], left[at] = m[k], r[k]
            one = (self.grams[-1] >> (7 - i) & 1).astype(bool)
            p = p[node[-1]]
            out += np.log10(np.where(one, p, 1 - p))
        return out.astype(np.float32)


def _step(mixed: np.ndarray, left: np.ndarray, kt: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    beta = 1 / (1 + np.exp(np.clip(below - _log_kt(n0, n1), -700, 700)))
    return mixed + left * beta * kt, left * (1 - beta)


def _spine(edges: pa.Table, depth: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each depth (code, mixture so far, weight left) of the nodes of cut contexts, from their sums over the ranges."""
    d_, *cols = (edges.column(i).to_numpy() for i in range(5))
    by = []
    for d in range(depth):
        at = np.flatnonzero(d_ == d)
        at = at[np.argsort(cols[0][at])]
        by.append([c[at].copy() for c in cols])
    up = [None] * depth
    for d in range(depth - 1, 0, -1):
        code, n0, n1, below = by[d]
        up[d] = np.searchsorted(by[d - 1][0], code >> 16 << 8 | code & 255)
        np.add.at(by[d - 1][3], up[d], np.logaddexp(_log_kt(n0, n1), below) - math.log(2))
    out = []
    for d, (code, n0, n1, below) in enumerate(by):
        mixed, left = (out[-1][1][up[d]], out[-1][2][up[d]]) if d else (np.zeros(len(code)), np.ones(len(code)))
        out.append((code, *_step(mixed, left, (n1 + 0.5) / (n0 + n1 + 1), n0, n1, below)))
    return out


def answers(asks: DataFrame, depth: int = DEPTH, size: int = RANGE) -> DataFrame:
    """(chunk, part, n, logs): for each chunk the log10 probabilities of the grams it asks, in order of part."""
    top = 1 << (8 * depth + 8)
    sample = np.sort(asks.select(F.explode("sample").alias("k")).toArrow().column("k").to_numpy())  # one gram of STEP
    total = asks.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // size))
    inner = np.unique(sample[np.arange(1, parts) * len(sample) // parts] >> 8 << 8) if len(sample) else np.zeros(0, np.int64)
    bounds = np.concatenate([[0], inner[inner > 0], [top]])
    dealt = _deal(asks, bounds)

    def part(t: pa.Table) -> tuple[Range, list[np.ndarray], np.ndarray]:
        rows = t.to_pylist()
        keys = [_unpress(r["keys"], r["n"], np.int64).cumsum() + r["first"] for r in rows]
        k, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, np.concatenate([_unpress(r["counts"], r["n"], np.int64) for r in rows]), len(k))
        p = rows[0]["part"]
        return Range(k, n, int(bounds[p]), int(bounds[p + 1]), depth), at, [(r["chunk"], r["n"]) for r in rows]

    def edges(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches([part(t)[0].edges()])

    cut = dealt.groupBy("part").applyInArrow(edges, "depth long, code long, n0 double, n1 double, below double")
    shared = asks.sparkSession.sparkContext.broadcast(_spine(cut.groupBy("depth", "code").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "below"))).toArrow(), depth))

    def run(t: pa.Table) -> pa.Table:
        r, at, rows = part(t)
        logs, p, out, lo = r.logs(shared.value), t.column("part")[0].as_py(), [], 0
        for chunk, n in rows:
            out.append((chunk, lo, n, _press(logs[at[lo : lo + n]])))
            lo += n
        return pa.table({"chunk": [o[0] for o in out], "part": [p] * len(out), "n": [o[2] for o in out], "first": [int(r.grams[-1][at[o[1]]]) for o in out], "logs": pa.array([o[3] for o in out], pa.binary())})

    return dealt.groupBy("part").applyInArrow(run, "chunk long, part long, n long, first long, logs binary")


def _sums(t: pa.Table, keys: np.ndarray, logs: np.ndarray, depth: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pa.RecordBatch, np.ndarray]]:
    """The pieces of a chunk with the log10 probability of each text."""
    for lo, hi, buf, offs, b in _texts(t):
        x, first = _padded(buf, offs, depth)
        score = np.zeros(hi - lo)
        text = np.repeat(np.arange(hi - lo), np.diff(first))
        real = np.ones(len(x) + depth, bool)
        for d in range(1, depth + 1):
            real[first - d] = False
        for at, k in _windows(x, depth):
            ok = real[at : at + len(k)]
            u, code = np.unique(k[ok], return_inverse=True)
            score += np.bincount(text[at - depth : at - depth + len(k)][ok], logs[np.searchsorted(keys, u)][code], hi - lo)
        yield lo, hi, buf, offs, b, score


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(h, n): the count of each lower-cased word, by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, buf, offs in pieces(b.column(0), 1 << 21):
                code, keys = pd.factorize(Words(buf, offs).hashes())
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.bincount(code, minlength=len(keys)).astype(np.int64))], names=["h", "n"])

    return df.select(text).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _hot(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Hashes and counts of the commonest words, at most ``most``, all with a count above those left out; number and sum of all."""
    octave = F.floor(F.log2("n") * 16).cast("int")
    hist = sorted(((r[0], r[1], r[2]) for r in counts.groupBy(octave.alias("o")).agg(F.count("*"), F.sum("n")).collect()), reverse=True)  # at most 16 * 63 rows
    room, least = most, None
    for o, k, _ in hist:
        if k > room:
            break
        room, least = room - k, o
    distinct, total = sum(k for _, k, _ in hist), sum(s for _, _, s in hist)
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), distinct, total
    got = counts.where(octave >= least).toArrow()
    h, n = got.column("h").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order], distinct, total


def scores(df: DataFrame, key: str = "doc_id", text: str = "text", held: str = "pmod(crc32(coalesce(cast({key} as string), '')), 5) = 1", depth: int = DEPTH, hot: int = HOT, size: int = RANGE) -> DataFrame:
    """Trains on the rows for which ``held`` is false and scores all: (key, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte)."""
    rows = df.select(F.col(key), F.col(text).alias("_text"), F.coalesce(F.expr(held.format(key=f"`{key}`")), F.lit(False)).alias("held_out"))
    training = rows.where("not held_out")
    chunks = Stored(rows.mapInArrow(_pack, "chunk long, rows binary"), "chunks").df
    replies = answers(Stored(_ask(chunks, depth), "asked").df, depth, size)
    counts = Stored(word_counts(training, "_text"), "words").df
    h, c, distinct, total = _hot(counts, hot)
    ends = training.count()
    distinct, total = distinct + (ends > 0), total + ends
    under = math.log10(total + 0.5 * (distinct + 1))
    shared = df.sparkSession.sparkContext.broadcast((h, c))

    kind = df.schema[key].dataType.simpleString()
    names = [key, "held_out", "n_tokens", "known", "base", "score", "n_bytes", "tail"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        h, c = shared.value
        worth = np.log10(c + 0.5) - under
        t = _unpack(left.column("rows")[0].as_py())
        logs = np.concatenate([_unpress(r["logs"], r["n"], np.float32) for r in sorted(right.to_pylist(), key=lambda r: r["first"])])
        out = []
        for lo, hi, buf, offs, b, score in _sums(t, grams(t, depth), logs, depth):
            w = Words(buf, offs)
            n = hi - lo
            doc = np.repeat(np.arange(n), w.count)
            code, keys = pd.factorize(w.hashes().view(np.int64))
            at = np.minimum(np.searchsorted(h, keys), max(len(h) - 1, 0))
            hit = h[at] == keys if len(h) else np.zeros(len(keys), bool)
            value = np.where(hit, worth[at], 0.0) if len(h) else np.zeros(len(keys))
            base = np.bincount(doc, value[code], n) + (math.log10(ends + 0.5) - under)
            known = np.bincount(doc, hit[code], n).astype(np.int64) + (ends > 0)
            miss = np.flatnonzero(~hit[code])
            tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[miss], np.arange(n + 1)).astype(np.int32)), pa.array(keys[code[miss]]))
            out.append(pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), b.column(2).slice(lo, n), pa.array(w.count.astype(np.int64) + 1), pa.array(known), pa.array(base), pa.array(score), pa.array(np.diff(offs)), tail], names=names))
        return pa.Table.from_batches(out)

    heads = chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, f"`{key}` {kind}, held_out boolean, n_tokens long, known long, base double, score double, n_bytes long, tail array<long>")
    heads = Stored(heads.withColumn("_row", F.monotonically_increasing_id()), "heads").df
    rare = heads.select("_row", F.explode("tail").alias("h")).groupBy("_row", "h").agg(F.count("*").alias("k")).join(counts, "h", "left")
    rare = rare.groupBy("_row").agg(F.sum(F.col("k") * (F.log10(F.coalesce("n", F.lit(0)) + 0.5) - F.lit(under))).alias("rare"), F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("rare_known"))
    out = heads.drop("tail").join(rare, "_row", "left")
    return out.select(
        key, "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare", F.lit(0.0))).alias("base_score"), "score", "n_bytes", (F.col("score") * F.lit(-math.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
