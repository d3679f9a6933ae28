"""Matroska media columns.

``encode`` lays a byte payload out as 8-bit PCM frames in clusters of laced blocks with cues; ``parse`` reads any
EBML file back into packets, with timestamps, tracks and byte ranges, whatever lacing, unknown sizes or void
elements it uses. ``encode_column`` and ``packet_table`` apply the two to DataFrames, one row at a time.

Defined cases: a null text is an empty one and gives 64 zero bytes; an empty or broken media value gives no
packets and a non-null ``error``; equal values give equal rows; other columns pass unchanged.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Element ids, fixed by the format.
EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SCALE, DURATION, NUMBER, UID, TYPE, CODEC, LACING = 0x2AD7B1, 0x4489, 0xD7, 0x73C5, 0x83, 0x86, 0x9C
RATE, CHANNELS, DEPTH, DEFAULT_DURATION = 0xB5, 0x9F, 0x6264, 0x23E383
MASTERS = {SEGMENT, TRACKS, TRACK, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS, INFO, EBML}

SAMPLE_RATE = 8000
FRAME = 512
LACE = 8
CLUSTER_BLOCKS = 32
NO_LACE, XIPH, FIXED, EBML_LACE = 0, 1, 2, 3


def _id(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8, "big")


def vint(n: int, width: int = 0) -> bytes:
    """A variable-length size; the all-ones value of each width stays free for 'unknown'."""
    while not width or n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(i: int, data: bytes) -> bytes:
    return _id(i) + vint(len(data)) + data


def uint(i: int, n: int) -> bytes:
    return element(i, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _float(i: int, x: float) -> bytes:
    return element(i, struct.pack(">d", x))


_HEAD = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(0x4282, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
_TRACKS = element(
    TRACKS,
    element(
        TRACK,
        uint(NUMBER, 1) + uint(UID, 1) + uint(TYPE, 2) + uint(LACING, 1) + element(CODEC, b"A_PCM/INT/LIT") + uint(DEFAULT_DURATION, FRAME * 10**9 // SAMPLE_RATE)
        + element(AUDIO, _float(RATE, SAMPLE_RATE) + uint(CHANNELS, 1) + uint(DEPTH, 8)),
    ),
)


def lace(frames: list[bytes], mode: int) -> bytes:
    """The lace header and the frames of one block."""
    if mode == NO_LACE:
        return frames[0]
    out = [bytes([len(frames) - 1])]
    sizes = [len(f) for f in frames]
    if mode == XIPH:
        out += [b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1]]
    elif mode == EBML_LACE:
        out.append(vint(sizes[0]))
        for a, b in zip(sizes, sizes[1:-1]):
            d, width = b - a, 1
            while not -(1 << 7 * width - 1) < d < 1 << 7 * width - 1:
                width += 1
            out.append(vint(d + (1 << 7 * width - 1) - 1, width))
    return b"".join(out + frames)


def encode(payload: bytes) -> bytes:
    """The payload as 8-bit samples at 8 kHz, in frames of 512 bytes laced by eight."""
    info = element(INFO, uint(SCALE, 10**6) + _float(DURATION, len(payload) * 1000 / SAMPLE_RATE) + element(0x4D80, b"strandline") + element(0x5741, b"strandline"))
    parts, at, cues = [info, _TRACKS], len(info) + len(_TRACKS), []
    step = FRAME * LACE
    for base in range(0, len(payload), step * CLUSTER_BLOCKS):
        t0 = base * 1000 // SAMPLE_RATE
        body = [uint(TIMESTAMP, t0)]
        for lo in range(base, min(base + step * CLUSTER_BLOCKS, len(payload)), step):
            frames = [payload[i : min(i + FRAME, lo + step)] for i in range(lo, min(lo + step, len(payload)), FRAME)]
            mode = NO_LACE if len(frames) == 1 else FIXED if len(frames[-1]) == FRAME else EBML_LACE
            body.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", lo * 1000 // SAMPLE_RATE - t0, 0x80 | mode << 1) + lace(frames, mode)))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, uint(CUE_TIME, t0) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(parts))


def _read_id(b: bytes, at: int) -> tuple[int, int]:
    width = 9 - b[at].bit_length()
    if width > 4:
        raise ValueError(f"element id at {at}")
    return int.from_bytes(b[at : at + width], "big"), at + width


def _read_size(b: bytes, at: int) -> tuple[int, int]:
    """(size, end); -1: unknown."""
    width = 9 - b[at].bit_length()
    if width > 8 or at + width > len(b):
        raise ValueError(f"size at {at}")
    n = int.from_bytes(b[at : at + width], "big") ^ 1 << 7 * width
    return (-1 if n == (1 << 7 * width) - 1 else n), at + width


def walk(b: bytes, at: int, end: int, inside: int = 0) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of each element's data. One of unknown size ends where an element of its own level or above begins."""
    while at < end:
        i, p = _read_id(b, at)
        n, p = _read_size(b, p)
        if n < 0:
            if i not in (SEGMENT, CLUSTER):
                raise ValueError(f"element {i:x} of unknown size")
            q = p
            while i == CLUSTER and q < end:
                j, r = _read_id(b, q)
                if j in (CLUSTER, CUES, TRACKS, INFO, SEGMENT, EBML):
                    break
                n, r = _read_size(b, r)
                q = r + n
            stop = q if i == CLUSTER else end
        else:
            stop = p + n
        if stop > end:
            raise ValueError(f"element {i:x} at {at} ends after its parent")
        yield i, p, stop
        at = stop


def _uint(b: bytes, lo: int, hi: int) -> int:
    return int.from_bytes(b[lo:hi], "big")


def _real(b: bytes, lo: int, hi: int) -> float:
    return struct.unpack(">d" if hi - lo == 8 else ">f", b[lo:hi])[0] if hi > lo else 0.0


def unlace(b: bytes, lo: int, hi: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """(track, relative time, flags, [(offset, size)]) of a block."""
    track, p = _read_size(b, lo)
    rel, flags = struct.unpack_from(">hB", b, p)
    p += 3
    mode = flags >> 1 & 3
    if mode == NO_LACE:
        return track, rel, flags, [(p, hi - p)]
    n = b[p] + 1
    p += 1
    sizes: list[int] = []
    if mode == FIXED:
        if (hi - p) % n:
            raise ValueError("fixed lace of unequal frames")
        sizes = [(hi - p) // n] * n
    else:
        for k in range(n - 1):
            if mode == XIPH:
                size = 0
                while b[p] == 255:
                    size, p = size + 255, p + 1
                size, p = size + b[p], p + 1
            elif k:
                width = 9 - b[p].bit_length()
                d, p = _read_size(b, p) if b[p] != 0xFF else (127, p + 1)
                d = (1 << 7 * width) - 1 if d < 0 else d
                size = sizes[-1] + d - ((1 << 7 * width - 1) - 1)
            else:
                size, p = _read_size(b, p)
            sizes.append(size)
        sizes.append(hi - p - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lace sizes exceed the block")
    out = []
    for s in sizes:
        out.append((p, s))
        p += s
    return track, rel, flags, out


def parse(b: bytes) -> dict:
    """Tracks, packets and cues of a file. A packet is (track, time in ns, offset, size, key, cluster, block, lace index, lace mode)."""
    out: dict = {"tracks": {}, "packets": [], "cues": [], "clusters": 0, "blocks": 0, "scale": 10**6, "duration": 0.0}
    blocks: list[tuple[int, int, int, int, bool]] = []
    starts: list[int] = []
    for i, lo, hi in walk(b, 0, len(b)):
        if i != SEGMENT:
            continue
        base = lo
        for j, p, q in walk(b, lo, hi):
            if j == INFO:
                for k, x, y in walk(b, p, q):
                    if k == SCALE:
                        out["scale"] = _uint(b, x, y)
                    elif k == DURATION:
                        out["duration"] = _real(b, x, y)
            elif j == TRACKS:
                for k, x, y in walk(b, p, q):
                    if k == TRACK:
                        t = {}
                        for m, u, v in walk(b, x, y):
                            if m == AUDIO:
                                for a, c, d in walk(b, u, v):
                                    t |= {"rate": _real(b, c, d)} if a == RATE else {"channels": _uint(b, c, d)} if a == CHANNELS else {"depth": _uint(b, c, d)} if a == DEPTH else {}
                            else:
                                t |= {"number": _uint(b, u, v)} if m == NUMBER else {"codec": b[u:v].decode("ascii", "replace")} if m == CODEC else {"type": _uint(b, u, v)} if m == TYPE else {"frame_ns": _uint(b, u, v)} if m == DEFAULT_DURATION else {}
                        out["tracks"][t.get("number", 0)] = t
            elif j == CLUSTER:
                t0 = 0
                starts.append(p)
                for k, x, y in walk(b, p, q):
                    if k == TIMESTAMP:
                        t0 = _uint(b, x, y)
                    elif k == SIMPLE_BLOCK:
                        blocks.append((x, y, t0, out["clusters"], True))
                    elif k == BLOCK_GROUP:
                        blocks += [(u, v, t0, out["clusters"], False) for m, u, v in walk(b, x, y) if m == BLOCK]
                out["clusters"] += 1
            elif j == CUES:
                for k, x, y in walk(b, p, q):
                    if k == CUE_POINT:
                        time, track, pos = 0, 0, 0
                        for m, u, v in walk(b, x, y):
                            if m == CUE_TIME:
                                time = _uint(b, u, v)
                            elif m == CUE_POSITIONS:
                                for a, c, d in walk(b, u, v):
                                    track, pos = (_uint(b, c, d), pos) if a == CUE_TRACK else (track, _uint(b, c, d)) if a == CUE_CLUSTER else (track, pos)
                        out["cues"].append((track, time * out["scale"], base + pos))
    for n, (lo, hi, t0, cluster, simple) in enumerate(blocks):
        track, rel, flags, frames = unlace(b, lo, hi)
        ns = out["tracks"].get(track, {}).get("frame_ns", 0)
        for k, (at, size) in enumerate(frames):
            out["packets"].append((track, (t0 + rel) * out["scale"] + k * ns, at, size, bool(flags & 0x80) if simple else False, cluster, n, k, flags >> 1 & 3))
    out["blocks"] = len(blocks)
    return out


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % 64 or (0 if data else 64))


def features(m: dict, samples: bytes) -> str:
    """What the packets and their samples say, as text."""
    x = np.frombuffer(samples, np.uint8)
    d = x.astype(np.int64) - 128
    crossings = int(np.count_nonzero((d[1:] >= 0) != (d[:-1] >= 0)))
    modes = [p[8] for p in m["packets"] if p[7] == 0]
    t = next(iter(m["tracks"].values()), {})
    return (
        f"codec={t.get('codec')};tracks={len(m['tracks'])};clusters={m['clusters']};blocks={m['blocks']};packets={len(m['packets'])};cues={len(m['cues'])};"
        f"laces={modes.count(0)}/{modes.count(1)}/{modes.count(2)}/{modes.count(3)};last_ns={max((p[1] for p in m['packets']), default=0)};"
        f"sum={int(x.sum(dtype=np.int64))};peak={int(x.max()) if len(x) else 0};energy={int((d * d).sum())};crossings={crossings}"
    )


_PACKET = T.StructType(
    [T.StructField(n, t) for n, t in (("mkv_error", T.StringType()), ("track", T.LongType()), ("timestamp_ns", T.LongType()), ("offset", T.LongType()), ("size", T.LongType()), ("key_frame", T.BooleanType()), ("cluster", T.LongType()), ("block", T.LongType()), ("lace_index", T.LongType()), ("lacing", T.StringType()), ("cued", T.BooleanType()))]
)
_MODES = ("none", "xiph", "fixed", "ebml")


def encode_column(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """Adds the media file of each row's text as a binary column."""
    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 256):
                b = big.slice(lo, 256)
                media = [encode(pad((s or "").encode())) for s in b.column(text).to_pylist()]
                cols = [b.column(n) for n in b.schema.names if n != out] + [pa.array(media, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return df.mapInArrow(run, schema)


def packet_table(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """One row per packet of each row's media, under ``key``; a file that can't be read gives one row with ``mkv_error``."""
    schema = T.StructType([df.schema[key], *_PACKET.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 64):
                b = big.slice(lo, 64)
                keys, rows = [], []
                for k, m in enumerate(b.column(media).to_pylist()):
                    try:
                        if not m:
                            raise ValueError("no media")
                        x = parse(m)
                        first = {(c[0], c[1]) for c in x["cues"]}
                        new = [(None, *p[:8], _MODES[p[8]], p[7] == 0 and (p[0], p[1]) in first) for p in x["packets"]] or [("no packets", *[None] * 10)]
                    except (ValueError, IndexError, struct.error) as e:
                        new = [(str(e), *[None] * 10)]
                    rows += new
                    keys += [k] * len(new)
                cols = [b.column(key).take(pa.array(keys, pa.int64()))] + [pa.array([r[i] for r in rows], T_ARROW[f.dataType]) for i, f in enumerate(_PACKET.fields)]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return df.mapInArrow(run, schema)


T_ARROW = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.BooleanType(): pa.bool_()}

_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long"


def digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes each text as Matroska, reads its packets back and sums them up, in one pass over the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 512):
                b = big.slice(lo, 512)
                out: list[list] = [[] for _ in range(8)]
                for s in b.column(1).to_pylist():
                    data = (s or "").encode()
                    media = encode(pad(data))
                    m = parse(media)
                    back = b"".join([media[p[2] : p[2] + p[3]] for p in m["packets"]])
                    for c, v in zip(out, (len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(m, back), len(m["packets"]))):
                        c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64())] + [pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_packets"])

    return df.select(key, text).mapInArrow(run, _DIGEST)
