"""WARC archives with a two-level capture index.

Writing: each task writes one archive, a gzip member per record, to the shared folder. Among records with equal
payloads of ``LEAST_DEDUP`` bytes or more one with the smallest id is the response and all others are revisits of it.
Payloads stay where they are read: digests alone are counted, and a bitmap of fixed size marks those that occur twice.
Rows it doesn't mark are written by the tasks that read them. Of the others, whose revisits need no payload, each task
sends at most one payload per digest, so a payload with any number of copies is in no one's way. A digest marked by
chance goes the second way, to the same result.

Index: keys are URLs with their host reversed, then the id. Lines are sorted over all tasks by range partitioning, cut
into blocks of ``BLOCK_LINES``, and each block is one compressed member of the task's index shard. A sparse directory
keeps the first key, the place and the size of each block; a list of shards, one line per task, keeps their first keys.

Lookup: shards are found by binary search in the shard list, which is as long as the number of partitions; each
shard's keys meet in one task, which binary-searches the shard's directory, reads only the blocks it needs, and
searches them. What it finds is dealt by archive, and records are read by their byte ranges, in order of place.

Files are named by attempt and listed by what the attempts that counted returned, so a task that runs twice leaves
only a file that nothing points to. Paths may be of any file system that pyarrow knows.

Defined cases: a null payload is empty, and so is a null URL; ids may repeat and be null, their records are told apart
by place; the response of a payload is the first by id (nulls last), then URL, and of equal rows one; without any id
its revisits refer to none; smaller payloads are all responses; a key that is not there gives no row; an empty table gives no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, drop, shared_dir

LEAST_DEDUP = 100
#: Bits of the broadcast bitmap of digests that occur twice.
MARKS = 1 << 26
BLOCK_LINES = 1000
SEP = "\x1f"
#: Bytes that two records may lie apart to be read at once.
GAP = 1 << 16
READ = 1 << 22


_CONTROLS = {i: f"%{i:02X}" for i in range(32)}


def surt(url: str | None) -> str:
    """The URL with its host reversed, without scheme, www, default port and fragment: 'com,example)/path?query'.

    No character below the blank stays, so that keys sort as their lines do.
    """
    return _surt(url).translate(_CONTROLS)


def _surt(url: str | None) -> str:
    try:
        u = urlsplit((url or "").strip())
        host, port = (u.hostname or "").removeprefix("www."), u.port
    except ValueError:
        return (url or "").lower()
    tail = f":{port}" if port and (u.scheme, port) not in (("http", 80), ("https", 443)) else ""
    return f"{','.join(reversed(host.split('.')))}{tail}){u.path or '/'}{'?' + u.query if u.query else ''}" if host else (url or "").lower()


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None = None, revisit: bool = False, size: int | None = None) -> bytes:
    """One WARC record. A revisit keeps the HTTP header, whose Content-Length is that of the full payload (``size``), without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if size is None else size}\r\n\r\n".encode()
    block = http + (b"" if revisit else payload)
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {(url or '').translate({10: '%0A', 13: '%0D'})}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers is None else refers}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Header fields of a record with its HTTP payload; a broken block digest is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    f = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(f["content-length"])]
    if f["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"{f['warc-record-id']}: broken block")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next((int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: ")), len(payload))

    def number(name: str) -> int | None:
        text = f.get(name, "<urn:page:>")[len("<urn:page:") : -1]
        return int(text) if text else None

    return {"page": number("warc-record-id"), "type": f["warc-type"], "url": f["warc-target-uri"], "digest": f["warc-payload-digest"].removeprefix("sha256:"), "refers": number("warc-refers-to"), "payload": payload, "payload_bytes": size}


def _mark(digest: Column) -> Column:
    return F.xxhash64(digest).bitwiseAND(F.lit(MARKS - 1))


def write_archives(df: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", level: int = 1) -> DataFrame:
    """Writes every row's record and returns the capture lines (surt, id, file, offset, length, kind)."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("body"))
    rows = rows.select("id", "url", F.sha2("body", 256).alias("digest"), F.length("body").cast("long").alias("n"), "body")
    keys = Stored(rows.where(F.col("n") >= LEAST_DEDUP).select("id", "url", "digest", "n"), "digests")
    twice = keys.df.groupBy("digest").agg(F.count("*").alias("copies")).where("copies > 1").select(_mark(F.col("digest")).alias("mark"))
    bits = np.zeros(MARKS // 8, np.uint8)
    for r in twice.groupBy(F.bitmap_bucket_number(F.col("mark") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("mark") + 1)).alias("bits")).collect():  # at most 2**11 rows of 4 KB
        bits[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    shared = df.sparkSession.sparkContext.broadcast(bits)

    def marked(frame: DataFrame, want: bool) -> DataFrame:
        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = shared.value
            for b in batches:
                at = b.column(b.num_columns - 1).to_numpy()
                there = (bits[at >> 3] >> (at & 7) & 1).astype(bool) & (b.column(3).to_numpy() >= LEAST_DEDUP)
                yield b.select(range(b.num_columns - 1)).filter(pa.array(there == want))

        return frame.withColumn("mark", _mark(F.col("digest"))).mapInArrow(pick, frame.schema)

    place = F.struct(F.col("id").isNull().alias("none"), "id", "url")
    least = Stored(marked(keys.df, True).groupBy("digest").agg(F.min(place).alias("r")), "least")
    alone = marked(rows, False).select("id", "url", "body", "digest", "n", F.lit(False).alias("revisit"), F.lit(None).cast("long").alias("refers"))
    first = marked(rows, True).groupBy("digest").agg(F.min(place).alias("r"), F.first("body").alias("body"), F.first("n").alias("n"))
    first = first.select("r.id", "r.url", "body", "digest", "n", F.lit(False).alias("revisit"), F.lit(None).cast("long").alias("refers"))
    again = marked(keys.df, True).groupBy("digest", "id", "url", "n").agg(F.count("*").alias("copies")).hint("merge").join(least.df.hint("merge"), "digest")
    again = again.withColumn("copies", F.col("copies") - F.when(F.col("id").eqNullSafe(F.col("r.id")) & F.col("url").eqNullSafe(F.col("r.url")), 1).otherwise(0)).where("copies > 0")
    again = again.select("id", "url", F.lit(b"").alias("body"), "digest", "n", F.lit(True).alias("revisit"), F.col("r.id").alias("refers"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_")).drop("_")
    rows = alone.unionByName(first).unionByName(again)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
        system, path = _open(name)
        out, at = None, 0
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500).to_pylist()
                if part and out is None:
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(path, compression=None)
                got: list[tuple] = []
                for r in part:
                    member = gzip.compress(record(r["id"], r["url"], r["body"], r["digest"], r["refers"], r["revisit"], r["n"]), level, mtime=0)
                    out.write(member)
                    got.append((surt(r["url"]), r["id"], name, at, len(member), "revisit" if r["revisit"] else "response"))
                    at += len(member)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["surt", "id", "file", "offset", "length", "kind"])
        if out is not None:
            out.close()

    return rows.mapInArrow(run, "surt string, id long, file string, offset long, length long, kind string")


def _sortable(id_: int | None) -> str:
    """An id as text that sorts as the number does, nulls first."""
    return "" if id_ is None else f"{id_ + (1 << 63):020d}"


def _line_key(surt_: str, id_: int | None) -> str:
    return f"{surt_}{SEP}{_sortable(id_)}"


def build_index(captures: DataFrame, folder: str, lines: int = BLOCK_LINES) -> DataFrame:
    """Writes the sorted, compressed blocks and returns the sparse directory (shard, first, last, offset, length, n)."""
    rows = captures.select(F.col("surt"), "id", "file", "offset", "length", "kind")
    spread = rows.withColumn("bin", F.encode("surt", "utf-8")).repartitionByRange("bin", F.col("id").asc_nulls_first(), "offset").sortWithinPartitions("bin", F.col("id").asc_nulls_first(), "offset").drop("bin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/index-{uuid.uuid4().hex}.gz"
        system, path = _open(name)
        out, at, held, blocks = None, 0, [], []

        def flush() -> None:
            nonlocal at, out
            if out is None:
                system.create_dir(path.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(path, compression=None)
            data = zlib.compress("\n".join(x for _, x in held).encode(), 6)
            out.write(data)
            blocks.append((name, held[0][0], held[-1][0], at, len(data), len(held)))
            at += len(data)
            held.clear()

        for b in batches:
            for r in b.to_pylist():
                k = _line_key(r["surt"], r["id"])
                held.append((k, SEP.join((k, r["file"], str(r["offset"]), str(r["length"]), r["kind"]))))
                if len(held) == lines:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*blocks), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["shard", "first", "last", "offset", "length", "n"])

    return spread.mapInArrow(run, "shard string, first string, last string, offset long, length long, n long")


class Captures:
    """Archives and their index, in folders of the shared one."""

    def __init__(self, df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", lines: int = BLOCK_LINES):
        self.spark = df.sparkSession
        self.folder = f"{shared_dir(self.spark)}/warc-{uuid.uuid4().hex[:8]}"
        captures = Stored(write_archives(df, f"{self.folder}/archive", key, url, payload), "captures")
        self.directory = Stored(build_index(captures.df, f"{self.folder}/index", lines), "directory").df
        captures.drop()

    def lookup(self, urls: DataFrame, url: str = "url") -> DataFrame:
        """(surt, id, file, offset, length, kind): all captures of each distinct URL."""
        to_key = lambda batches: (pa.RecordBatch.from_arrays([pa.array([surt(u) for u in b.column(0).to_pylist()], pa.string())], names=["q"]) for b in batches)
        keys = urls.select(url).mapInArrow(to_key, "q string").distinct()
        shards = self.directory.groupBy("shard").agg(F.min(F.encode("first", "utf-8")).alias("first"), F.max(F.encode("last", "utf-8")).alias("last")).orderBy("first").collect()  # a row per partition of the index
        firsts, lasts, names = [bytes(r["first"]) for r in shards], [bytes(r["last"]) for r in shards], [r["shard"] for r in shards]

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q, s = [], []
                for k in b.column(0).to_pylist():
                    low, high = f"{k}{SEP}".encode(), f"{k}{SEP}\x7f".encode()
                    i = max(0, bisect_left(firsts, low) - 1)  # several shards may begin with the key
                    while i < len(firsts) and firsts[i] <= high:
                        if lasts[i] >= low:
                            q.append(k)
                            s.append(names[i])
                        i += 1
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.string()), pa.array(s, pa.string())], names=["q", "shard"])

        wanted = keys.mapInArrow(deal, "q string, shard string")

        def search(key: tuple, asked: pd.DataFrame, directory: pd.DataFrame) -> pd.DataFrame:
            system, path = _open(key[0])
            blocks = sorted(zip((x.encode() for x in directory["first"]), directory["offset"], directory["length"]))
            heads = [x[0] for x in blocks]
            out: list[tuple] = []
            held, at = [], -1
            if len(asked):
                with system.open_input_file(path) as f:
                    for k in sorted(x.encode() for x in asked["q"]):
                        low, high = k + SEP.encode(), k + SEP.encode() + b"\x7f"
                        i = max(0, bisect_right(heads, low) - 1)
                        # A block may begin with the key and so may those before it.
                        while i > 0 and heads[i] >= low:
                            i -= 1
                        while i < len(blocks) and heads[i] <= high:
                            if at != i:
                                held = zlib.decompress(f.read_at(blocks[i][2], blocks[i][1])).split(b"\n")
                                at = i
                            j = bisect_right(held, low)
                            while j < len(held) and held[j] <= high:
                                x = held[j].decode().split(SEP)
                                out.append((x[0], int(x[1]) - (1 << 63) if x[1] else None, x[2], int(x[3]), int(x[4]), x[5]))
                                j += 1
                            i += 1
            return pd.DataFrame(out, columns=["surt", "id", "file", "offset", "length", "kind"]).astype({"id": "Int64"})

        return wanted.groupBy("shard").cogroup(self.directory.groupBy("shard")).applyInPandas(search, "surt string, id long, file string, offset long, length long, kind string")

    def read(self, found: DataFrame, payloads: bool = True) -> DataFrame:
        """(id, url, kind, refers, payload_bytes, digest, payload): the records at the places found. The digest of a response is
        that of the bytes read; a revisit's is its header's."""
        spread = found.repartition("file").sortWithinPartitions("file", "offset")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name, f, window, base = None, None, b"", 0
            for b in batches:
                rows = list(zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length"))))
                out: list[tuple] = []
                size = 0
                for i, (file, at, n) in enumerate(rows):
                    if file != name:
                        name, window, base = file, b"", 0
                        f = (lambda s, p: s.open_input_file(p))(*_open(file))
                    if not (base <= at and at + n <= base + len(window)):
                        end = at + n
                        for x, y, z in rows[i + 1 :]:
                            if x != file or y - end > GAP or y + z - at > READ:
                                break
                            end = y + z
                        window, base = f.read_at(end - at, at), at
                    r = parse_record(gzip.GzipFile(fileobj=io.BytesIO(window[at - base : at - base + n])).read())
                    digest = hashlib.sha256(r["payload"]).hexdigest() if r["type"] == "response" else r["digest"]
                    if digest != r["digest"]:
                        raise ValueError(f"{file}:{at}: broken payload")
                    out.append((r["page"], r["url"], r["type"], r["refers"], r["payload_bytes"], digest, r["payload"] if payloads else None))
                    size += len(r["payload"]) if payloads else 0
                    if size > READ:
                        yield _batch(out)
                        out, size = [], 0
                if out:
                    yield _batch(out)

        return spread.mapInArrow(run, "id long, url string, kind string, refers long, payload_bytes long, digest string, payload binary")

    def drop(self) -> None:
        drop(self.spark, self.folder)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["id", "url", "kind", "refers", "payload_bytes", "digest", "payload"])


def digest(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Archives the table, looks all its URLs up in the index and reads their records back."""
    c = Captures(df, key, url, payload)
    back = c.read(c.lookup(df, url), payloads=False)
    return back.select(F.col("id").alias(key), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers").alias("refers_to"))
