"""FASTA and FASTQ as DataFrames of (file, record_idx, header, seq), plain or gzip; sequences from any text column."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Consecutive matches walk a file as its four-line state machine does; group 1 is the sequence line.
_FASTQ = r"@([^\n]*)\n?([^\n]*)\n?[^\n]*\n?[^\n]*\n?|[^@\n][^\n]*\n?|\n"
_COLUMNS = ("file", "record_idx", "header", "seq")
#: Bytes that are read at once.
_BLOCK = 1 << 23


def detect_format(spark: SparkSession, path: str) -> str:
    """'fasta' or 'fastq' by the first byte; anything else, an empty file too, is an error."""
    row = spark.read.text(path).select(F.substring("value", 1, 1).alias("b")).first()
    kind = {">": "fasta", "@": "fastq"}.get(row["b"] if row else "")
    if kind is None:
        raise ValueError(f"{path}: neither FASTA nor FASTQ")
    return kind


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """One row per '>' wherever it stands; a header ends at the first line feed and the lines after it are joined.

    Splitting at '>' lets Spark cut plain files anywhere; a gzip file is one task. ``record_idx`` tells records apart and
    grows along a file; it is not a count of records, which would need a pass over the files before.
    """
    chunk = F.col("value")
    at = F.instr(chunk, "\n")
    seq = F.when(at == 0, F.lit("")).otherwise(F.replace(F.expr("substring(value, instr(value, '\n') + 1)"), F.lit("\n"), F.lit("")))
    header = F.when(at == 0, chunk).otherwise(F.substring_index(chunk, "\n", 1))
    rows = spark.read.text(path, lineSep=">").select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("record_idx"))
    return rows.where("value != ''").select("file", "record_idx", header.alias("header"), seq.alias("seq"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Strict four-line records; lines before an '@' are skipped, the third and fourth line are not looked at.

    A file is one row while it is read, so it has to have under 2 GB; ``read_fastq_streamed`` has no such limit.
    """
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    records = files.select("file", F.posexplode(F.arrays_zip(F.regexp_extract_all("value", F.lit(_FASTQ), F.lit(0)).alias("r"), F.regexp_extract_all("value", F.lit(_FASTQ), F.lit(1)).alias("h"), F.regexp_extract_all("value", F.lit(_FASTQ), F.lit(2)).alias("s"))).alias("i", "x"))
    return records.where("substring(x.r, 1, 1) = '@'").select("file", F.col("i").cast("long").alias("record_idx"), F.col("x.h").alias("header"), F.col("x.s").alias("seq"))


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _FastqReader(DataSourceReader):
    def __init__(self, paths: list[str], rows: int):
        self.paths, self.rows = paths, rows

    def partitions(self) -> list[InputPartition]:
        return [_Part(p) for p in self.paths]

    def read(self, partition: _Part) -> Iterator:
        import gzip

        import pyarrow as pa
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(partition.path) if "://" in partition.path else (fs.LocalFileSystem(), partition.path)
        raw = system.open_input_stream(name, compression=None)
        stream = gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else raw
        n = 0
        for heads, seqs in _records(stream, _BLOCK):
            for lo in range(0, len(heads), self.rows):
                h = heads.slice(lo, self.rows)
                yield pa.RecordBatch.from_arrays([pa.array([name.rpartition("/")[2]] * len(h)), pa.array(range(n, n + len(h)), pa.int64()), h, seqs.slice(lo, self.rows)], names=list(_COLUMNS))
                n += len(h)


def _strings(buf, start, end):
    """The texts between bytes start and end, which don't overlap, as an Arrow array; what is no UTF-8 is replaced."""
    import numpy as np
    import pyarrow as pa

    step = np.zeros(len(buf) + 1, np.int8)
    step[start] += 1
    step[end] -= 1
    data = buf[np.cumsum(step[:-1], dtype=np.int8).astype(bool)]
    offs = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offs[1:])
    if len(data) < 1 << 31:
        out = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(data)])
        try:
            out.validate(full=True)
            return out
        except pa.ArrowInvalid:
            pass
    return pa.array([data[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(offs[:-1].tolist(), offs[1:].tolist())], pa.string())


def _records(stream, block: int) -> Iterator[tuple]:
    """(headers, sequences) of the records of a stream, a block of bytes at a time; a record is four lines, from one that begins with '@'."""
    import numpy as np

    rest, size, last = b"", block, False
    while not last:
        new = stream.read(size)
        last = not new
        data = rest + new
        if last and data and not data.endswith(b"\n"):
            data += b"\n"
        buf = np.frombuffer(data, np.uint8)
        end = np.flatnonzero(buf == 10)
        start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
        is_head = buf[start] == 64
        i, found = 0, []
        while True:
            groups = (len(end) - i) // 4
            if not groups:
                break
            heads = is_head[i : i + 4 * groups : 4]
            good = groups if heads.all() else int(np.argmin(heads))
            found.append(np.arange(i, i + 4 * good, 4))
            i += 4 * good
            if good < groups:  # lines before the next header are passed over
                after = is_head[i:]
                i = i + int(np.argmax(after)) if after.any() else len(end)
        if last:
            after = is_head[i:]
            if after.any():  # the last record may lack lines
                found.append(np.array([i + int(np.argmax(after))]))
            i = len(end)
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        if len(at):
            nxt = np.minimum(at + 1, len(end) - 1)
            here = at + 1 < len(end)
            yield _strings(buf, start[at] + 1, end[at]), _strings(buf, np.where(here, start[nxt], len(buf)), np.where(here, end[nxt], len(buf)))
        rest = data[start[i] :] if i < len(end) else data[end[-1] + 1 :] if len(end) else data
        size = block if i else 2 * size  # a record longer than a block


class FastqSource(DataSource):
    """``spark.read.format("fastq")`` with options ``paths`` (comma-separated) and ``rows`` (records in a batch)."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "file string, record_idx long, header string, seq string"

    def reader(self, schema) -> DataSourceReader:
        return _FastqReader([p for p in self.options["paths"].split(",") if p], int(self.options.get("rows", 20_000)))


def read_fastq_streamed(spark: SparkSession, paths: list[str], rows: int = 20_000) -> DataFrame:
    """As ``read_fastq``, one task per file, block by block, in batches of ``rows`` records: files of any size."""
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").option("paths", ",".join(paths)).option("rows", rows).load()


def _bases(buf, head: bool):
    """The sequence in bytes of FASTA, every other byte but ACGTacgt and each '>' as an N, and whether a header is open after them; ``head``: one is before them."""
    import numpy as np

    mark = np.flatnonzero((buf == 62) | (buf == 10))
    heads = buf[mark] == 62
    size = np.diff(np.concatenate([[0], mark, [len(buf)]]))
    table = np.full(256, 78, np.uint8)
    for c in b"ACGTacgt":
        table[c] = c
    keep = np.repeat(~np.concatenate([[head], heads]), size)
    keep[mark] = heads
    return table[buf[keep]], bool(heads[-1]) if len(heads) else head


class _Stretch(InputPartition):
    def __init__(self, path: str, lo: int, hi: int | None):
        self.path, self.lo, self.hi = path, lo, hi


class _FastaReader(DataSourceReader):
    def __init__(self, paths: list[str], k: int, split: int, block: int = _BLOCK, chunk: int = 1 << 16):
        self.paths, self.k, self.split, self.block, self.chunk = paths, k, split, block, chunk

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        out = []
        for p in self.paths:
            system, name = fs.FileSystem.from_uri(p)
            size = system.get_file_info(name).size
            out += [_Stretch(p, 0, None)] if name.endswith(".gz") else [_Stretch(p, lo, min(lo + self.split, size)) for lo in range(0, size, self.split)]
        return out

    def _in_head(self, file, lo: int) -> bool:
        """Whether byte ``lo`` is in a header: after a '>' and no line feed. What is before the first '>' counts as one, as in ``read_fasta``."""
        while lo:
            size = min(lo, 1 << 16)
            file.seek(lo - size)
            before = file.read(size)
            at = max(before.rfind(b">"), before.rfind(b"\n"))
            if at >= 0:
                return before[at] == 62
            lo -= size
        return True

    def _stream(self, partition: _Stretch) -> Iterator:
        """The bases of the part and k - 1 more, block by block."""
        import gzip

        import numpy as np
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(partition.path)
        if partition.hi is None:
            file, head, left = gzip.GzipFile(fileobj=system.open_input_stream(name, compression=None)), True, None
        else:
            file = system.open_input_file(name)
            head, left = self._in_head(file, partition.lo), partition.hi - partition.lo
            file.seek(partition.lo)
        while left is None or left:
            data = file.read(self.block if left is None else min(self.block, left))
            if not data:
                return
            left = None if left is None else left - len(data)
            bases, head = _bases(np.frombuffer(data, np.uint8), head)
            yield bases
        more = self.k - 1
        while more:
            data = file.read(min(self.block, 1 << 12))
            if not data:
                return
            bases, head = _bases(np.frombuffer(data, np.uint8), head)
            bases = bases[:more]
            more -= len(bases)
            yield bases
            if 78 in bases:  # no window goes on beyond it
                return

    def read(self, partition: _Stretch) -> Iterator:
        import numpy as np
        import pyarrow as pa

        rest = np.zeros(0, np.uint8)
        for bases in self._stream(partition):
            rest = np.concatenate([rest, bases])
            n = len(rest) - self.k + 1
            if n > 0:
                pieces = [rest[lo : min(lo + self.chunk, n) + self.k - 1].tobytes() for lo in range(0, n, self.chunk)]
                yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.binary()).cast(pa.string())], names=["seq"])
                rest = rest[n:]


class FastaPieces(DataSource):
    """``spark.read.format("fasta_pieces")`` with options ``paths`` (comma-separated), ``k`` and ``split`` (bytes of a task)."""

    @classmethod
    def name(cls) -> str:
        return "fasta_pieces"

    def schema(self) -> str:
        return "seq string"

    def reader(self, schema) -> DataSourceReader:
        return _FastaReader([p for p in self.options["paths"].split(",") if p], int(self.options["k"]), int(self.options["split"]))


def read_windows(spark: SparkSession, path: str, k: int, format: str, split: int) -> tuple[DataFrame, bool]:
    """(seq): sequences with the windows of k bases of a file, each in one of them, and whether tasks read ``split`` bytes of plain files.

    FASTA is read block by block: a record or a line of any length is held nowhere as a whole. Where pyarrow can't open the
    store, the records are those of ``read_sequences``, and one is one row.
    """
    files = spark.read.text(path).inputFiles() if format == "fasta" else []
    if not files or not all(_streams(f) for f in files):
        return read_sequences(spark, path, format), False
    spark.dataSource.register(FastaPieces)
    rows = spark.read.format("fasta_pieces").option("paths", ",".join(f.replace(",", "%2C") for f in files)).option("k", k).option("split", split).load()
    return rows, not any(f.endswith(".gz") for f in files)


def read_sequences(spark: SparkSession, path: str, format: str = "auto") -> DataFrame:
    """Reads either format; 'auto' looks at the first byte. Gzip goes by the suffix .gz.

    FASTQ files may have any size where pyarrow can open their store; where only Spark can, ``read_fastq``'s bound holds.
    """
    kind = detect_format(spark, path) if format == "auto" else format
    if kind not in ("fasta", "fastq"):
        raise ValueError(f"format must be auto, fasta or fastq, not {format!r}")
    if kind == "fasta":
        return read_fasta(spark, path)
    files = spark.read.text(path).inputFiles()
    if not files or not all(_streams(f) for f in files):
        return read_fastq(spark, path)
    return read_fastq_streamed(spark, [f.replace(",", "%2C") for f in files])


def file_bytes(spark: SparkSession, path: str) -> int:
    """The bytes of a file, a folder's files or a pattern's, as stored."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sum(system.getContentSummary(s.getPath()).getLength() for s in system.globStatus(p) or [])


def _streams(file: str) -> bool:
    """Whether pyarrow opens the file's store, and no codec but gzip is on it; else only Spark can read it."""
    from pyarrow import fs

    if file.endswith((".bz2", ".deflate", ".lz4", ".snappy", ".zst")):
        return False
    try:
        system, name = fs.FileSystem.from_uri(file)
        return system.get_file_info(name).is_file
    except Exception:  # a scheme or a store that it doesn't know
        return False


#: Letters to bases, for text that is to stand for DNA: A, C, G, T in turn over the alphabet.
LETTERS, BASES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC"


def sequences_from_column(df: DataFrame, col: str, adapter: str = "natural", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., seq) from a text column: 'natural' takes the text as it is, 'mapped' turns each ASCII letter into a base.

    A null text gives a null sequence, which has no words.
    """
    if adapter == "natural":
        seq = F.col(col)
    elif adapter == "mapped":
        seq = F.translate(F.upper(F.regexp_replace(col, "[^A-Za-z]", "")), LETTERS, BASES)
    else:
        raise ValueError(f"adapter must be natural or mapped, not {adapter!r}")
    return df.select(*keep, seq.alias("seq"))
