"""Self-join of texts on the Jaccard similarity of their word n-grams.

Each text becomes the sorted set of its n-gram hashes; equal sets are one class. Classes are ordered rare-first by a
fixed-size table of bucketed corpus counts and joined on the n-grams of their prefixes; length, positional and suffix
filters drop pairs, and each pair left is verified once on whole sets. The table only orders n-grams, the same way for
all texts: where buckets are shared by many n-grams the prefixes are less rare and candidates more, results the same.

The suffix filter partitions the n-grams by halves, as deep as a set has bits in its size, and adds up what two sets
must differ by in each part at least: one n-gram where one of them has an odd number and the other an even one. A
class keeps these parities, one or two bits for each of its n-grams; the deeper of two partitions is folded to the
other. A fixed depth would see no difference between long texts.

Large groups of near copies would give a pair for each two of them, though one link from each to a centre says as
much about who reaches whom. ``components`` therefore joins twice. First each prefix n-gram links its classes to one
of them, that with the fewest rarer n-grams; then only pairs whose ends are not yet connected are tried, every one of
them, so no component is missed. In the second join the classes outside the centre's component meet blocks of the
n-gram's classes, so a frequent n-gram is spread over tasks. ``links`` instead verifies all pairs of classes.

All joins are merged by key at every size: no side has a bound, so none is broadcast. Tables that are grouped by
n-gram are written before they are joined by n-gram, so that the join alone owns its shuffle and a hot key is split.

Defined cases: a text without words, empty or null, is linked with nothing; one with fewer words than n has the whole
sequence as its one n-gram; repeated rows and equal sets are one class; a null key is no candidate for a smallest key;
columns besides key and text are ignored here and unchanged in ``dedup``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, spare
from .graph import components as connected
from .textvec import U, Words, mix, pieces, shingle_sets

#: Buckets of the count table (one byte each when broadcast) and of its blocks.
BUCKETS = 1 << 24
BLOCK = 1 << 16
#: Bits of the broadcast bitmap of wanted sets, and the sets marked in it at once; more are fetched in further rounds.
WANTED = 1 << 26
ROUND = 1 << 25
#: Bits of the least deep partition: what travels with the n-grams.
COARSE = 256
#: Classes of one n-gram that meet in one block of the second join.
SHARE = 2000


def _parities(s: np.ndarray) -> np.ndarray:
    """For each part whether it holds an odd number of the set, eight parts a byte; halves of the result fold by XOR."""
    parts = max(COARSE, 1 << len(s).bit_length())
    return np.packbits((np.bincount((s & U(parts - 1)).astype(np.int64), minlength=parts) & 1).astype(np.uint8))


def _fold(x: np.ndarray, size: int) -> np.ndarray:
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def least_difference(x: np.ndarray, y: np.ndarray) -> int:
    """The number of n-grams that are in one of two sets only is at least this, by their parities."""
    size = min(len(x), len(y))
    return int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum(dtype=np.int64))


def _signature(s: np.ndarray) -> tuple[int, int]:
    a, b = np.bitwise_xor.reduce(mix(s)), np.add.reduce(mix(s ^ U(0xA5A5A5A5A5A5A5A5)))
    return int(a.view(np.int64)), int((b + U(len(s))).view(np.int64))


def bucket_levels(df: DataFrame, text: str, n: int) -> np.ndarray:
    """For each bucket of n-gram hashes the rounded logarithm of the number of texts with its n-grams: 16 MB, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.uint32)
        for b in batches:
            for _, _, buf, offs in pieces(b.column(0)):
                sets = list(shingle_sets(Words(buf, offs), n))
                u, m = np.unique((np.concatenate(sets) & U(BUCKETS - 1)).astype(np.int64), return_counts=True)
                total[u] += m.astype(np.uint32)
        if total.any():
            # Nearly all counts of a task are small: pressed by byte planes they take little.
            rows = [pa.compress(np.ascontiguousarray(total[i : i + BLOCK].view(np.uint8).reshape(BLOCK, 4).T), "zstd", asbytes=True) for i in range(0, BUCKETS, BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS // BLOCK)), pa.array(rows, pa.binary())], names=["block", "counts"])

    def add(block: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BLOCK, np.int64)
        for part in parts:
            for x in part["counts"]:
                planes = np.frombuffer(pa.decompress(x, 4 * BLOCK, "zstd", asbytes=True), np.uint8).reshape(4, BLOCK)
                for i in range(4):
                    if i == 0 or planes[i].any():
                        total += planes[i].astype(np.int64) << 8 * i
        yield pd.DataFrame({"block": [block[0]], "levels": [np.minimum(255, np.rint(8 * np.log2(total + 1.0))).astype(np.uint8).tobytes()]})

    rows = df.select(text).mapInArrow(run, "block long, counts binary").groupBy("block").applyInPandas(add, "block long, levels binary").collect()
    out = np.zeros(BUCKETS, np.uint8)
    for r in rows:
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["levels"], np.uint8)
    return out


def _alpha(na, nb, percent: int):
    """The least overlap that makes two sets of these sizes similar."""
    return -(-(percent * (na + nb)) // (100 + percent))


def _coarse(nodes: DataFrame) -> DataFrame:
    """(id, cells): the parities of each class over the least deep partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            short = [_fold(np.frombuffer(x.as_buffer(), np.uint8), COARSE // 8).tobytes() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(short, pa.binary())], names=["id", "cells"])

    return nodes.select("id", "cells").mapInArrow(run, "id long, cells binary")


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose gram another row has too: one shuffle and a pass over each task's rows in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row so far, if its gram is not known to be shared
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(0).to_numpy()
            same = g[1:] == g[:-1]
            keep = np.append(False, same) | np.append(same, False)
            keep[0] |= g[0] == last
            if held is not None and g[0] == last:
                yield held
            out = b.filter(pa.array(keep))
            if out.num_rows:
                yield out
            held, last = (None if keep[-1] else b.slice(b.num_rows - 1)), g[-1]

    return rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, rows.schema)


class NgramJoin:
    """The join of one table with itself; nothing is computed before it is asked for, but the sets' prefixes."""

    def __init__(self, df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80):
        self.df, self.key, self.text, self.n, self.percent = df, key, text, n, percent
        self.spark = df.sparkSession
        levels = self.spark.sparkContext.broadcast(bucket_levels(df, text, n))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            level = levels.value
            for b in batches:
                for lo, hi, buf, offs in pieces(b.column(1)):
                    sa, sb, size, cells, prefix, cut = [], [], [], [], [], [0]
                    for s in shingle_sets(Words(buf, offs), n):
                        x, y = _signature(s) if len(s) else (0, 0)
                        sa.append(x)
                        sb.append(y)
                        size.append(len(s))
                        cells.append(_parities(s).tobytes())
                        if len(s):
                            k = len(s) + (-percent * len(s)) // 100 + 1
                            order = np.argsort(level[(s & U(BUCKETS - 1)).astype(np.int64)], kind="stable")[:k]
                            prefix.append(s[order])
                            cut.append(cut[-1] + k)
                        else:
                            cut.append(cut[-1])
                    flat = np.concatenate(prefix).view(np.int64) if prefix else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(lo, hi - lo), pa.array(sa, pa.int64()), pa.array(sb, pa.int64()), pa.array(size, pa.int64()), pa.array(cells, pa.binary()), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat))],
                        names=["k", "sa", "sb", "n", "cells", "prefix"],
                    )

        kind = df.schema[key].dataType.simpleString()
        self.kind = kind
        full = Stored(df.select(key, text).mapInArrow(run, f"k {kind}, sa long, sb long, n long, cells binary, prefix array<long>"), "sets")
        self.rows = Stored(full.df.select("k", "sa", "sb", "n"), "rows").df
        nodes = full.df.where("n > 0").groupBy("sa", "sb").agg(F.min("k").alias("k"), F.first("n").alias("n"), F.first("cells").alias("cells"), F.first("prefix").alias("prefix"))
        nodes = Stored(nodes.withColumn("id", F.monotonically_increasing_id()), "classes")
        full.drop()
        self.nodes = Stored(nodes.df.drop("prefix"), "nodes").df
        every = nodes.df.select("id", F.col("n").cast("int").alias("size"), F.posexplode("prefix").alias("pos", "gram"))
        self.grams = Stored(_shared(every.select("gram", "id", "size", "pos")), "grams").df
        nodes.drop()

    def _similar(self, na: str, nb: str, pa_: str, pb: str):
        """Length and positional filter in SQL: the sets share this n-gram, and of what is rarer at most the shorter part."""
        p = self.percent
        bound = f"least({pa_}, {pb}) + least({na} - {pa_}, {nb} - {pb})"
        return F.expr(f"100 * least({na}, {nb}) >= {p} * greatest({na}, {nb}) and ({bound}) * {100 + p} >= {p} * ({na} + {nb})")

    def _close(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that the suffix filter leaves."""
        one = lambda x: self.nodes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("cells").alias(f"c{x}")).hint("merge")
        full = pairs.hint("merge").join(one("b"), "b").join(one("a"), "a").select("a", "b", "na", "nb", "ca", "cb")
        percent = self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                both = b.column(2).to_numpy() + b.column(3).to_numpy()
                far = np.array([least_difference(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) for x, y in zip(b.column(4), b.column(5))], np.int64)
                yield b.select(["a", "b"]).filter(pa.array((both - far) * (100 + percent) >= 2 * percent * both))

        return full.mapInArrow(run, "a long, b long")

    def _sets(self, pairs: DataFrame) -> Stored:
        """(id, members) of the classes in pairs: the texts are read once more, and a set leaves a task only if it is wanted, once."""
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        cell = F.col("sa").bitwiseXOR(F.col("sb")).bitwiseAND(F.lit(WANTED - 1))
        wanted = Stored(self.nodes.select("id", "sa", "sb", cell.alias("cell")).join(ids.hint("merge"), "id"), "wanted")
        rounds = max(1, -(-wanted.df.count() // ROUND))
        parts = [self._fetch(wanted.df.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == r) if rounds > 1 else wanted.df) for r in range(rounds)]
        out = parts[0].df
        for p in parts[1:]:
            out = out.union(p.df)
        members = Stored(out, "members") if rounds > 1 else parts[0]
        for p in [wanted, *(parts if rounds > 1 else [])]:
            p.drop()
        return members

    def _fetch(self, want: DataFrame) -> Stored:
        """(id, members) of the wanted classes; the driver holds a bitmap of them."""
        bits = np.zeros(WANTED // 8, np.uint8)
        place = F.col("cell") + 1
        rows = want.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()  # at most 2**11 rows of 4 KB
        for r in rows:
            bits[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
        shared = self.spark.sparkContext.broadcast(bits)
        n = self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = shared.value
            seen: set[tuple[int, int]] = set()
            for b in batches:
                for _, _, buf, offs in pieces(b.column(0)):
                    new, out = [], []
                    for s in shingle_sets(Words(buf, offs), n):
                        if not len(s):
                            continue
                        sig = _signature(s)
                        cell = (sig[0] ^ sig[1]) & (WANTED - 1)
                        if bits[cell >> 3] >> (cell & 7) & 1 and sig not in seen:
                            seen.add(sig)
                            new.append(sig)
                            out.append(s.tobytes())
                    if new:
                        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in new], pa.int64()), pa.array([x[1] for x in new], pa.int64()), pa.array(out, pa.binary())], names=["sa", "sb", "members"])

        sets = self.df.select(self.text).mapInArrow(run, "sa long, sb long, members binary").join(want.select("id", "sa", "sb").hint("merge"), ["sa", "sb"])
        return Stored(sets.groupBy("id").agg(F.first("members").alias("members")), "members")

    def _verify(self, candidates: DataFrame) -> Stored:
        """The pairs (a, b) that are similar, each looked at once."""
        pairs = Stored(self._close(candidates), "pairs")
        stored = self._sets(pairs.df)
        sets, percent = stored.df, self.percent
        full = pairs.df.hint("merge").join(sets.select(F.col("id").alias("b"), F.col("members").alias("mb")).hint("merge"), "b").join(sets.select(F.col("id").alias("a"), F.col("members").alias("ma")).hint("merge"), "a").select("a", "b", "ma", "mb")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for big in batches:
                for lo in range(0, big.num_rows, 500):
                    b = big.slice(lo, 500)
                    ok = []
                    for x, y in zip(b.column(2), b.column(3)):
                        s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                        m = np.concatenate([s, t])
                        m.sort()
                        both = int(np.count_nonzero(m[1:] == m[:-1]))
                        ok.append(100 * both >= percent * (len(m) - both))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

        out = Stored(full.mapInArrow(run, "a long, b long"), "links")
        stored.drop()
        pairs.drop()
        return out

    def _centre_pairs(self) -> DataFrame:
        """For each prefix n-gram the pairs of its classes with that of them that has the fewest rarer n-grams."""
        centre = Stored(self.grams.groupBy("gram").agg(F.min(F.struct("pos", "size", "id")).alias("c")), "centres").df
        pairs = self.grams.hint("merge").join(centre.hint("merge"), "gram").where("id != c.id").where(self._similar("size", "c.size", "pos", "c.pos"))
        return pairs.select(F.least("id", "c.id").alias("a"), F.greatest("id", "c.id").alias("b")).distinct()

    def _open_pairs(self, roots: DataFrame | None) -> DataFrame:
        """All pairs of classes that share a prefix n-gram, pass the filters and are in different components (without roots: all)."""
        g = self.grams
        if roots is None:
            g = g.withColumn("root", F.col("id"))
        else:
            g = Stored(g.hint("merge").join(roots.withColumnRenamed("node", "id").hint("merge"), "id", "left").withColumn("root", F.coalesce("root", "id")), "rooted").df
        mixed = g.groupBy("gram").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("m"), F.min(F.struct("pos", "size", "id", "root")).alias("c")).where("r0 != r1")
        mixed = Stored(mixed.select("gram", F.col("c.root").alias("centre"), F.ceil(F.col("m") / SHARE).cast("int").alias("blocks")), "mixed").df
        cells = _coarse(self.nodes)
        rows = Stored(g.hint("merge").join(mixed.hint("merge"), "gram"), "open").df.hint("merge").join(cells.hint("merge"), "id")
        own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        rows = rows.select("gram", "id", "size", "pos", "root", "cells", (F.col("root") != F.col("centre")).alias("out"), own.alias("own"), "blocks")
        rows = rows.withColumn("block", F.explode(F.when(F.col("out"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))))
        rows = rows.select("gram", "block", "id", "size", "pos", "root", "cells", "out", (F.col("block") == F.col("own")).alias("home"))
        rows = rows.repartition("gram", "block").sortWithinPartitions("gram", "block")
        percent = self.percent

        def pairs_of(b: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            """Pairs of one n-gram and block: those outside the centre's component with those at home here."""
            i_d, size, pos, root = (b.column(c).to_numpy().astype(np.int64) for c in ("id", "size", "pos", "root"))
            out, home = b.column("out").to_numpy(), b.column("home").to_numpy()
            cells = np.frombuffer(b"".join(b.column("cells").to_pylist()), np.uint64).reshape(-1, COARSE // 64)
            x, y = np.flatnonzero(out), np.flatnonzero(home)
            y = y[np.argsort(size[y], kind="stable")]
            first, stop = np.searchsorted(100 * size[y], percent * size[x]), np.searchsorted(percent * size[y], 100 * size[x], "right")
            found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, lo, hi in zip(x.tolist(), first.tolist(), stop.tolist()):
                j = y[lo:hi]  # the length filter
                j = j[(root[j] != root[i]) & ((~out[j]) | (i_d[j] > i_d[i]) | ~home[i])]
                need = _alpha(size[j], size[i], percent)
                keep = np.minimum(pos[j], pos[i]) + np.minimum(size[j] - pos[j], size[i] - pos[i]) >= need
                j, need = j[keep], need[keep]
                if len(j):
                    far = np.bitwise_count(cells[j] ^ cells[i]).sum(1, dtype=np.int64)
                    j = j[size[j] + size[i] - far >= 2 * need]
                found_a.append(np.minimum(i_d[i], i_d[j]))
                found_b.append(np.maximum(i_d[i], i_d[j]))
            return np.concatenate(found_a), np.concatenate(found_b)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rest: pa.Table | None = None
            seen: set[tuple[int, int]] = set()

            def flush(t: pa.Table, last: bool) -> tuple[list[tuple[int, int]], pa.Table | None]:
                gram, block = t.column("gram").to_numpy(), t.column("block").to_numpy()
                cut = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (block[1:] != block[:-1]), [True]]))
                new: list[tuple[int, int]] = []
                for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    if hi == t.num_rows and not last:
                        return new, t.slice(lo)
                    if hi - lo > 1:
                        for p in zip(*(z.tolist() for z in pairs_of(t.slice(lo, hi - lo)))):
                            if p not in seen:
                                if len(seen) > 500_000:
                                    seen.clear()
                                seen.add(p)
                                new.append(p)
                return new, None

            for b in batches:
                t = pa.Table.from_batches([b])
                rest = t if rest is None else pa.concat_tables([rest, t])
                if rest.num_rows:
                    new, rest = flush(rest.combine_chunks(), False)
                    if new:
                        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in new], pa.int64()), pa.array([p[1] for p in new], pa.int64())], names=["a", "b"])
            if rest is not None and rest.num_rows:
                new, _ = flush(rest.combine_chunks(), True)
                if new:
                    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in new], pa.int64()), pa.array([p[1] for p in new], pa.int64())], names=["a", "b"])

        return rows.mapInArrow(run, "a long, b long").distinct()

    def links(self) -> DataFrame:
        """(a, b): every pair of similar classes, by the ids in ``nodes``."""
        return self._verify(self._open_pairs(None)).df

    def roots(self) -> DataFrame:
        """(node, root): the component of each class that has a link."""
        first = self._verify(self._centre_pairs())
        roots = Stored(connected(first.df, "a", "b"), "roots")
        first.drop()
        more = self._verify(self._open_pairs(roots.df))
        if more.df.isEmpty():
            return roots.df
        star = roots.df.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a != b")
        out = Stored(connected(star.union(more.df), "a", "b"), "roots").df
        roots.drop()
        more.drop()
        return out

    def classes(self) -> DataFrame:
        """(sa, sb, root, component): the component of each class, named by its smallest key."""
        named = self.nodes.select("id", "sa", "sb", "k").hint("merge").join(self.roots().withColumnRenamed("node", "id").hint("merge"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        named = Stored(named, "named").df
        least = Stored(named.groupBy("root").agg(F.min("k").alias("component")), "least").df
        return named.hint("merge").join(least.hint("merge"), "root").select("sa", "sb", "root", "component")

    def components(self) -> DataFrame:
        """(key, n_shingles, component_id) of each row."""
        rows = self.rows.select("k", "sa", "sb", "n").hint("merge").join(self.classes().hint("merge"), ["sa", "sb"], "left")
        return rows.select(F.col("k").alias(self.key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("k")).alias("component_id"))


def components(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    return NgramJoin(df, key, text, n, percent).components()


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, that with the smallest key, and all rows without words; columns as they were."""
    join = NgramJoin(df, key, text, n, percent)
    first = join.classes()
    kept = join.rows.where("n > 0").hint("merge").join(first.hint("merge"), ["sa", "sb"]).groupBy("root").agg(F.min(F.struct(F.col("k").isNull().alias("none"), "k", "sa", "sb")).alias("r"))
    names = df.columns
    ck, ca, cb, none, keep, nth = spare(names, "_k", "_sa", "_sb", "_none", "_keep", "_nth")
    kept = Stored(kept.select(F.col("r.k").alias(ck), F.col("r.sa").alias(ca), F.col("r.sb").alias(cb)), "kept").df
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in pieces(b.column(at)):
                sets = list(shingle_sets(Words(buf, offs), n))
                sig = [_signature(s) if len(s) else (0, 0) for s in sets]
                new = [pa.array([x[0] for x in sig], pa.int64()), pa.array([x[1] for x in sig], pa.int64()), pa.array([not len(s) for s in sets], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, *new], names=[*names, ca, cb, none])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", {ca} long, {cb} long, {none} boolean"
    signed = df.mapInArrow(run, schema)
    # A row without words meets itself: its key in the join is its own.
    one = kept.withColumn(keep, F.lit(True)).hint("merge")
    joined = signed.join(one, (signed[ca] == one[ca]) & (signed[cb] == one[cb]) & signed[key].eqNullSafe(one[ck]) & ~signed[none], "left").select(*[signed[c] for c in names], signed[ca], signed[cb], signed[none], keep)
    order = F.row_number().over(Window.partitionBy(ca, cb, key).orderBy(F.lit(1)))
    return joined.where(F.col(none) | F.col(keep)).withColumn(nth, F.when(F.col(none), F.lit(1)).otherwise(order)).where(F.col(nth) == 1).select(*names)
