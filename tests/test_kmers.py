import gzip
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import dna, sizing
from strandline.operators import count as C
from strandline.operators import packed
from strandline.operators import windows as W
from strandline.plans import golden, sql_functions
from strandline.plans.runner import count_file, count_file_to_tsv, run_statistics
from strandline.sources import sequences as S

COMP = str.maketrans("ACGT", "TGCA")
KS = [1, 2, 3, 5, 21, 31, 32, 33, 63, 64, 65, 96, 97, 127]

GOLDEN = [g[1:] for g in golden.GOLDEN]


def rc(w):
    return w.translate(COMP)[::-1]


def key(w):
    return "".join(w[i : i + 32][::-1] for i in range(0, len(w), 32))


def canon(w, order="reference"):
    return min(w, rc(w), key=key if order == "reference" else None)


def v4(w):
    images = [("I", w), ("RC", rc(w)), ("C", w.translate(COMP)), ("R", w[::-1])]
    t, x = min(images, key=lambda p: key(p[1]))  # min keeps the first of equals
    return x, t


def words(seq, k):
    run = ""
    for c in seq.upper() + "N" if seq.isascii() else "":
        if c in "ACGT":
            run += c
            if len(run) >= k:
                yield run[-k:]
        else:
            run = ""


def rand_seqs(seed, n=25):
    r = random.Random(seed)
    return ["".join(r.choice("ACGTacgtN" if r.random() < 0.05 else "ACGT") for _ in range(r.randint(0, 400))) for _ in range(n)]


def frame(spark, seqs):
    return spark.createDataFrame([(s,) for s in seqs], "seq string")


def counts(df):
    return {r.kmer: r["count"] for r in df.collect()}


def test_golden_files(spark, tmp_path):
    for i, (text, k, order, want, classes) in enumerate(GOLDEN):
        for gz in (False, True):
            p = tmp_path / f"g{i}.{'fa.gz' if gz else 'fa'}"
            p.write_bytes(gzip.compress(text.encode()) if gz else text.encode())
            rows = S.read_sequences(spark, str(p))
            assert counts(C.count_kmers(rows, k, order)) == want, (i, gz)
            if not gz:
                assert counts(C.count_kmers(rows, k, order, path="text")) == want, i
                assert C.count_classes(rows, k).count() == classes, i


def test_fastq_streamed(spark, tmp_path):
    for i, (text, k, order, want, _) in enumerate(g for g in GOLDEN if g[0][0] == "@"):
        p = tmp_path / f"q{i}.fq.gz"
        p.write_bytes(gzip.compress(text.encode()))
        assert counts(C.count_kmers(S.read_fastq_streamed(spark, [str(p)], rows=1), k, order)) == want


def test_headers_and_errors(spark, tmp_path):
    p = tmp_path / "a.fa"
    p.write_text(">one x\nAC\nGT\n>two\n>three\nA")
    rows = S.read_fasta(spark, str(p)).orderBy("record_idx").collect()
    assert [(r.file, r.header, r.seq) for r in rows] == [("a.fa", "one x", "ACGT"), ("a.fa", "two", ""), ("a.fa", "three", "A")]
    for name, text in (("e.fa", ""), ("b.fa", "\n>a\nAC\n"), ("x.fa", "ACGT")):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError):
            S.read_sequences(spark, str(tmp_path / name))
    with pytest.raises(Exception):
        S.read_sequences(spark, str(tmp_path / "missing.fa"))
    for k in (0, 128, -1):
        with pytest.raises(ValueError):
            count_file(spark, str(p), k)
    with pytest.raises(TypeError):
        count_file(spark, str(p), "21")
    with pytest.raises(ValueError):
        C.count_kmers(rows := S.read_fasta(spark, str(p)), 40, path="other")
    with pytest.raises(ValueError):
        C.count_kmers(rows, 4, order="other")


@pytest.mark.parametrize("k", [1, 5, 31, 32, 33, 65, 127])
def test_counts_by_brute_force(spark, k):
    seqs = [*rand_seqs(k), None, "", "ẗACGTﬅ"]
    df = frame(spark, seqs).repartition(3)
    for order in dna.ORDERS:
        want = Counter(canon(w, order) for s in seqs[:-3] for w in words(s, k)) + Counter(canon("ACGT"[i : i + k], order) for i in range(5 - k))
        assert counts(C.count_kmers(df, k, order, path="text", chunk=37)) == want
        assert counts(packed.count_packed(df, k, order=order, chunk=29, spread=5)) == want
    classes = {tuple(r) for r in C.count_classes(df, k).collect()}
    assert classes == {tuple(r) for r in C.count_classes(df, k, path="text", chunk=11).collect()}
    assert {w for w, *_ in classes} == {v4(w)[0] for s in [*seqs[:-3], "ACGT"] for w in words(s, k)}


def test_symmetries(spark):
    r = random.Random(1)
    for k in KS:
        ws = ["".join(r.choice("ACGT") for _ in range(k)) for _ in range(40)]
        ws += [w[: k // 2] + rc(w[: k // 2]) for w in ws[:5] if k % 2 == 0] + [w[: (k + 1) // 2] + w[: k // 2][::-1] for w in ws[:5]]
        w = F.col("w")
        rows = spark.createDataFrame([(x,) for x in ws], "w string").select("w", dna.canonical_pair(w, k).alias("p"), dna.canonical_pair(w, k, "lex").alias("l"), dna.canonical_v4(w, k).alias("v"), *dna.transforms(w)).collect()
        for x in rows:
            assert (x.p, x.l, (x.v.kmer, x.v.transform)) == (canon(x.w), canon(x.w, "lex"), v4(x.w))
            assert (x.i, x.r, x.c, x.rc) == (x.w, x.w[::-1], x.w.translate(COMP), rc(x.w))


@pytest.mark.parametrize("k,classes,pairs", [(1, 2, 2), (2, 6, 10), (3, 20, 32), (4, 72, 136), (5, 272, 512)])
def test_cardinalities_and_split(spark, k, classes, pairs):
    import itertools

    df = frame(spark, ["".join(p) for p in itertools.product("ACGT", repeat=k)])
    c = C.count_classes(df, k)
    assert c.count() == classes
    split = counts(C.split_classes(c, k))
    assert len(split) == pairs and split == counts(C.count_kmers(df, k))
    s = C.stats(c).first()
    assert (s.classes, s.output_rows, s.overflow_classes, s.windows) == (classes, pairs, 0, 4**k)


def test_stats_edges(spark):
    s = C.stats(C.count_classes(frame(spark, ["A" * 260]), 5)).first()
    assert (s.classes, s.output_rows, s.overflow_classes, s.windows) == (1, 1, 1, 256)
    s = C.stats(C.count_classes(frame(spark, [None]), 5)).first()
    assert tuple(s) == (0, 0, 0, 0)


def test_invariances(spark):
    seqs = rand_seqs(9)
    k = 7
    want = counts(C.count_kmers(frame(spark, seqs), k))
    assert counts(C.count_kmers(frame(spark, [rc(s.upper()) for s in seqs]), k)) == want
    assert counts(C.count_kmers(frame(spark, seqs).repartition(5), k, path="text", chunk=1, spread=3)) == want
    by = C.count_kmers_by(frame(spark, seqs).withColumn("g", F.length("seq") % 2), k, ("g",))
    assert counts(by.groupBy("kmer").agg(F.sum("count").alias("count"))) == want
    both = C.compare(C.count_kmers(frame(spark, seqs[:9]), k), C.count_kmers(frame(spark, seqs[9:]), k))
    assert {r.kmer: r.count_left + r.count_right for r in both.collect()} == want
    assert {r.multiplicity: r.kmers for r in C.spectrum(C.count_kmers(frame(spark, seqs), k)).collect()} == Counter(want.values())


def test_codes():
    base = np.frombuffer(b"\0\1\2\3\4\3\2", np.uint8)
    f, r = packed.codes(base, 2)
    assert f[:3].tolist() == [1, 6, 11] and r[:3].tolist() == [11, 6, 1]
    for k in KS:
        w = "".join(random.Random(k).choice("ACGT") for _ in range(k + 2))
        base = packed._CODE[np.frombuffer(w.encode(), np.uint8)]
        want = [w[i : i + k] for i in range(3)]
        for keys in (False, True):
            own, back = packed.words(base, k, keys)
            assert packed.spell(own, k, keys).to_pylist() == want and packed.spell(back, k, keys).to_pylist() == [rc(x) for x in want]
        assert packed.words(base[: k - 1], k)[0][0].size == 0


def test_slices_and_parts(spark, monkeypatch):
    """Windows across slices, parts merged alone and together, and pieces of one long text."""
    seqs = ["".join(random.Random(3).choice("ACGT") for _ in range(5000)) + "N" + "A" * 700, "ACGTTGCA" * 90]
    for k in (3, 13, 40):
        want = Counter(canon(w) for s in seqs for w in words(s, k))
        for step, merge in ((64, 1), (1000, 100)):
            monkeypatch.setattr(packed, "SLICE", step)
            monkeypatch.setattr(packed, "MERGE", merge)
            assert counts(packed.count_packed(frame(spark, seqs), k, size=1)) == want
            assert counts(packed.count_packed(frame(spark, seqs), k, chunk=77, spread=3, partitions=2)) == want


def test_long_run_is_cut_in_one_walk(spark):
    """Eight million bases: by position each piece would be found from the start."""
    import time

    df = frame(spark, ["ACGGT" * 1_600_000])
    began = time.time()
    assert {r.w: r["n"] for r in C._distinct(W.windows(df, 12)).collect()} == Counter(("ACGGT" * 4)[i : i + 12] for i in range(5)) | {("ACGGT" * 4)[i : i + 12]: 1_600_000 - (2 if i < 4 else 3) for i in range(5)}
    assert counts(C.count_kmers(df, 12, spread=4)) == {w: n for w, n in counts(C.count_kmers(df, 12, path="text")).items()}
    assert time.time() - began < 90


def test_tsv_cli_and_sql(spark, tmp_path):
    p = tmp_path / "a.fa"
    p.write_text(">t\nACGTACGTACGT\n")
    count_file_to_tsv(spark, str(p), 5, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["ACGTA\t4", "CGTAC\t4"]
    from strandline import cli

    assert cli.main([]) == 1 and cli.main(["x", "0", "y"]) == 1 and cli.main(["x", "q", "y"]) == 1
    assert "dna_canonical" in sql_functions.register(spark)
    w = "AGCGGAATCATCTCGAGTGGGATGCATCGTGTC"
    r = spark.sql(f"select dna_canonical('{w}') a, dna_canonical_lex('{w}') b, dna_revcomp('AAC') c").first()
    assert tuple(r) == (canon(w), canon(w, "lex"), "GTT")


def test_stream(spark, tmp_path):
    from strandline.streaming.incremental import stream_counts

    for i, s in enumerate(rand_seqs(2, 6)):
        (tmp_path / f"{i}.fa").write_text(f">s{i}\n{s}\n>x\nACGT\n")
    q = stream_counts(spark, str(tmp_path), 4, files_per_trigger=2).writeStream.format("memory").queryName("stream_kmers").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert counts(spark.table("stream_kmers")) == counts(C.count_kmers(S.read_fasta(spark, str(tmp_path)), 4))


def test_sizing():
    assert sizing.estimate_unique(580_000, 21) == 1_000_000 and sizing.estimate_unique(10**9, 3) == 64
    assert sizing.estimate_unique(10**8, 21) == 108_000_000 and sizing.estimate_unique(10**8, 40, True, True) == 120_000_000
    assert sizing.table_capacity(1_000_000) == 1 << 21 and sizing.table_capacity(1) == 1024
    assert sizing.shuffle_partitions(10**9, 21) > sizing.shuffle_partitions(10**6, 21) == 1


def test_read_sequences_streams_fastq(spark, tmp_path, monkeypatch):
    d = tmp_path / "a, b"
    d.mkdir()
    (d / "x.fq").write_text("@r1\nACGT\n+\nIIII\njunk\n@r2 é\nGGA\n+\n@@@\n")
    (d / "y.fq.gz").write_bytes(gzip.compress(b"@r3\nTT\n+\nII"))
    want = sorted((r.file, r.header, r.seq) for r in S.read_fastq(spark, str(d)).collect())
    monkeypatch.setattr(S, "read_fastq", None)  # holds a file as one row
    assert sorted((r.file, r.header, r.seq) for r in S.read_sequences(spark, str(d)).collect()) == want
    assert want and sum(r["count"] for r in count_file(spark, str(d / "x.fq"), 2).collect()) == 5


def test_fastq_blocks(tmp_path):
    """Any block size gives the records that a walk line by line gives."""
    import io

    r = random.Random(8)
    for n in range(40):
        lines = [r.choice(["@h", "@", "ACGT" * r.randrange(9), "+", "", "I@I", "é@", "@\r"]) for _ in range(r.randrange(30))]
        data = "\n".join(lines).encode() + r.choice([b"", b"\n", b"\xff\n@\xff\nA\xff"])
        walk, want = io.BytesIO(data), []
        while line := walk.readline():
            if line[:1] == b"@":
                seq = walk.readline()
                walk.readline(), walk.readline()
                want.append(tuple(x.removesuffix(b"\n").decode("utf-8", "replace") for x in (line[1:], seq)))
        for block in (1, 7, 1 << 20):
            assert [p for h, s in S._records(io.BytesIO(data), block) for p in zip(h.to_pylist(), s.to_pylist())] == want


def test_run_statistics(spark, tmp_path):
    p = tmp_path / "a.fq.gz"
    p.write_bytes(gzip.compress(b"@r\n" + b"A" * 260 + b"\n+\n" + b"I" * 260 + b"\n"))
    r = run_statistics(spark, str(p), 33).first()
    assert (r.k, r.words, r.entry_bytes, r.format, r.gzip, r.estimated_kmers, r.capacity) == (33, 2, 20, "fastq", True, 1_000_000, 1 << 21)
    assert (r.classes, r.windows, r.load_factor) == (1, 228, 1 / (1 << 21))


def test_one_record(spark, tmp_path):
    from strandline.plans.queries import one_record

    seqs = ["".join(random.Random(i).choice("abcdefg ") for _ in range(60)) for i in range(30)]
    spark.createDataFrame(list(enumerate(seqs)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    whole = "".join(seqs).replace(" ", "").upper().translate(str.maketrans(S.LETTERS, S.BASES))
    assert counts(one_record(spark, str(tmp_path))) == Counter(canon(w) for w in words(whole, 21))


def test_cli_counts(spark, tmp_path):
    from strandline import cli

    p = tmp_path / "a.fa"
    p.write_text(">t\nACGTACGTACGT\n")
    assert cli.main([str(p), "5", str(tmp_path / "out")]) == 0
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["ACGTA\t4", "CGTAC\t4"]


def sent(df):
    """Bytes that the one shuffle of a frame wrote."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        if node.metrics().contains("shuffleBytesWritten"):
            found.append(node.metrics().apply("shuffleBytesWritten").value())
        below = node.children()
        for i in range(below.size()):
            walk(below.apply(i))

    walk(plan)
    assert len(found) == 1
    return found[0]


def long_text(seed, n=400_000):
    return "".join(random.Random(seed).choices("ACGT", k=n))


@pytest.mark.parametrize("k,order", [(127, "lex"), (64, "reference"), (96, "reference"), (127, "reference"), (65, "reference"), (97, "reference")])
def test_shuffle_in_proportion_to_bases(spark, k, order):
    """A window sends less than two bytes, whatever k is, and the counts hold."""
    text = long_text(k)
    df = C.count_kmers(frame(spark, [text, text[:9000]]), k, order, partitions=3)
    assert 0 < sent(df) < 2 * len(text)
    assert {r.kmer: r["count"] for r in df.collect()} == Counter(canon(w, order) for s in (text, text[:9000]) for w in words(s, k))


def written(df, path):
    """Bytes and rows of a result's files."""
    df.write.parquet(str(path))
    return sum(p.stat().st_size for p in path.glob("*.parquet")), df.count()


@pytest.mark.parametrize("k", [96, 127, 65, 97])
def test_neighbours_share_bases_in_the_result(spark, tmp_path, k):
    """Words come in the order of the text, so files of them take few bytes a row; in the order of hashes half a byte a base."""
    text = long_text(k)
    size, rows = written(C.count_kmers(frame(spark, [text, text[:9000]]), k, partitions=3), tmp_path / "out")
    assert rows == len({canon(w) for w in words(text, k)}) and size < 20 * rows


def test_neighbours_share_bases_in_the_result_of_classes(spark, tmp_path):
    text = long_text(40)
    size, rows = written(C.count_classes(frame(spark, [text, text[:9000]]), 40, partitions=3), tmp_path / "out")
    assert rows == len({v4(w)[0] for w in words(text, 40)}) and size < 15 * rows


@pytest.mark.parametrize("k", [21, 31, 32, 33, 64, 127])
def test_stretches(spark, k, monkeypatch):
    """One word for a long run, periods, copies of texts, both strands, and a part that is merged in several passes."""
    r = random.Random(k)
    text = "".join(r.choices("ACGT", k=900))
    seqs = ["A" * 3000, "ACGGT" * 500, "AC" * 700 + "N" + "GT" * 300, text, text, rc(text), text[::-1], "a" * (k - 1), "acg" * k]
    for merge, parts in ((1 << 20, (1, 2)), (300, (1, 1)), (50, (4, 4))):
        monkeypatch.setattr(packed, "MERGE", merge)
        monkeypatch.setattr(packed, "STEP", 100)
        monkeypatch.setattr(packed, "PARTS", parts)
        for order in dna.ORDERS:
            assert counts(packed.count_packed(frame(spark, seqs), k, order=order, spread=3, chunk=401)) == Counter(canon(w, order) for s in seqs for w in words(s, k))
        want = {}
        for s in seqs:
            for w in words(s, k):
                word, tag = v4(w)
                want.setdefault(word, [0] * 4)[("I", "R", "C", "RC").index(tag)] += 1
        assert {x.class_kmer: list(x)[1:] for x in packed.count_classes_packed(frame(spark, seqs), k).collect()} == want


def test_merge_of_words_with_one_hash(monkeypatch):
    r = np.random.default_rng(1)
    lanes = [r.integers(0, 3, 500).astype(np.uint64) for _ in range(3)]
    want = Counter(zip(*(x.tolist() for x in lanes)))
    monkeypatch.setattr(packed, "_hash", lambda lanes, shift=0: lanes[0] << np.uint64(2))
    for tagged in (False, True):
        found, n = packed._merge(lanes, None, tagged)
        assert dict(zip(zip(*(x.tolist() for x in found)), n.tolist())) == want and len(n) == len(want)


def test_shuffle_of_classes_in_proportion_to_bases(spark):
    text = long_text(40)
    assert 0 < sent(C.count_classes(frame(spark, [text]), 40, partitions=3)) < 3 * len(text)


def test_fasta_is_read_block_by_block(spark, tmp_path, monkeypatch):
    """One record over many tasks, plain, and a gzip file: no row holds it."""
    text = long_text(4, 300_000)
    lines = "\n".join(text[i : i + 70] for i in range(0, len(text), 70))
    want = Counter(canon(w) for w in words(text, 21))
    monkeypatch.setattr(S, "read_fasta", None)  # holds a record as one row
    for name, data in (("a b,c.fa", f">all\n{lines}\n"), ("one.fa", f">all\n{text}"), ("z.fa.gz", f">all\n{lines}\n")):
        p = tmp_path / name
        p.write_bytes(gzip.compress(data.encode()) if name.endswith(".gz") else data.encode())
        assert counts(count_file(spark, str(p), 21, spread=9)) == want
    rows, dealt = S.read_windows(spark, str(tmp_path / "one.fa"), 21, "fasta", 1 << 16)
    assert dealt and rows.rdd.getNumPartitions() == 5 and max(len(r.seq) for r in rows.collect()) == 1 << 16


def test_fasta_stretches(tmp_path):
    """Any split, block and chunk gives each window of the records once."""
    r = random.Random(5)
    for _ in range(60):
        data = b"".join(r.choice([b"ACGTac", b"ACGTTGCA" * 5, b"\n", b"\n", b">", b">h x", b"\r\n", b"N", b"\xff"]) for _ in range(r.randrange(50)))
        records = [x.partition(b"\n")[2].replace(b"\n", b"").decode("latin-1") for x in data.split(b">")]
        for name in ("a.fa", "a.fa.gz"):
            (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith(".gz") else data)
            for k in (1, 3, 7):
                want = Counter(w for s in records for w in words(s.replace("\xff", "N"), k))
                for split, block, chunk in ((1, 3, 2), (5, 1, 100), (13, 7, 5), (1000, 1000, 1000)):
                    reader = S._FastaReader([(tmp_path / name).as_uri()], k, split, block, chunk)
                    assert Counter(w for p in reader.partitions() for b in reader.read(p) for s in b.column(0).to_pylist() for w in words(s, k)) == want
