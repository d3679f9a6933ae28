import random

import pytest

from strandline.llm import matroska as m


@pytest.mark.parametrize("n", [0, 1, 64, 511, 512, 513, 4096, 4160, 200_000])
def test_round_trip(n):
    data = random.Random(n).randbytes(n)
    media = m.encode(m.pad(data))
    x = m.parse(media)
    assert b"".join(media[p[2] : p[2] + p[3]] for p in x["packets"]) == m.pad(data)
    assert [p[1] for p in x["packets"]] == [i * 64 * 10**6 for i in range(len(x["packets"]))]
    assert len(x["cues"]) == x["clusters"] and all(c[2] for c in x["cues"])
    assert x["tracks"][1]["rate"] == 8000 and x["tracks"][1]["depth"] == 8


@pytest.mark.parametrize("mode", [m.XIPH, m.FIXED, m.EBML_LACE])
@pytest.mark.parametrize("seed", range(10))
def test_laces(mode, seed):
    r = random.Random(seed)
    k = r.randint(2, 9)
    size = r.randint(0, 3000)
    frames = [r.randbytes(size if mode == m.FIXED else r.randint(0, 3000)) for _ in range(k)]
    block = b"\x82" + b"\x00\x05" + bytes([mode << 1]) + m.lace(frames, mode)
    track, rel, _, spans = m.unlace(block, 0, len(block))
    assert (track, rel) == (2, 5) and [block[o : o + s] for o, s in spans] == frames


def test_unknown_sizes_groups_and_void():
    block = b"\x81\x00\x01\x00abc"
    cluster = m._id(m.CLUSTER) + b"\x01" + b"\xff" * 7 + m.uint(m.TIMESTAMP, 7) + m.element(m.BLOCK_GROUP, m.element(m.BLOCK, block)) + m.element(0xEC, b"zz")
    media = m._HEAD + m._id(m.SEGMENT) + b"\x01" + b"\xff" * 7 + m._TRACKS + cluster + cluster
    x = m.parse(media)
    assert [(p[1], media[p[2] : p[2] + p[3]]) for p in x["packets"]] == [(8 * 10**6, b"abc")] * 2


def test_columns(spark):
    df = spark.createDataFrame([(1, "x" * 9000, b"q"), (2, None, None), (2, "é", None), (None, "", None)], "doc_id long, text string, media binary")
    enc = m.encode_column(df)
    assert enc.columns == ["doc_id", "text", "media"]
    packets = m.packet_table(enc, "doc_id").collect()
    assert sum(p["size"] for p in packets if p.doc_id == 1) == 9024 and all(p.mkv_error is None for p in packets)
    broken = m.packet_table(df, "doc_id").collect()
    assert len(broken) == 4 and all(p.mkv_error for p in broken)
    rows = m.digest(df).collect()
    assert [r.n_bytes for r in rows] == [9000, 0, 2, 0] and all(r.payload_bytes % 64 == 0 and r.payload_bytes > 0 for r in rows)
    assert rows[1].media_sha256 == rows[3].media_sha256 and rows[1].payload_bytes == 64
    assert m.digest(df.limit(0)).count() == 0
