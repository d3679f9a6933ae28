import random
import zlib

import numpy as np
import pytest

from strandline.llm import packing
from strandline.llm.bpe import Encoder, chunks


def _bins(patterns):
    return [sum(s * k for s, k in items) for items, count in patterns for _ in range(count)]


def _exact(sizes, cap):
    """The least number of bins, by search."""
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for r in {x for x in rooms if x >= sizes[i]}:
            j = rooms.index(r)
            go(i + 1, rooms[:j] + [r - sizes[i]] + rooms[j + 1 :])
        go(i + 1, [*rooms, cap - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(60))
def test_reduction_keeps_the_optimum(seed):
    rnd = random.Random(seed)
    cap = rnd.choice([10, 20, 37])
    sizes = [rnd.randint(1, cap) for _ in range(rnd.randint(1, 9))]
    hist = {s: sizes.count(s) for s in sizes}
    fixed, rest = packing.reduce_dominated(hist, cap)
    left = [s for s, c in rest.items() for _ in range(c)]
    assert sum(c for _, c in fixed) + (_exact(left, cap) if left else 0) == _exact(sizes, cap)


@pytest.mark.parametrize("seed", range(20))
def test_every_piece_has_one_gapless_place(seed):
    rnd = random.Random(seed)
    hist = {s: rnd.randint(1, 40) for s in rnd.sample(range(1, 1025), 60)}
    patterns = packing.solve(hist)
    used = {}
    for items, count in patterns:
        for s, k in items:
            used[s] = used.get(s, 0) + k * count
    assert used == hist and max(_bins(patterns)) <= 1024
    total = sum(s * c for s, c in hist.items())
    assert len(_bins(patterns)) <= 1.1 * -(-total // 1024) + sum(c for s, c in hist.items() if s > 512)
    lengths = np.array([s for s, c in hist.items() for _ in range(c)])
    ranks = np.concatenate([np.arange(c) for c in hist.values()])
    seq, off = packing.Layout(patterns).place(lengths, ranks)
    for q in np.unique(seq):
        at = 0
        for i in sorted(np.flatnonzero(seq == q), key=lambda i: off[i]):
            assert off[i] == at
            at += lengths[i]
        assert at <= 1024


def test_ids_equal_the_tokenizers():
    rnd = random.Random(5)
    alphabet = "ab '\n\t sdtlrevm012!?é ß'' 中😀\u0085\x1c\r Ⅷ²"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    texts += ["", " ", "it's we'll", "'s", " 's", "a'", "<|endoftext|> x", "\n\n x", "a  b "]
    e = Encoder()
    for lo, hi in chunks(texts, 500):
        ids, n = e.encode(texts[lo:hi])
        want = [x.ids for x in e.whole.encode_batch(texts[lo:hi], add_special_tokens=False)]
        assert [len(w) for w in want] == n.tolist() and sum(want, []) == ids.tolist()


def test_table(spark):
    rows = [(1, "a b " * 3000, 0), (2, None, 0), (3, "", 0), (3, "", 0), (4, "hello world", 1), (None, "x" * 50, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int").repartition(3)
    e = Encoder()
    got = packing.digest(df).collect()
    whole = packing.pack(df).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length) for r in got) == sorted((str(r.doc_id), r.piece, r.start, r.length) for r in whole)
    by_seq = {}
    for r in whole:
        text = next(t for i, t, _ in rows if i == r.doc_id) or ""
        ids = [*e.encode([text])[0].tolist(), 2]
        assert r.ids == ids[r.start : r.start + r.length]
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for r in got:
        text = next(t for i, t, _ in rows if i == r.doc_id) or ""
        ids = np.array([*e.encode([text])[0].tolist(), 2], "<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        assert (r.length == 1024) or r.piece == 0
    for places in by_seq.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 1024
    assert packing.digest(df.limit(0)).count() == 0


@pytest.mark.parametrize("first, then", [("\U00029e3d", "鸽"), (" \U00020041", " A")])
def test_characters_beyond_the_basic_plane_keep_their_own_ids(first, then):
    e = Encoder()
    for texts in ([first], [then], [first, then], [then, first]):
        ids, n = e.encode(texts)
        assert ids.tolist() == [i for t in texts for i in e.whole.encode(t, add_special_tokens=False).ids] and n.sum() == len(ids)


def test_added_tokens_as_a_plain_tokenizer_reads_them():
    from tokenizers import Tokenizer

    from strandline.llm.bpe import default_path

    plain = Tokenizer.from_file(default_path())
    texts = ["a b", "x<|endoftext|> y", "<|endoftext|>", "<|endoftext", "|> c"]
    ids, n = Encoder().encode(texts)
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == sum(want, []) and n.tolist() == [len(w) for w in want] and want[2] == [50256]
