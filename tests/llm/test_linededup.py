import random

import pytest

from strandline.llm import linededup


def truth(rows, min_words):
    """Every window of lines that has an earlier equal one, by trying all."""
    docs = sorted({(k is not None, k or 0, t or "") for k, t in rows})
    seen, gone = {}, {d: set() for d in docs}
    wins = []
    for d in docs:
        ls = d[2].split("\n")
        for a in range(len(ls)):
            for b in range(a, len(ls)):
                if sum(len(x.split()) for x in ls[a : b + 1]) >= min_words:
                    wins.append((tuple(ls[a : b + 1]), (d, a)))
    for k, p in wins:
        seen[k] = min(seen.get(k, p), p)
    for k, p in wins:
        if p != seen[k]:
            gone[p[0]].update(range(p[1], p[1] + len(k)))
    out = []
    for k, t in rows:
        ls, g = (t or "").split("\n"), gone[k is not None, k or 0, t or ""]
        out.append((k, "\n".join(x for i, x in enumerate(ls) if i not in g) if g else t, len(ls), len(g)))
    return out


@pytest.mark.parametrize("seed,min_words", [(1, 1), (2, 6)])
def test_against_all_windows(spark, seed, min_words):
    r = random.Random(seed)
    pool = [" ".join(r.choice("abcdefg") for _ in range(r.randint(0, 4))) for _ in range(14)] + [""]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 18)))) for i in range(40)]
    rows += [(50 + i, rows[i][1]) for i in range(5)] + [rows[3], (None, rows[4][1]), (60, None), (61, ""), (62, "q q q q q q q"), (63, "\n".join(["z z z"] * 9))]
    df = spark.createDataFrame([(k, "x", t, 1, 2, 3) for k, t in rows], "doc_id long, h string, text string, n_lines int, _d int, _Runs int").repartition(3)
    got = linededup.dedup_lines(df, min_words=min_words)
    assert got.columns == ["doc_id", "h", "text", "_d", "_Runs", "n_lines", "n_removed"]
    assert sorted(map(str, [(x.doc_id, x.text, x.n_lines, x.n_removed) for x in got.collect()])) == sorted(map(str, truth(rows, min_words)))


def test_empty(spark):
    assert linededup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_maximal_runs(spark):
    a, b = [f"alpha {i} x y z" for i in range(8)], [f"beta {i} x y z" for i in range(9)]
    texts = ["\n".join([*a, "one", *b]), "\n".join(["two", *a[1:7], "three", *b]), "\n".join(b[:8]), "\n".join(a[6:] + b[:2])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = linededup.maximal_runs(df, min_words=20).collect()
    got = {(x.d, x.first, x.last, x.of.d, x.of.pos) for x in found}
    assert got == {(1, 1, 6, 0, 1), (1, 8, 16, 0, 9), (2, 0, 7, 0, 9)}
    for x in found:
        assert texts[x.d].split("\n")[x.first : x.last + 1] == texts[x.of.d].split("\n")[x.of.pos : x.of.pos + x.last - x.first + 1]
    kept = {x.doc_id: x.text for x in linededup.dedup_lines(df, min_words=20).collect()}
    assert kept == {0: texts[0], 1: "two\nthree", 2: "", 3: texts[3]}


def test_very_long_texts(spark):
    """A line of a megabyte, a hundred thousand lines, and one line that all texts share."""
    long = "word " * 200_000
    many = "\n".join(f"line {i} of a text" for i in range(100_000))
    rows = [(0, long), (1, "x\n" + long), (2, many), (3, many + "\nend"), (4, "\n" * 50_000)] + [(10 + i, f"{i}\nshared line\n{i + 1000}") for i in range(500)]
    got = {x.doc_id: x for x in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[0].n_removed, got[1].text, got[2].n_removed, got[3].text) == (0, "x", 0, "end")
    assert got[4].n_removed == 0 and all(got[10 + i].n_removed == 0 for i in range(500))
