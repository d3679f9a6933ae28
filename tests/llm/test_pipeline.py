import os
from collections import Counter

import pytest

import corpus_pipeline
from strandline.llm import linecrf
from test_linededup import truth as cut_lines
from test_ngramjoin import truth as components

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_stages_by_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)

    def go(name, rows):
        stage[name](spark, rows, SF).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    good = go("quality_rules", docs)
    assert good.schema.names == docs.columns
    model = linecrf.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in linecrf.assess(docs, model).where("kept").collect()}
    cut = go("line_dedup", good)
    assert cut.columns == docs.columns
    want = cut_lines([(r.doc_id, r.text) for r in good.collect()], 50)
    assert {(r.doc_id, r.text, r.n_chars) for r in cut.collect()} == {(k, t, len(t)) for k, t, n, gone in want if gone < n}
    near = go("ngram_jaccard_join", cut)
    want = components([(r.doc_id, r.text) for r in cut.collect()], 5, 80)[0]
    assert sorted(r.doc_id for r in near.collect()) == sorted({c for _, _, c in want}) and near.columns == docs.columns
    mixed = go("temperature_mixing", near)
    times = Counter(r.doc_id for r in mixed.collect())
    assert set(times) == {r.doc_id for r in near.collect()} and max(times.values()) <= 2 and mixed.columns == docs.columns
    packed = go("best_fit_packing", mixed).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == times
    rooms = {}
    for r in packed:
        rooms.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in rooms.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 1024


def test_edges(spark, tmp_path):
    """Nulls in every column, empty texts, repeated rows, clashing names, no labels; and no rows at all."""
    import random

    r = random.Random(2)
    prose = lambda: ". ".join(" ".join(f"w{r.randrange(4000)}" for _ in range(12)) for _ in range(9)) + "."
    own, copy = prose(), prose()
    rows = [(0, own, "en", "a", 1, 5, 6), (1, copy, None, None, None, None, None), (2, copy, "en", "a", 3, 1, 1), (2, copy, "en", "a", 3, 1, 1), (3, None, "en", "a", 0, 1, 1), (4, "", "en", "b", 0, 1, 1), (None, prose(), "en", "b", 2, 1, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _d int, _SA int"
    for name, data in (("some", rows), ("none", [])):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        docs = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path / name))
            assert out.columns == docs.columns
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        ids = {x.doc_id for x in got}
        assert ids == ({0, 1, None} if data else set())
