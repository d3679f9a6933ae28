import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from strandline.llm import mixing as m


def sources(spark, tokens):
    return spark.createDataFrame(list(tokens.items()), "s string, tokens long")


def test_exponent(spark):
    t = {"a": 1000, "b": 300, "c": 10, "d": 0}
    total = 1310
    for target in (0.9, 1.05):
        a = m.exponent(sources(spark, t), target_entropy=target)
        w = [(x / total) ** a for x in t.values() if x]
        w = [x / sum(w) for x in w]
        assert -sum(x * math.log(x) for x in w) == pytest.approx(target, abs=1e-8)
    a = m.exponent(sources(spark, t), max_epochs=3.0)
    assert (1000 / 10) ** (1 - a) == pytest.approx(3.0)
    a = m.exponent(sources(spark, t), budget=2620, max_epochs=4.0)
    w = [(x / total) ** a for x in t.values() if x]
    assert 2620 * w[2] / sum(w) / 10 == pytest.approx(4.0)
    assert m.exponent(sources(spark, t), target_entropy=math.log(3) + 1) == 0 and m.exponent(sources(spark, t), target_entropy=0.0) == 1
    assert m.exponent(sources(spark, {"d": 0}), max_epochs=2.0) == 1
    with pytest.raises(ValueError):
        m.exponent(sources(spark, t))


@pytest.mark.parametrize("few", [0, 50_000])
def test_schedule_by_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(m, "BROADCAST_SOURCES", few)
    r = random.Random(few)
    rows = [(i, " ".join("w" * r.randint(1, 30)), r.choice(["big"] * 12 + ["mid"] * 3 + ["low", None])) for i in range(150)]
    rows += [(200, None, "none"), (201, "", "none"), rows[0], (None, "a b c", "low")]
    df = spark.createDataFrame([(*x, 7) for x in rows], "doc_id long, text string, source string, epoch int").repartition(3)
    got = sorted((str(x.doc_id), str(x.source), x.n_tokens, x.epoch, x.place) for x in m.schedule(df, block_tokens=9).collect())
    tok = {}
    for i, t, s in rows:
        tok[s] = tok.get(s, 0) + len((t or "").split())
    live = [x for x in tok.values() if x]
    ratio = max(live) / min(live)
    a = 1 - math.log(2) / math.log(ratio) if ratio > 2 else 0
    want = []
    place = lambda i, e: int(hashlib.md5(f"0|{e}|{'' if i is None else i}".encode()).hexdigest()[:12], 16)
    for s, n in tok.items():
        e = round((n / max(live)) ** (a - 1), 6) if n else 1.0
        whole = int(e)
        rest = math.floor((e - whole) * n + 1e-6)
        for ep in range(whole + 1):
            own = sorted((place(i, ep), i, len((t or "").split())) for i, t, x in rows if x == s and i is not None) + [(place(None, ep), None, 3)] * (s == "low")
            own.sort(key=lambda x: x[0])
            for p, i, k in own:
                if ep < whole or rest and sum(z for q, _, z in own if q <= p) <= rest:
                    want.append((str(i), str(s), k, ep, p))
    assert got == sorted(want)
    mixed = m.mix(df, block_tokens=9)
    assert mixed.columns == df.columns and mixed.count() == len(want)
    assert m.mix(df.limit(0)).count() == 0 and m.schedule(df, budget=10, target_entropy=1.0).agg(F.sum("n_tokens")).first()[0] <= 10
