import random

from strandline.llm import preference as m


def truth(rows):
    out = {}
    for p in {r[0] for r in rows if r[0] is not None and r[1] in m.SIDES}:
        side = {s: [(r[3] or "", r[4] or "") for r in sorted((r for r in rows if r[0] == p and r[1] == s), key=lambda r: (r[2] is not None, r[2] or 0, r[3] or "", r[4] or ""))] for s in m.SIDES}
        n = 0
        while n < min(map(len, side.values())) and side["chosen"][n] == side["rejected"][n]:
            n += 1
        body = lambda t: t.replace(m.START, "<| im_start|>").replace(m.END, "<| im_end|>") + m.END + "\n"
        head = lambda r: f"{m.START}{r}\n"
        show = lambda ts: "".join(head(r) + body(t) for r, t in ts)
        row = [n, show(side["chosen"][:n])]
        for s in m.SIDES:
            rest = side[s][n:]
            row += [show(rest), ",".join(f"{len(head(r))}:0,{len(body(t))}:{int(r == 'assistant')}" for r, t in rest), sum(len(body(t)) for r, t in rest if r == "assistant")]
        out[p] = row
    return out


def test_by_definition(spark):
    r = random.Random(2)
    rows = []
    for p in range(60):
        base = [(i, "user" if i % 2 == 0 else "assistant", r.choice(["hi", "é中", "a b", m.END, ""])) for i in range(r.randint(0, 6))]
        for s in m.SIDES:
            for i, role, t in base:
                rows.append((p, s, i, role, t if r.random() < 0.85 else r.choice([None, "x", "y"])))
                if r.random() < 0.1:
                    rows.append((p, s, r.choice([i, None]), r.choice(["tool", None]), "z"))
    rows += [rows[5], (None, "chosen", 0, "user", "q"), (3, None, 0, "user", "q"), (3, "other", 0, "user", "q"), (99, "chosen", 0, "assistant", "only")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "pair long, side string, turn long, role string, text string, n_prefix int")
    got = {x.pair: list(x)[1:] for x in m.format_pairs(df).collect()}
    assert got == truth(rows)
    assert m.format_pairs(df.limit(0)).count() == 0


def test_swapped(spark):
    rows = [(0, 0, "user", "Q0"), (0, 1, "assistant", "A0"), (1, 0, "user", "Q1"), (1, 1, "assistant", "A1"), (1, 2, "user", "Q2"), (2, 0, "user", "Q3"), (4, 0, "assistant", "A4"), (None, 0, "assistant", "A5"),
            (6, 0, "user", None), (6, 1, "assistant", "A6"), (6, 1, "assistant", "A6"), (6, 1, "assistant", ""), (7, None, "assistant", None), (-1, 0, "assistant", "A8"), (-2, 0, "assistant", "A9")]
    df = spark.createDataFrame([(*x, 1, "x") for x in rows], "conv_id long, turn long, role string, text string, dealt int, even string")
    found = m.format_pairs(m.swapped_pairs(df), dealt=("dealt",)).collect()
    got = {x.pair: x for x in found}
    assert len(found) == len(got) and set(got) == {0, 1, 2, 4, 6, 7, -1, -2} and got[0].n_prefix == got[1].n_prefix == 1
    assert "A0" in got[0].chosen and "A1" in got[0].rejected and "A0" not in got[0].rejected and "Q0" in got[0].prompt
    assert "Q2" in got[1].chosen and "Q2" in got[1].rejected and got[1].chosen_train == len("A1<|im_end|>\n")
    # No reply on either side: all is prompt.
    assert "Q3" in got[2].prompt and got[2].chosen == got[2].rejected == "" and "A4" in got[4].prompt and got[4].rejected_train == 0
    assert got[6].chosen.count("A6") == 2 and "A6" not in got[6].rejected and "A6" in got[7].rejected and got[7].rejected_train == len("A6<|im_end|>\n")
    assert "A9" in got[-1].rejected and "A8" in got[-2].rejected
    assert all((x.chosen == "") == (x.rejected == "") for x in found)
    assert m.format_pairs(m.swapped_pairs(df.limit(0))).count() == 0


def test_registered_sql(spark):
    import duckdb

    from strandline.llm import queries

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{folder}/conversations.parquet'")
    want = con.sql(queries.SQL["op1_preference_format"])
    names = sorted(want.columns)
    got = queries.QUERIES["op1_preference_format"](spark, folder)
    assert sorted(got.columns) == names
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.project(", ".join(names)).fetchall())


def test_long_conversation(spark):
    """One conversation with many long turns."""
    rows = [(0, i, "assistant" if i % 2 else "user", f"{i} " + "x" * 2000) for i in range(3000)] + [(1, 0, "assistant", "END")]
    got = {x.pair: x for x in m.format_pairs(m.swapped_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), dealt=("dealt",)).collect()}
    assert got[0].n_prefix == 2999 and "END" in got[0].rejected and got[0].prompt.count("<|im_end|>") == 2999
