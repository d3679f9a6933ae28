"""Removal of repeated runs of lines, in DataFrame operations only.

A text is a sequence of line ids. Distributed prefix doubling ranks the suffixes of all texts: rank k orders them by
their first 2**k lines, and the next ranks come from sorting the distinct pairs (rank at i, rank at i + 2**k). Suffixes
with an equal prefix of m lines are one interval of the suffix array, named by two overlapping ranks. The intervals
looked at are those of the shortest windows with ``min_words`` words, forwards from each line and backwards from each
line: a run with that many words occurs earlier if and only if all such windows inside it do, and they cover it, so
their union is the union of all maximal repeated runs. The lines of windows with an earlier copy are deleted.

``maximal_runs`` lists what the intervals reveal: windows that follow each other in two texts at the same distance are
one run, as long as the text and the first copy of its windows agree. ``repeated_runs`` merges these within each text.

A line's id has 128 bits, two hashes with different seeds. Tables that are grouped by a line or an interval are written
before they are joined by it, so that the join alone owns its shuffle and a line with very many copies is split.

Lines that occur once take no part, and stretches of repeated lines with too few words leave at once. "Earlier" goes
by key (nulls first), then by a hash of the text, then by line.

Defined cases: a null text is an empty one; rows that are equal in key and text are one text and are treated alike;
runs may overlap within a text; a text whose lines all go becomes empty; an empty table gives no rows; other columns
pass unchanged, whatever their names, but for those that have the names of the two counts, which they give way to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RE, Stored, spare, text_or_empty

#: Words that a repeated run has at least.
MIN_WORDS = 50


def _lines(df: DataFrame, key: str, text: str) -> DataFrame:
    rows = df.select(F.col(key).alias("d"), F.xxhash64(text_or_empty(text)).alias("t"), F.posexplode(F.split(text_or_empty(text), "\n", -1)).alias("pos", "line"))
    return rows.select("d", "t", "pos", F.struct(F.xxhash64("line").alias("a"), F.xxhash64(F.lit("line"), "line").alias("b")).alias("h"), F.regexp_count("line", F.lit(WORD_RE)).alias("w"))


def _stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """(d, t, start, h, w, sum): each stretch of lines that all occur elsewhere; sum is the running sum of w over the text."""
    place = F.struct(F.col("d"), F.col("t"), F.col("pos"))
    repeated = Stored(lines.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a != b").select("h"), "repeated").df
    live = lines.hint("merge").join(repeated.hint("merge"), "h").dropDuplicates(["d", "t", "pos"])
    order = Window.partitionBy("d", "t").orderBy("pos")
    live = live.withColumn("g", F.col("pos") - F.row_number().over(order)).withColumn("sum", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = live.groupBy("d", "t", "g").agg(F.min("pos").alias("start"), F.sum("w").alias("words"), F.sort_array(F.collect_list(F.struct("pos", "h", "w", "sum"))).alias("a"))
    # Not a.h and so on: the planner holds those for cheap and would take the whole array apart again at each use.
    apart = [F.expr(f"transform(a, x -> x.{n})").alias(n) for n in ("h", "w", "sum")]
    return out.where(F.col("words") >= min_words).select("d", "t", "start", *apart)


def _search(test: str, lo: str, hi: str) -> str:
    """SQL for the first place from lo to hi - 1 (else hi) where ``test``, in terms of mid, holds; false before it and true after."""
    mid = "cast((z.lo + z.hi) div 2 as int)"
    test = test.replace("mid", mid)
    step = f"if(z.lo >= z.hi, z, if({test}, named_struct('lo', z.lo, 'hi', {mid}), named_struct('lo', {mid} + 1, 'hi', z.hi)))"
    return f"aggregate(sequence(0, 31), named_struct('lo', {lo}, 'hi', {hi}), (z, q) -> {step}).lo"


def _ranked(spots: DataFrame, by: list[str]) -> tuple[DataFrame, Stored]:
    """spots with r: ranks of the columns ``by`` in their order, equal for equals, from a sort over all tasks."""
    ranks = Stored(spots.select(*by).distinct().orderBy(*by).withColumn("r", F.monotonically_increasing_id()), "ranks")
    return spots.join(ranks.df, by), ranks


def maximal_runs(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(d, t, sid, first, last, of): each run of lines of a text (key d, hash t) that is there before, from line ``first`` to
    ``last``, counted from 0; ``of`` is the place (d, t, pos) of its first copy. ``sid`` numbers the stretch it lies in."""
    lines = Stored(_lines(df, key, text), "lines")
    base = _stretches(lines.df, min_words)
    # The shortest windows forwards from i (f lines) and backwards from i (b lines) with enough words; 0: none.
    n = "size(h)"
    ahead = _search(f"sum[mid] - sum[i] + w[i] >= {min_words}", "i", n)
    behind = _search(f"sum[i] - sum[mid] + w[mid] < {min_words}", "0", "i + 1")
    base = base.withColumn("f", F.expr(f"transform(h, (x, i) -> if(sum[{n} - 1] - sum[i] + w[i] >= {min_words}, {ahead} - i + 1, 0))"))
    base = base.withColumn("b", F.expr(f"transform(h, (x, i) -> if(sum[i] - sum[0] + w[0] >= {min_words}, i - {behind} + 2, 0))"))
    state = Stored(base.withColumn("sid", F.monotonically_increasing_id()), "stretches")
    lines.drop()
    longest = state.df.agg(F.max(F.greatest(F.array_max("f"), F.array_max("b")))).first()[0] or 1
    top = longest.bit_length() - 1
    for k in range(top + 1):
        if k:
            half = 1 << k - 1
            pairs = f"transform(slice(r{k - 1}, 1, greatest(0, size(r{k - 1}) - {half})), (x, i) -> named_struct('x', x, 'y', r{k - 1}[i + {half}]))"
            spots = state.df.where(F.size("h") >= 2 * half).select("sid", F.posexplode(F.expr(pairs)).alias("i", "p")).select("sid", "i", "p.x", "p.y")
            ranked, ranks = _ranked(spots, ["x", "y"])
        else:
            ranked, ranks = _ranked(state.df.select("sid", F.posexplode("h").alias("i", "x")), ["x"])
        arrays = ranked.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("i", "r"))).alias("a")).select("sid", F.col("a.r").alias(f"r{k}"))
        old, state = state, Stored(state.df.join(arrays, "sid", "left"), "stretches")
        old.drop()
        ranks.drop()

    def named(start: str, m: str) -> str:
        """SQL for a window with its interval: its length and the ranks of its first and last 2**k lines, 2**k <= m < 2**(k+1)."""
        pick = " ".join(f"when {m} >= {1 << k} then named_struct('i', {start}, 'm', {m}, 'x', r{k}[{start}], 'y', r{k}[{start} + {m} - {1 << k}])" for k in range(top, -1, -1))
        return f"case {pick} end"

    found = f"filter(concat(transform(f, (m, i) -> {named('i', 'm')}), transform(b, (m, i) -> {named('(i - m + 1)', 'm')})), x -> x is not null)"
    wins = state.df.select("sid", "d", "t", "start", F.explode(F.expr(found)).alias("v")).select("sid", "d", "t", "start", F.struct("d", "t", (F.col("start") + F.col("v.i")).alias("pos")).alias("place"), "v.*")
    wins = Stored(wins.distinct(), "windows")
    first = Stored(wins.df.groupBy("m", "x", "y").agg(F.min("place").alias("a"), F.max("place").alias("z")).where("a != z").select("m", "x", "y", "a"), "intervals")
    later = wins.df.hint("merge").join(first.df.hint("merge"), ["m", "x", "y"]).where("place != a").select("d", "t", "sid", (F.col("start") + F.col("i")).alias("lo"), (F.col("start") + F.col("i") + F.col("m")).alias("hi"), "a")
    later = later.withColumn("far", F.col("a.pos") - F.col("lo"))
    runs = _islands(later, ["d", "t", "sid", F.col("a.d").alias("od"), F.col("a.t").alias("ot"), "far"])
    out = Stored(runs.select("d", "t", "sid", "first", "last", F.struct(F.col("od").alias("d"), F.col("ot").alias("t"), (F.col("first") + F.col("far")).alias("pos")).alias("of")), "matches")
    for old in (state, wins, first):
        old.drop()
    return out.df


def _islands(spans: DataFrame, by: list) -> DataFrame:
    """(by..., first, last): the spans from lo to hi - 1, merged where they overlap or touch."""
    spans = spans.select(*by, "lo", "hi")
    names = spans.columns[:-2]
    order = Window.partitionBy(*names).orderBy("lo", "hi")
    seen = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(seen >= F.col("lo"), 0).otherwise(1)).withColumn("g", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy(*names, "g").agg(F.min("lo").alias("first"), (F.max("hi") - 1).alias("last")).drop("g")


def repeated_runs(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(d, t, runs): for each text with deleted lines the sorted array of (first, last) line numbers, from 0, of its deleted runs."""
    found = maximal_runs(df, key, text, min_words)
    runs = _islands(found.select("d", "t", "sid", F.col("first").alias("lo"), (F.col("last") + 1).alias("hi")), ["d", "t", "sid"])
    return Stored(runs.groupBy("d", "t").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs")), "runs").df


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, lines: str = "n_lines", removed: str = "n_removed") -> DataFrame:
    """The rows of df with the later copies of repeated runs cut out of their text, and counts of their lines and of those removed."""
    runs = repeated_runs(df, key, text, min_words)
    names = [c for c in df.columns if c not in (lines, removed)]
    d, t, h, found, split = spare([*names, lines, removed], "_d", "_t", "_h", "_runs", "_lines")
    # Merged at every size: the runs grow with the table, so they are never a side to broadcast.
    r = runs.select(F.col("d").alias(d), F.col("t").alias(t), F.col("runs").alias(found)).hint("merge")
    joined = df.select(*names, F.xxhash64(text_or_empty(text)).alias(h))
    joined = joined.join(r, joined[key].eqNullSafe(r[d]) & (joined[h] == r[t]), "left")
    joined = joined.withColumn(split, F.split(text_or_empty(text), "\n", -1))
    # What stands before each deleted run, and after the last.
    before = f"transform({found}, (x, j) -> slice({split}, if(j = 0, 0, {found}[j - 1].last + 1) + 1, x.first - if(j = 0, 0, {found}[j - 1].last + 1)))"
    last = f"slice({split}, {found}[size({found}) - 1].last + 2, size({split}) - {found}[size({found}) - 1].last - 1)"
    kept = F.expr(f"if({found} is null, `{text}`, array_join(concat(flatten({before}), {last}), '\n'))")
    gone = F.expr(f"if({found} is null, 0, aggregate({found}, 0, (s, x) -> s + x.last - x.first + 1))").cast("long")
    return joined.select(*[kept.alias(c) if c == text else F.col(c) for c in names], F.size(split).cast("long").alias(lines), gone.alias(removed))
