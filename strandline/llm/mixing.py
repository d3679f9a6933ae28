"""Mixing sources to target weights by temperature.

Source s with token share p_s gets weight p_s**a / sum(p**a). The exponent a is found by sectioning [0, 1]: each round
evaluates the target at 65 exponents in one aggregate over the sources, so the sources never leave the cluster. The
target is an entropy of the weights (nats), or a limit on how often a source may be repeated.

The weights are realised under a token budget. A source that gets e epochs is taken whole floor(e) times and once more
up to the rest of its budget, each time in a new permutation: a row's place in it is a hash of its key and the epoch,
and the places are cut into blocks of about ``block_tokens``. Sums by block find the block where the budget ends, and
only that block is put in order, so a source of any size is spread over tasks.

Without a budget every row is taken at least once: the budget is the least that gives each source one epoch.

Defined cases: a null source is a source of its own; a null key counts as empty; rows that are equal in key and source
have the same places and go in or out together; a source without tokens is taken once; an empty table gives no rows;
columns of other names pass unchanged in ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RE, Stored, text_or_empty

#: Repetition limit of the registered query and the pipeline.
MAX_EPOCHS = 2.0
BLOCK_TOKENS = 1_000_000
#: Sources up to which their plan is broadcast; beyond it rows and plan are merged by source.
BROADCAST_SOURCES = 50_000
POINTS, ROUNDS = 65, 6
SPAN = 1 << 48


def count_words(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD_RE)).cast("long")


def _place(key: Column, epoch: Column, seed: int) -> Column:
    """A number below SPAN, by key and epoch."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("long")


def exponent(sources: DataFrame, budget: int | None = None, target_entropy: float | None = None, max_epochs: float | None = None) -> float:
    """The least exponent in [0, 1] that meets the target; 1 if none does. Both fall as it grows towards proportional weights."""
    if (target_entropy is None) == (max_epochs is None):
        raise ValueError("give either target_entropy or max_epochs")
    some = sources.where("tokens > 0").select(F.col("tokens").cast("double").alias("t"))
    total = some.agg(F.sum("t")).first()[0]
    if not total:
        return 1.0
    lo, hi = 0.0, 1.0
    p = F.col("t") / F.lit(total)
    for _ in range(ROUNDS):
        grid = [lo + (hi - lo) * i / (POINTS - 1) for i in range(POINTS)]
        if target_entropy is not None:
            z = [(F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.log(p) * F.lit(a))) for a in grid]
            values = [F.log(s) - m / s for s, m in z]
            limit = target_entropy
        else:
            ratios = [F.pow(p, F.lit(a - 1.0)) for a in grid]
            values = [F.max(r) / F.min(r) if budget is None else F.max(r) * F.lit(budget / total) / F.sum(F.pow(p, F.lit(a))) for r, a in zip(ratios, grid)]
            limit = max_epochs
        got = some.agg(*[v.alias(f"v{i}") for i, v in enumerate(values)]).first()
        ok = [i for i in range(POINTS) if got[i] <= limit + 1e-12]
        if not ok:
            return 1.0
        if ok[0] == 0:
            return grid[0]
        lo, hi = grid[ok[0] - 1], grid[ok[0]]
    return hi


def plan(rows: DataFrame, budget: int | None = None, target_entropy: float | None = None, max_epochs: float | None = None, seed: int = 0, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(s, tokens, weight, epochs, whole, blocks, cut): for each source of rows (k, s, n) how it is taken; cut is the first place left out of the last epoch."""
    sources = Stored(rows.groupBy("s").agg(F.sum("n").alias("tokens")), "sources").df
    a = exponent(sources, budget, target_entropy, max_epochs)
    live = F.col("tokens") > 0
    total = sources.agg(F.sum("tokens")).first()[0] or 1
    power = F.when(live, F.pow(F.col("tokens") / F.lit(float(total)), F.lit(a))).otherwise(0.0)
    each = F.when(live, F.pow(F.col("tokens") / F.lit(float(total)), F.lit(a - 1.0)))
    whole = sources.agg(F.sum(power).alias("z"), F.min(each).alias("least")).first()
    z, least = whole["z"] or 1.0, whole["least"] or 1.0
    times = each / F.lit(least) if budget is None else each * F.lit(budget / total / z)
    p = sources.select("s", "tokens", (power / F.lit(z)).alias("weight"), F.round(F.when(live, times).otherwise(1.0), 6).alias("epochs"))
    p = p.withColumn("whole", F.floor("epochs").cast("int")).withColumn("rest", F.floor((F.col("epochs") - F.col("whole")) * F.col("tokens") + 1e-6).cast("long"))
    p = Stored(p.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)).cast("long")), "weights").df
    # Where the last, partial epoch of each source ends.
    r = rows.join(_sized(p.where("rest > 0").select("s", "whole", "rest", "blocks")), "s").withColumn("at", _place(F.col("k"), F.col("whole"), seed)).withColumn("block", _block(F.col("at"), F.col("blocks")))
    sums = r.groupBy("s", "block").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"))
    before = F.sum("n").over(Window.partitionBy("s").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    edge = sums.withColumn("before", F.coalesce(before, F.lit(0))).where("before <= rest and before + n > rest").select("s", "block", "before")
    inside = r.join(edge, ["s", "block"]).withColumn("sum", F.col("before") + F.sum("n").over(Window.partitionBy("s", "block").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)))
    cut = inside.where("sum > rest").groupBy("s").agg(F.min("at").alias("cut"))
    return Stored(p.join(cut, "s", "left").select("s", "tokens", "weight", "epochs", "whole", "blocks", F.when(F.col("rest") == 0, 0).otherwise(F.coalesce("cut", F.lit(SPAN))).cast("long").alias("cut")), "plan").df


def _block(at: Column, blocks: Column) -> Column:
    return F.floor(at.cast("double") / F.lit(float(SPAN)) * blocks).cast("long")


def _sized(p: DataFrame) -> DataFrame:
    """The plan, to be broadcast if its sources are few."""
    return F.broadcast(p) if p.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else p


def _source(col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(col)), F.lit(""))


def _rows(df: DataFrame, key: str, source: str, tokens: Column) -> DataFrame:
    return Stored(df.select(F.col(key).alias("k"), _source(source).alias("s"), tokens.alias("n")), "tokens").df


def _taken(rows: DataFrame, p: DataFrame, key: str, seed: int) -> DataFrame:
    """rows (with s) once for each epoch they are in: adds _epoch, _place and _block."""
    out = rows.join(_sized(p.select("s", F.col("whole").alias("_whole"), F.col("blocks").alias("_blocks"), F.col("cut").alias("_cut"))), "s")
    out = out.withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_whole")))).withColumn("_place", _place(F.col(key), F.col("_epoch"), seed))
    return out.where("_epoch < _whole or _place < _cut").withColumn("_block", _block(F.col("_place"), F.col("_blocks")))


def _target(given: dict) -> dict:
    return given if {"target_entropy", "max_epochs"} & set(given) else {**given, "max_epochs": MAX_EPOCHS}


def schedule(df: DataFrame, key: str = "doc_id", source: str = "source", tokens: Column | None = None, seed: int = 0, **target) -> DataFrame:
    """(key, source, n_tokens, epoch, block, place): a row for each time a row is taken; epoch and place are the order of each source."""
    rows = _rows(df, key, source, count_words() if tokens is None else tokens)
    p = plan(rows, seed=seed, **_target(target))
    out = _taken(rows, p, "k", seed)
    return out.select(F.col("k").alias(key), F.when(F.col("s") != "", F.expr("substring(s, 2)")).alias(source), F.col("n").alias("n_tokens"), F.col("_epoch").cast("int").alias("epoch"), F.col("_block").alias("block"), F.col("_place").alias("place"))


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", tokens: Column | None = None, seed: int = 0, **target) -> DataFrame:
    """The rows of df with their columns, each as often as it is taken."""
    p = plan(_rows(df, key, source, count_words() if tokens is None else tokens), seed=seed, **_target(target))
    held = df.select(F.struct(*df.columns).alias("_row"), F.col(key).alias("_key"), _source(source).alias("s"))
    return _taken(held, p, "_key", seed).select("_row.*")
