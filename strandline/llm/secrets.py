"""Secret scans with multipart credential linking, in DataFrame operations only.

Base kinds (fixed by the contract): assign, access, hex. Weak kinds, which say nothing alone: ``name`` (an identifier
beside user, login, client_id, account), ``opaque`` (a run of 24 or more base64 letters with a capital, a small letter
and a digit) and ``endpoint`` (a URL or host with a port). A weak span is reported only if its scope has the spans that
make it part of a whole: for a name an endpoint and a secret, for an opaque an identifier (access or name), for an
endpoint an identifier and a secret. Secrets are assign, hex and opaque.

Scopes are the stretches of a text between blank lines, section lines like ``[name]``, headings and rules; a text
without these is one scope. The interval join of spans and scopes is a sweep: scope bounds and spans are put in order
of their starts, and the bounds passed number the scope a span lies in. No pair of spans is ever formed, so a text with
many costs no more than their sorts.

Positions: the pieces between matches and the matches themselves alternate, so running sums of their lengths are the
code-point positions. Patterns repeat groups only possessively: Java walks those in a loop, others on its stack, which
a long text would overflow.

Defined cases: a null text is an empty one, with no spans; equal rows give equal rows, once for each copy; spans of
different kinds may overlap; an empty table gives no rows; other columns are ignored; texts of any length are scanned
whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

KINDS = ("assign", "access", "hex", "name", "opaque", "endpoint")
CUT = len(KINDS)

# Base patterns, fixed by the contract; a run is matched whole, so its least length can stand in the pattern itself.
_VALUE = "[A-Za-z0-9+/_.=-]"
_ASSIGN = rf"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?{_VALUE}+"""
_ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
_ACCESS = "AKIA[A-Z0-9]{14,}"
_HEX = "[0-9a-f]{16,}"
_NAME = r"""(?i:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
_OPAQUE = r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z0-9+/_=-]*[A-Z])(?=[A-Za-z0-9+/_=-]*[a-z])(?=[A-Za-z0-9+/_=-]*[0-9])[A-Za-z0-9+/_=-]{24,}"
_ENDPOINT = r"(?:https?|s3|ftp|postgres|mysql|redis|amqp)://[^\x20\x09-\x0D\"'<>]+|(?<![A-Za-z0-9.-])[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++:[0-9]{2,5}(?![0-9])"
#: What ends a scope: the line feed before a blank line, a section line, a heading or a rule.
SCOPE = r"\n[ \t\r]*(?=\n)|\n[ \t]*\[[^\]\r\n]*\](?=[ \t\r]*(?![^\n]))|\n(?:-{3}|={3}|#{1,6} )"


def _matches(text: Column, kind: int, pattern: str, keep=None) -> Column:
    """Array of (kind, nth, gap, size, ok) of the pattern's matches, in order: the lengths of what stands before each and of itself; ``keep`` tests a match."""
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), (keep(m) if keep else F.lit(True)).alias("ok")))
    # There is one piece more than there are matches.
    found = F.transform(F.filter(pairs, lambda x: x["size"].isNotNull()), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), x["gap"].alias("gap"), x["size"].alias("size"), x["ok"].alias("ok")))
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array().cast("array<struct<kind:int,nth:int,gap:int,size:int,ok:boolean>>"))


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def find(df: DataFrame, key: str = "doc_id", text: str = "text", scope: str = SCOPE) -> DataFrame:
    """(key, base, spans): arrays of (start, kind, stop), sorted; kind counts in ``KINDS``."""
    t = F.col("t")
    rows = df.select(F.col(key).alias("k"), text_or_empty(text).alias("t"))
    long_value = lambda m: F.length(F.regexp_replace(m, _ASSIGN_HEAD, "")) >= 12
    base = F.concat(_matches(t, 0, _ASSIGN, long_value), _matches(t, 1, _ACCESS), _matches(t, 2, _HEX))
    weak = F.concat(_matches(t, 3, _NAME), _matches(t, 4, _OPAQUE), _matches(t, 5, _ENDPOINT))
    rows = rows.select("k", "t", base.alias("base"), weak.alias("weak"), F.monotonically_increasing_id().alias("row"))
    # Scopes matter only where there is a weak span. A text without matches keeps one row.
    found = F.when(F.size("weak") > 0, F.concat("base", "weak", _matches(t, CUT, scope))).otherwise(F.col("base"))
    one = rows.select("k", "row", F.explode_outer(found).alias("m")).select("k", "row", "m.*").repartition("row")
    along = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    one = one.withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(along).cast("int")).withColumn("start", F.col("stop") - F.col("size"))
    sweep = Window.partitionBy("row").orderBy("start", "kind", "nth").rowsBetween(Window.unboundedPreceding, 0)
    one = one.withColumn("scope", F.count(F.when(F.col("kind") == CUT, 1)).over(sweep))
    kind, inside = F.col("kind"), Window.partitionBy("row", "scope")
    roles = {"ident": kind.isin(1, 3), "secret": kind.isin(0, 2, 4), "endpoint": kind == 5}
    one = one.select("*", *[F.coalesce(F.max(F.col("ok") & test).over(inside), F.lit(False)).alias(f"has_{n}") for n, test in roles.items()])
    whole = F.when(kind == 3, F.col("has_endpoint") & F.col("has_secret")).when(kind == 4, F.col("has_ident")).when(kind == 5, F.col("has_ident") & F.col("has_secret")).otherwise(False)
    span = F.struct("start", "kind", "stop")
    linked = one.groupBy("row").agg(F.first("k").alias(key), F.sort_array(F.collect_list(F.when(F.col("ok") & (kind < 3), span))).alias("base"), F.sort_array(F.collect_list(F.when(F.col("ok") & ((kind < 3) | whole), span))).alias("spans"))
    return linked.select(key, "base", "spans")


def digest(df: DataFrame, key: str = "doc_id", text: str = "text", scope: str = SCOPE) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, and all spans as text."""
    rows = find(df, key, text, scope)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return rows.select(key, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
