"""The registered queries over the driver's tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna
from ..operators import count as C
from ..operators import windows as W
from ..operators.packed import count_packed
from ..sources.scratch import put, shared_dir
from ..sources.sequences import read_fasta, read_sequences, sequences_from_column
from ..sources.sinks import tsv_lines
from .golden import GOLDEN
from .runner import count_file, run_statistics

Query = Callable[[SparkSession, str], DataFrame]


def _seq(spark: SparkSession, d: str, table: str, col: str, adapter: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return sequences_from_column(spark.read.parquet(f"{d}/{table}.parquet"), col, adapter, keep)


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/sequences-{uuid.uuid4().hex[:12]}"


def _fasta(spark: SparkSession, d: str) -> DataFrame:
    seq = _seq(spark, d, "documents", "text", "mapped", ("doc_id",))
    return seq.select(F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit("\n"), F.coalesce("seq", F.lit(""))).alias("value"))


def fasta_roundtrip(spark: SparkSession, d: str, gzip: bool = False) -> DataFrame:
    path = _scratch(spark)
    _fasta(spark, d).write.option("compression", "gzip" if gzip else "none").text(path)
    return C.count_kmers(read_fasta(spark, path), 3)


def fastq_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark)
    seq = _seq(spark, d, "documents", "text", "mapped", ("doc_id",))
    s = F.coalesce("seq", F.lit(""))
    seq.select(F.concat(F.lit("@"), F.col("doc_id").cast("string"), F.lit("\n"), s, F.lit("\n+\n"), F.repeat(F.lit("I"), F.length(s))).alias("value")).write.text(path)
    return C.count_kmers(read_sequences(spark, path, "fastq"), 3)


def auto_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark)
    _fasta(spark, d).coalesce(1).write.text(path)
    return C.count_kmers(read_sequences(spark, path), 4)


def parser_rules(spark: SparkSession, d: str, gzip: bool = False) -> DataFrame:
    """Each small file of ``GOLDEN``, written and read: its counts, and a row without a word for its classes."""
    import gzip as gz

    folder, out = _scratch(spark), None
    for i, (name, text, k, order, _, _) in enumerate(GOLDEN):
        path = f"{folder}/{i}.txt{'.gz' if gzip else ''}"
        put(spark, path, gz.compress(text.encode()) if gzip else text.encode())
        rows = read_sequences(spark, path)
        found = C.count_kmers(rows, k, order, spread=2, partitions=2).unionByName(C.count_classes(rows, k, spread=2, partitions=2).agg(F.lit("").alias("kmer"), F.count("*").alias("count")))
        found = found.select(F.lit(name).alias("rule"), "kmer", "count")
        out = found if out is None else out.unionByName(found)
    return out


def one_record(spark: SparkSession, d: str, k: int = 21) -> DataFrame:
    """All texts as the wrapped lines of one FASTA record: read by one task, counted by many."""
    path = _scratch(spark)
    seq = _seq(spark, d, "documents", "text", "mapped", ("doc_id",)).where("seq != ''").coalesce(1).sortWithinPartitions("doc_id").select("seq")
    lines = spark.createDataFrame([(">all",)], "seq string").coalesce(1).unionByName(seq).coalesce(1)
    lines.write.text(path)
    return count_file(spark, path, k, "fasta")


def file_statistics(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark)
    _fasta(spark, d).write.text(path)
    return run_statistics(spark, f"{path}/*.txt", 5)


# DuckDB SQL ---------------------------------------------------------------------------------------------------------

_MAPPED = "translate(upper(regexp_replace({col}, '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC')"
_RUNS = "select {keep} translate(unnest(regexp_extract_all({text}, '[ACGTacgt]+')), 'acgt', 'ACGT') as run from {table}"


def _windows_sql(table: str, col: str, adapter: str, k: int, keep: str = "") -> str:
    text = _MAPPED.format(col=col) if adapter == "mapped" else col
    runs = _RUNS.format(text=text, table=table, keep=keep and keep + ",")
    return f"select {keep and keep + ','} substr(run, i, {k}) as w from (select {keep and keep + ','} run, unnest(range(1, length(run) - {k} + 2)) as i from ({runs}) where length(run) >= {k})"


def _rc(w: str) -> str:
    return f"reverse(translate({w}, 'ACGT', 'TGCA'))"


def _key(w: str, k: int) -> str:
    return " || ".join(f"reverse(substr({w}, {at}, {min(32, k - at + 1)}))" for at in range(1, k + 1, 32))


def _count_sql(table: str, col: str, adapter: str, k: int, order: str = "reference", keep: str = "") -> str:
    rc = _rc("w")
    canon = f"least(w, {rc})" if order == "lex" else f"case when {_key('w', k)} <= {_key(rc, k)} then w else {rc} end"
    comma = keep and keep + ", "
    return f"select {comma}kmer, count(*) as count from (select {comma}{canon} as kmer from ({_windows_sql(table, col, adapter, k, keep)})) group by {comma}kmer"


def _classes_sql(table: str, col: str, k: int) -> str:
    w = _windows_sql(table, col, "mapped", k)
    images = f"select w as i, reverse(w) as r, translate(w, 'ACGT', 'TGCA') as c, {_rc('w')} as rc from ({w})"
    keys = f"select *, {_key('i', k)} as ki, {_key('r', k)} as kr, {_key('c', k)} as kc, {_key('rc', k)} as krc from ({images})"
    best = f"select *, least(ki, kr, kc, krc) as best from ({keys})"
    tag = f"select case when ki = best then i when krc = best then rc when kc = best then c else r end as class_kmer, case when ki = best then 'I' when krc = best then 'RC' when kc = best then 'C' else 'R' end as t from ({best})"
    counters = ", ".join(f"count(*) filter (t = '{t}') as count_{t.lower()}" for t in ("I", "R", "C", "RC"))
    return f"select class_kmer, {counters} from ({tag}) group by class_kmer"


def _plain(k: int, adapter: str = "mapped", table: str = "documents", order: str = "reference", path: str = "auto") -> tuple[Query, str]:
    return (lambda s, d: C.count_kmers(_seq(s, d, table, "text", adapter), k, order, path=path)), _count_sql(table, "text", adapter, k, order)


_DOCS3 = _count_sql("documents", "text", "mapped", 3)
_RUN_SQL = "select page_id, cast(row_number() over (partition by page_id, n order by i) - 1 as integer) as run_idx, translate(run, 'acgt', 'ACGT') as run from (select page_id, n, unnest(r) as run, generate_subscripts(r, 1) as i from (select page_id, row_number() over () as n, regexp_extract_all(html, '[ACGTacgt]+') as r from pages))"
_POS = f"select item_id, cast(i - 1 as integer) as pos, substr(s, i, 5) as w from (select item_id, s, unnest(range(1, length(s) - 3)) as i from (select item_id, {_MAPPED.format(col='text')} as s from benchmark))"
_TRANSFORMS = f"select w as i, reverse(w) as r, translate(w, 'ACGT', 'TGCA') as c, {_rc('w')} as rc, {_key('w', 40)} as ref_key from ({_windows_sql('benchmark', 'text', 'mapped', 40)})"


def _transforms(s: SparkSession, d: str) -> DataFrame:
    w = W.windows(_seq(s, d, "benchmark", "text", "mapped"), 40)
    return w.select(*dna.transforms(F.col("w")), dna.ref_key(F.col("w"), 40).alias("ref_key"))


def _positions(s: SparkSession, d: str) -> DataFrame:
    runs = W.runs(_seq(s, d, "benchmark", "text", "mapped", ("item_id",)), keep=("item_id",)).drop("run_idx")
    return W.kmers(runs, 5, pos="pos").select("item_id", "pos", "w")


def _classes(s: SparkSession, d: str, k: int, table: str = "documents") -> DataFrame:
    return C.count_classes(_seq(s, d, table, "text", "mapped"), k)


def _compare(s: SparkSession, d: str) -> DataFrame:
    return C.compare(*(C.count_kmers(_seq(s, d, t, "text", "mapped"), 6) for t in ("documents", "conversations")))


_STATS = f"select count(*) as classes, coalesce(cast(sum((count_i + count_rc > 0)::int + (count_r + count_c > 0)::int) as bigint), 0) as output_rows, count(*) filter (greatest(count_i, count_r, count_c, count_rc) > 255) as overflow_classes, coalesce(cast(sum(count_i + count_r + count_c + count_rc) as bigint), 0) as windows from ({_classes_sql('documents', 'text', 5)})"

_RULES = "select * from (values " + ", ".join(f"('{n}', '{w}', {c}::bigint)" for n, _, _, _, counts, classes in GOLDEN for w, c in [*counts.items(), ("", classes)]) + ") as t(rule, kmer, count)"
_SIZE = f"select sum(3 + length(cast(doc_id as varchar)) + length(coalesce({_MAPPED.format(col='text')}, '')))::bigint as b from documents"
_FILE_STATS = f"""with e as (select least(greatest(b * 9 // 10 * 12 // 10, 1000000), 1024)::bigint as estimate from ({_SIZE}))
select 5::bigint as k, 1::bigint as words, 12::bigint as entry_bytes, 'fasta' as format, false as gzip, estimate as estimated_kmers, cast(2048 as bigint) as capacity, s.*, classes / 2048.0::double as load_factor from ({_STATS}) s, e"""

_ALL: dict[str, tuple[Query, str]] = {
    "kmer_count_natural_k3": _plain(3, "natural"),
    "kmer_count_mapped_k21": _plain(21),
    "kmer_count_k1": _plain(1),
    "kmer_count_k5": _plain(5),
    "kmer_count_text_k11": _plain(11, path="text"),
    "kmer_count_packed_k31": _plain(31, table="conversations", path="packed"),
    **{f"kmer_count_k{k}_reference": _plain(k) for k in (32, 33, 64, 65, 96, 97, 127)},
    **{f"kmer_count_k{k}_lex": _plain(k, order="lex") for k in (33, 127)},
    "kmer_count_text_k40": _plain(40, table="conversations", path="text"),
    "v4_class_counts_k5": (lambda s, d: _classes(s, d, 5), _classes_sql("documents", "text", 5)),
    "v4_class_counts_k21": (lambda s, d: _classes(s, d, 21), _classes_sql("documents", "text", 21)),
    "v4_class_counts_k40": (lambda s, d: _classes(s, d, 40), _classes_sql("documents", "text", 40)),
    "v4_class_counts_text_k9": (lambda s, d: C.count_classes(_seq(s, d, "conversations", "text", "mapped"), 9, path="text"), _classes_sql("conversations", "text", 9)),
    "v4_split_pairs_k5": (lambda s, d: C.split_classes(_classes(s, d, 5), 5), _count_sql("documents", "text", "mapped", 5)),
    "transforms_k40": (_transforms, _TRANSFORMS),
    "runs": (lambda s, d: W.runs(_seq(s, d, "pages", "html", "natural", ("page_id",)), keep=("page_id",)), _RUN_SQL),
    "window_positions": (_positions, _POS),
    "fasta_roundtrip_k3": (fasta_roundtrip, _DOCS3),
    "fasta_gzip_roundtrip_k3": (lambda s, d: fasta_roundtrip(s, d, True), _DOCS3),
    "fastq_roundtrip_k3": (fastq_roundtrip, _DOCS3),
    "auto_roundtrip_k4": (auto_roundtrip, _count_sql("documents", "text", "mapped", 4)),
    "kmer_tsv": (lambda s, d: tsv_lines(C.count_kmers(_seq(s, d, "documents", "text", "mapped"), 6)), f"select kmer || chr(9) || count as value from ({_count_sql('documents', 'text', 'mapped', 6)})"),
    "parser_rules": (parser_rules, _RULES),
    "parser_rules_gzip": (lambda s, d: parser_rules(s, d, True), _RULES),
    "run_statistics_k5": (file_statistics, _FILE_STATS),
    "run_stats_k5": (lambda s, d: C.stats(_classes(s, d, 5)), _STATS),
    "kmer_per_source_k4": (lambda s, d: C.count_kmers_by(_seq(s, d, "documents", "text", "mapped", ("source",)), 4, ("source",)), _count_sql("documents", "text", "mapped", 4, keep="source")),
    "kmer_spectrum_k9": (lambda s, d: C.spectrum(count_packed(_seq(s, d, "documents", "text", "mapped"), 9)), f"select count as multiplicity, count(*) as kmers from ({_count_sql('documents', 'text', 'mapped', 9)}) group by 1"),
    "kmer_compare_k6": (_compare, f"select kmer, coalesce(a.count, 0) as count_left, coalesce(b.count, 0) as count_right from ({_count_sql('documents', 'text', 'mapped', 6)}) a full join ({_count_sql('conversations', 'text', 'mapped', 6)}) b using (kmer)"),
}

#: Windows across the ends of texts: DuckDB would cut them out of one string, each from its start.
_NO_SQL: dict[str, Query] = {"one_record_k21": one_record}

QUERIES: dict[str, Query] = {k: v[0] for k, v in _ALL.items()} | _NO_SQL
SQL: dict[str, str] = {k: v[1] for k, v in _ALL.items()}
