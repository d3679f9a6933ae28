"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ctw, linecrf, linededup, matroska, mixing, ngramjoin, packing, preference, secrets, warc
from .common import table

SQL: dict[str, str] = {}


def op6_multipart_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op7_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.scores(table(spark, sf_dir, "documents"))


def op8_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digest(table(spark, sf_dir, "documents"))


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_pairs(preference.swapped_pairs(table(spark, sf_dir, "conversations")), dealt=("dealt",))


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(table(spark, sf_dir, "pages"))


def op3_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return linecrf.assess(docs, linecrf.train(docs, table(spark, sf_dir, "labels")))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.components(table(spark, sf_dir, "documents"), n=3, percent=90)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


_HEAD = "'<|im_start|>' || x.role || chr(10)"
_BODY = "replace(replace(x.text, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || '<|im_end|>' || chr(10)"


def _side_sql(s: str) -> str:
    rest = f"{s}_t[n + 1:]"
    return f"""coalesce(list_reduce(list_prepend('', list_transform({rest}, lambda x: {_HEAD} || {_BODY})), lambda a, b: a || b), '') as {s},
  array_to_string(list_transform({rest}, lambda x: cast(length({_HEAD}) as varchar) || ':0,' || cast(length({_BODY}) as varchar) || case when x.role = 'assistant' then ':1' else ':0' end), ',') as {s}_mask,
  cast(coalesce(list_sum(list_transform({rest}, lambda x: case when x.role = 'assistant' then length({_BODY}) else 0 end)), 0) as bigint) as {s}_train"""


SQL["op1_preference_format"] = f"""
with c as (select conv_id, turn, role, text from conversations where conv_id is not null),
last as (select conv_id, max(struct_pack(a := turn, b := text)) as m from c where role = 'assistant' group by 1),
t as (select conv_id as pair, 'chosen' as side, turn, role, text from c
  union all select c.conv_id, 'rejected', turn, role, case when role = 'assistant' and o.conv_id is not null and turn is not distinct from l.m.a and text is not distinct from l.m.b then o.m.b else text end
  from c left join last l on c.conv_id = l.conv_id left join last o on xor(c.conv_id, 1) = o.conv_id),
g as (select pair, coalesce(list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) order by turn nulls first, role, text) filter (side = 'chosen'), []) as chosen_t,
  coalesce(list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) order by turn nulls first, role, text) filter (side = 'rejected'), []) as rejected_t from t group by 1),
n as (select *, cast(len(list_filter(range(1, least(len(chosen_t), len(rejected_t)) + 1), lambda i: chosen_t[1:i] = rejected_t[1:i])) as bigint) as n from g)
select pair, n as n_prefix, coalesce(list_reduce(list_prepend('', list_transform(chosen_t[1:n], lambda x: {_HEAD} || {_BODY})), lambda a, b: a || b), '') as prompt,
  {_side_sql("chosen")},
  {_side_sql("rejected")}
from n
"""

SQL["op2_warc_index"] = """
with p as (select page_id, url, encode(coalesce(html, '')) as b from pages),
d as (select page_id, url, octet_length(b) as n, sha256(b) as h from p),
f as (select *, n >= 100 and row_number() over (partition by h order by page_id nulls last, url nulls first) > 1 as again, min(page_id) over (partition by h) as least from d)
select page_id, cast(n as bigint) as payload_bytes, h as payload_digest, case when again then 'revisit' else 'response' end as record_type, case when again then least end as refers_to from f
"""

#: The exponent has a closed form for a limit on repetition without a budget.
SQL["op3_temperature_mixing"] = r"""
with r as (select doc_id, coalesce('=' || source, '') as s, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as n from documents),
src as (select s, sum(n) as t from r group by 1),
tot as (select sum(t) as total, max(t) filter (t > 0) as mx, min(t) filter (t > 0) as mn from src),
al as (select case when mx = mn or mx / mn <= 2.0 then 0.0 else 1 - ln(2.0) / ln(mx / mn) end as a, total, mx from tot),
e as (select s, t, case when t > 0 then round(pow(t / mx, a - 1), 6) else 1.0 end as e from src, al),
p as (select s, t, cast(floor(e) as integer) as w, cast(floor((e - floor(e)) * t + 1e-6) as bigint) as rest, greatest(1, cast(ceil(t / 1000000) as bigint)) as blocks from e),
x as (select doc_id, source, s, n, w, rest, blocks, unnest(range(0, w + 1)) as epoch from r join p using (s)),
y as (select *, cast('0x' || substr(md5('0|' || epoch || '|' || coalesce(cast(doc_id as varchar), '')), 1, 12) as bigint) as place from x),
z as (select *, sum(n) over (partition by s, epoch order by place range unbounded preceding) as cum from y)
select doc_id, source, n as n_tokens, cast(epoch as integer) as epoch, cast(floor(place / 281474976710656.0 * blocks) as bigint) as block, place from z where epoch < w or (rest > 0 and cum <= rest)
""".replace("\\\\", "\\")

SQL["op9_ngram_jaccard_join"] = r"""
with recursive t as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x != '') as w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end) as g from t),
x as (select doc_id, unnest(g) as h, len(g) as n from s),
l as (select a.doc_id as u, b.doc_id as v from x a join x b on a.h = b.h and a.doc_id != b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r as (select doc_id as u, doc_id as v from s union select r.u, l.v from r join l on r.v = l.u)
select s.doc_id, cast(len(s.g) as bigint) as n_shingles, min(r.v) as component_id from s join r on s.doc_id = r.u group by s.doc_id, s.g
"""

_WORDS = r"len(regexp_extract_all({x}, '[^\x20\x09-\x0D]+'))"
#: Every window of lines with enough words, by its text: lines of windows with an earlier equal go.
SQL["op10_line_dedup"] = f"""
with d as (select row_number() over () as r, doc_id, text, string_split(coalesce(text, ''), chr(10)) as ls from documents),
u as (select distinct doc_id, text, ls from d),
w as (select doc_id, text, ls, list_transform(ls, lambda x: {_WORDS.format(x="x")}) as ws from u),
s as (select doc_id, text, ls, ws, unnest(range(len(ls))) as a from w),
e as (select doc_id, text, ls, a, unnest(range(a, len(ls))) as b, ws from s),
win as (select doc_id, text, a, b, md5(array_to_string(ls[a + 1:b + 1], chr(10))) as k, b - a as n from e where list_sum(ws[a + 1:b + 1]) >= 50),
first as (select k, n, min(struct_pack(d := doc_id, t := text, p := a)) as f from win group by k, n),
gone as (select distinct doc_id, text, unnest(range(a, b + 1)) as p from win join first using (k, n) where struct_pack(d := doc_id, t := text, p := a) != f),
g as (select doc_id, text, list(p) as ps from gone group by all)
select d.doc_id, case when g.ps is null then d.text else array_to_string(list_filter(d.ls, lambda x, i: not list_contains(g.ps, i - 1)), chr(10)) end as text,
  cast(len(d.ls) as bigint) as n_lines, cast(coalesce(len(g.ps), 0) as bigint) as n_removed
from d left join g on d.doc_id is not distinct from g.doc_id and d.text is not distinct from g.text
"""


QUERIES = {
    "op1_preference_format": op1_preference_format,
    "op2_warc_index": op2_warc_index,
    "op3_temperature_mixing": op3_temperature_mixing,
    "op4_line_crf": op4_line_crf,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_multipart_secrets": op6_multipart_secrets,
    "op7_context_tree_weighting": op7_context_tree_weighting,
    "op8_matroska": op8_matroska,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_line_dedup": op10_line_dedup,
}
