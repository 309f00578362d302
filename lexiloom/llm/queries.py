"""The queries of this subpackage's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontaminate, jaccard, lines, pii, quality, secrets, suffixtree, vectors
from .common import table


def op1_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = secrets.samples(spark, table(spark, sf_dir, "benchmark"))
    return secrets.secrets(table(spark, sf_dir, "documents"), secrets.trained(labelled))


def op2_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeats(table(spark, sf_dir, "documents"), whole=True)


#: Units are grouped by their normal forms instead of digests; the cuts are marked with a character that texts don't hold.
_WS = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_NORM = f"trim(regexp_replace(lower({{0}}), '{_WS.replace('{', '{{').replace('}', '}}')}', ' ', 'g'))"
OP2_SQL = rf"""
with b as (
  select doc_id, string_split(regexp_replace(coalesce(text, ''), '(\n(?:[ \t\r]*\n)+)', chr(1) || '\1' || chr(1), 'g'), chr(1)) as p from documents
), blocks as (
  select doc_id, p[i] as block, coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(x))), 0)::bigint as paragraph from (select doc_id, p, unnest(range(1, len(p) + 1, 2)) as i from b)
), lines as (
  select doc_id, paragraph, l[i] as line, (paragraph + coalesce(list_sum(list_transform(l[1:i - 1], lambda x: length(x) + 1)), 0))::bigint as start
  from (select doc_id, paragraph, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, paragraph, string_split(block, chr(10)) as l from blocks))
), cuts as (
  select doc_id, paragraph, start as line, s[i] as sentence, (start + coalesce(list_sum(list_transform(s[1:i - 1], lambda x: length(x))), 0))::bigint as start
  from (select doc_id, paragraph, start, s, unnest(range(1, len(s) + 1, 2)) as i
    from (select *, string_split(regexp_replace(line, '([.!?])([ \t]+)', '\1' || chr(1) || '\2' || chr(1), 'g'), chr(1)) as s from lines) where len(s) > 1)
), units as (
  select doc_id, paragraph as start, paragraph + length(block) as "end", {_NORM.format('block')} as norm, 0 as kind, paragraph as line, paragraph
  from blocks where contains(regexp_replace(block, '^{_WS}|{_WS}$', '', 'g'), chr(10))
  union all select doc_id, start, start + length(line), {_NORM.format('line')}, 1, start, paragraph from lines where {_NORM.format('line')} <> ''
  union all select doc_id, start, start + length(sentence), {_NORM.format('sentence')}, 2, line, paragraph from cuts where len(string_split({_NORM.format('sentence')}, ' ')) >= 8
), found as (
  select u.*, f.d as first_doc_id, f.s as first_start
  from units u join (select norm, min((doc_id, start)) as first, first[1] as d, first[2] as s from units group by norm having min((doc_id, start)) <> max((doc_id, start))) f on u.norm = f.norm
  where not (u.doc_id = f.d and u.start = f.s)
), outer_lines as (
  select * from found f where kind < 2 or not exists (select 1 from found o where o.kind = 1 and o.doc_id = f.doc_id and o.start = f.line)
)
select doc_id, start, "end", first_doc_id, first_start
from outer_lines f where kind < 1 or not exists (select 1 from found o where o.kind = 0 and o.doc_id = f.doc_id and o.start = f.paragraph)
"""


def op3_tool_call_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations table has no tool calls of its own: its turns are read as calls and results."""
    return chat.linked(*chat.exchanges(table(spark, sf_dir, "conversations")))


OP3_SQL = """
with calls as (
  select conv_id, 'turn-' || turn as call_id, turn, case role when 'user' then 'reply' else 'instruct' end as name, text
  from conversations where role in ('user', 'system')
), results as (
  select conv_id, 'turn-' || (turn - 1) as call_id, text as content from conversations where role = 'assistant'
), chain as (
  select *, turn - 2 * row_number() over (partition by conv_id, turn % 2 order by turn) as run from calls
), level as (
  select *, row_number() over (partition by conv_id, turn % 2, run order by turn) - 1 as level from chain
), joined as (
  select coalesce(c.conv_id, r.conv_id) as conv_id, coalesce(c.call_id, r.call_id) as call_id, c.level, c.name, c.text, r.content,
    case when c.call_id is null then 'orphan' when r.call_id is null then 'pending' else 'linked' end as status
  from level c full outer join results r on c.conv_id = r.conv_id and c.call_id = r.call_id
)
select conv_id, call_id, level, status, case when status <> 'orphan' then '' end as errors,
  '{"arguments":' || case when status = 'orphan' then 'null' else '{"prompt":' || to_json(text) || '}' end || ',"conversation":' || conv_id
  || ',"errors":' || case when status = 'orphan' then 'null' else '[]' end || ',"id":' || to_json(call_id) || ',"level":' || coalesce(level::varchar, 'null')
  || ',"name":' || coalesce(to_json(name)::varchar, 'null') || ',"result":' || coalesce(to_json(content)::varchar, 'null') || ',"status":"' || status || '"}' as record
from joined
"""


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: All pairs of documents that share a shingle: for tables of the correctness run's size.
OP5_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end) as s from w
), n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by all),
e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 75 * (a.n + b.n - c)),
both_ways as (select x, y from e union all select y, x from e),
reached(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, b.y from reached r join both_ways b on b.x = r.other)
select d.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(other) as component_id from documents d join reached r on r.doc_id = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id
"""


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), e as (select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.98),
reached(vec_id, other) as (select vec_id, vec_id from embeddings union select r.vec_id, e.y from reached r join e on e.x = r.other),
c as (select vec_id, min(other) as component_id from reached group by vec_id)
select c.vec_id, (select count(*) from e where e.x = c.vec_id) as n_links, component_id, c.vec_id = component_id as kept from c
"""


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_kept_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.model_of(documents, table(spark, sf_dir, "labels"))
    return quality.graded(documents, model, keep=quality.KEEP).select("doc_id", "expected_grade", "p_highest")


def op8_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op10_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.scored(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_secret_spans": op1_secret_spans,
    "op2_repeated_lines": op2_repeated_lines,
    "op3_tool_call_links": op3_tool_call_links,
    "op4_benchmark_leaks": op4_benchmark_leaks,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_near_vectors": op6_near_vectors,
    "op7_kept_documents": op7_kept_documents,
    "op8_bpe_tokens": op8_bpe_tokens,
    "op9_personal_data": op9_personal_data,
    "op10_suffix_tree_scores": op10_suffix_tree_scores,
}

ORACLE_SQL: dict[str, str] = {"op2_repeated_lines": OP2_SQL, "op3_tool_call_links": OP3_SQL, "op5_near_duplicates": OP5_SQL, "op6_near_vectors": OP6_SQL}
