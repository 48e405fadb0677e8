"""Queries: lexical, vector and graph retrieval, fusion, selection, coverage, snippets, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata import config as C
from lodestrata.functions import text as T
from lodestrata.operators import chat, retrieval, selection
from lodestrata.plans.registry import load, query

#: BM25 of all benchmark questions over all documents, as DuckDB common table expressions that end in ``top``.
_BM25 = """
dt as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_./:+-]+'))) as tok from documents),
st as (select doc_id, t as term from (select doc_id, unnest(string_split_regex(tok, '[_./:+-]+')) as t from dt) where t <> ''),
tf as (select doc_id, term, count(*) as tf from st group by all),
dl as (select doc_id, count(*) as dl from st group by all),
n as (select count(*) as n, (select count(*) from st) / count(*)::double as avgdl from documents),
q as (select item_id as query_id, unnest(list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, 12)) as tok
      from (select item_id, regexp_extract_all(lower(text), '[a-z0-9_./:+-]+') as l from benchmark)),
qt as (select query_id, t as term, count(*) as times from (select query_id, unnest(string_split_regex(tok, '[_./:+-]+')) as t from q) where t <> '' group by all),
df as (select term, count(*) as df from tf group by all),
scored as (select query_id, doc_id, sum(times * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score
      from qt join tf using (term) join df using (term) join dl using (doc_id) cross join n group by all),
ranked as (select *, cast(row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as integer) as rank from scored)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def lexical_top(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    return retrieval.ranked(retrieval.bm25(load(spark, sf_dir, "documents"), questions(spark, sf_dir)), limit)


@query(f"with {_BM25} select query_id, doc_id, rank, round(score, 6) as score from ranked where rank <= 20")
def bm25_topk(spark, sf_dir):
    return lexical_top(spark, sf_dir, C.TOP_K).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query("""
select doc_id, len(list_distinct(l)) as n_tokens, (select count(*) from (select unnest(flatten(list_transform(list_distinct(l), lambda x: string_split_regex(x, '[_./:+-]+')))) as t) where t <> '') as n_terms
from (select doc_id, regexp_extract_all(lower(text), '[a-z0-9_./:+-]+') as l from documents)""")
def lexical_terms(spark, sf_dir):
    tokens = T.lexical_tokens(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.size(T.index_terms(tokens)).cast("long").alias("n_terms"))


@query(f"with {_BM25}, u as (select count(distinct term) as n_terms from st) select n as n_docs, (select count(*) from st) as total_terms, round(avgdl, 6) as avgdl, n_terms from n cross join u")
def corpus_stats(spark, sf_dir):
    rows = retrieval.corpus(load(spark, sf_dir, "documents"), "doc_id", "text")
    totals = rows.agg(F.count("*").alias("n_docs"), F.sum("dl").alias("total_terms"), F.round(F.avg("dl"), 6).alias("avgdl"))
    return totals.join(F.broadcast(rows.select(F.explode("terms").alias("t")).agg(F.countDistinct("t").alias("n_terms"))))  # one row each


_DENSE = """
v as (select vec_id, embedding as e, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings),
ds as (select q.vec_id as query_id, c.vec_id as vec_id, list_dot_product(q.e::double[], c.e::double[]) / (q.n * c.n) as score from v q join v c on q.vec_id % 50 = 0),
dr as (select *, cast(row_number() over (partition by query_id order by round(score, 9) desc, vec_id) as integer) as rank from ds)"""


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return retrieval.cosine_topk(vectors, vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"))


@query(f"with {_DENSE} select query_id, vec_id, rank, round(score, 6) as score from dr where rank <= 20")
def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query(f"""with {_BM25}, {_DENSE}, ch as (
select query_id, doc_id as chunk_id, 1.0 / (60 + rank) as s, 'bm25' as channel from ranked where rank <= 20
union all select query_id, vec_id, 1.0 / (60 + rank), 'dense' from dr where rank <= 20),
f as (select query_id, chunk_id, round(sum(s::double), 9) as rrf_score, array_to_string(list_sort(list(distinct channel)), ',') as channels from ch group by all)
select query_id, chunk_id, rrf_score, channels, cast(row_number() over (partition by query_id order by rrf_score desc, chunk_id) as integer) as pool_rank from f qualify pool_rank <= 144""")
def rrf_fusion(spark, sf_dir):
    lexical = retrieval.channel_scores(lexical_top(spark, sf_dir, C.TOP_K), "bm25")
    dense = retrieval.channel_scores(_dense(spark, sf_dir), "dense", item="vec_id")  # vectors stand in for chunks of the same id
    return retrieval.pool(retrieval.fused(lexical, dense)).select("query_id", "chunk_id", "rrf_score", F.array_join("channels", ",").alias("channels"), "pool_rank")


@query("""
select item_id as query_id, 0 as variant, text from benchmark
union all select item_id, cast(row_number() over (partition by item_id order by k) as integer), v from (
  select item_id, k, text || ' ' || words as v, contains(lower(text), 'what is') or contains(lower(text), 'relationship') as simple from benchmark join (values
    (1, 'stateflow', 'Stateflow chart finite state machine state transition event action Simulink'), (2, 'chart', 'Stateflow chart state transition diagram'),
    (3, 'transition', 'transition state event condition action Stateflow'), (4, 'event', 'event broadcast chart execution Stateflow'), (5, 'truth table', 'truth table decision logic Stateflow'),
    (6, 'autosar', 'AUTOSAR component composition ARXML Simulink'), (6, 'arxml', 'AUTOSAR component composition ARXML Simulink'), (7, 'simulink', 'Simulink model simulation block signal subsystem'),
    (8, 'solver', 'solver fixed-step variable-step simulation Simulink')) as e(k, word, words) on contains(lower(text), word) group by all)
qualify row_number() over (partition by item_id order by k) <= 3""")
def query_expansion(spark, sf_dir):
    return retrieval.variants(questions(spark, sf_dir))


@query(f"""with {_BM25}, r as (select rank, doc_id, query_id from ranked where rank <= 20)
select query_id, doc_id, rank, round(1.0 / (60 + rank), 9) as score from r join documents using (doc_id) where source in ('src0', 'src1')""")
def source_filtered(spark, sf_dir):
    top = retrieval.source_filter(lexical_top(spark, sf_dir, C.TOP_K), load(spark, sf_dir, "documents").select("doc_id", "source"), releases=["src0", "src1"])
    return top.select("query_id", "doc_id", "rank", F.round(1 / (C.RRF_K + F.col("rank")), 9).alias("score"))


def _any(column: str, words) -> str:
    return "(" + " or ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _tags(column: str, at: int) -> str:
    """A DuckDB list of the domains found in a lower-cased column."""
    cases = ", ".join(f"case when {_any(column, words[at])} then '{name}' end" for name, words in sorted(C.DOMAINS.items()))
    return f"list_filter([{cases}], lambda x: x is not null)"


@query(f"select doc_id, array_to_string({_tags('lower(text)', 0)}, ',') as domains, len({_tags('lower(text)', 0)}) as n_domains, array_to_string({_tags('lower(source)', 1)}, ',') as title_domains from documents")
def domain_tagging(spark, sf_dir):
    found = T.domains(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(found, ",").alias("domains"), F.size(found).cast("long").alias("n_domains"), F.array_join(T.domains(F.col("source"), "title"), ",").alias("title_domains"))


_ROLE = f"case when len({_tags('lower(text)', 0)}) >= 2 and {_any('lower(text)', C.RELATION_CUES)} then 'relationship' when {_any('lower(text)', C.COMPARISON_CUES)} then 'comparison' when {_any('lower(text)', C.PROCEDURE_CUES)} then 'procedure' when {_any('lower(text)', C.DEFINITION_CUES)} then 'definition' else 'general' end"


@query(f"with r as (select item_id, text, {_ROLE} as role from benchmark) select item_id as query_id, role, {_any('lower(text)', C.SIMPLE_CUES)} and not {_any('lower(text)', C.COMPLEX_CUES)} as simple_relation, cast(case role {' '.join(f'''when '{k}' then {v}''' for k, v in C.ROLE_LIMITS.items())} end as integer) as evidence_limit, cast(case role {' '.join(f'''when '{k}' then {v}''' for k, v in C.ROLE_BUDGETS.items())} end as integer) as token_budget from r")
def question_role(spark, sf_dir):
    role = T.question_role(F.col("text"))
    return questions(spark, sf_dir).select("query_id", role.alias("role"), T.simple_relation(F.col("text")).alias("simple_relation"), T.by_role(role, C.ROLE_LIMITS).alias("evidence_limit"), T.by_role(role, C.ROLE_BUDGETS).alias("token_budget"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 candidates of each question with all that later steps read; documents stand in for chunks."""
    docs = load(spark, sf_dir, "documents")
    top = lexical_top(spark, sf_dir, C.CANDIDATES).select("query_id", "doc_id", F.col("rank").alias("candidate_rank"), F.round(1 / (C.RRF_K + F.col("rank")), 9).alias("rrf_score"))
    asked = questions(spark, sf_dir).select("query_id", F.col("text").alias("question"), T.domains(F.col("text")).alias("query_domains"))
    rows = top.join(asked, "query_id").join(docs.select("doc_id", F.col("source").alias("title"), F.col("text").alias("content")), "doc_id")
    rows = rows.select("query_id", "question", "query_domains", F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("doc_id").alias("ordinal"), F.lit(None).cast("int").alias("page"), "title", F.lit("").alias("heading_path"), "content", T.domains(F.col("title"), "title").alias("document_domains"), F.array(F.lit("bm25")).alias("channels"), "rrf_score", "candidate_rank")
    return retrieval.boosted(rows)


_NOISE = "case when len(trim(text)) < 24 then 'too_short' when lower(trim(text)) like 'contents %' or (len(text) - len(replace(text, '. . .', ''))) / 5 >= 3 then 'table_of_contents' when len(regexp_extract_all(text, '\\b\\d+-\\d+\\b')) >= 8 then 'page_index_noise' else '' end"


@query(f"""with {_BM25}, c as (select query_id, doc_id, rank, b.text as question, d.text as text, lower(source || '  ' || d.text) as t from ranked join documents d using (doc_id) join benchmark b on item_id = query_id where rank <= 18),
x as (select *, {_ROLE.replace('text', 'question')} as role, {' + '.join(f"cast(contains(t, '{w}') as integer)" for w in C.RELATION_EVIDENCE)} as hits, {' + '.join(f"cast(contains(t, '{w}') and contains(lower(question), '{w}') as integer)" for w in C.KEY_TERMS)} as shared from c)
select query_id, doc_id as chunk_id, rank as candidate_rank, role, case when hits > 0 then 'relationship' else 'general' end as evidence_role, {_NOISE} as noise,
round(round(1.0 / (60 + rank), 9) + 0.016 + case when len(text) < 80 then -0.010 else 0 end + case when len(text) > 2200 then -0.006 else 0 end + 0.01 * shared + case when role = 'relationship' then least(0.045, 0.009 * hits) else 0 end, 6) as selector_score from x""")
def selector_score(spark, sf_dir):
    rows = selection.selector_score(candidates(spark, sf_dir))
    return rows.select("query_id", "chunk_id", "candidate_rank", "role", "evidence_role", F.coalesce(selection.noise_reason(F.col("content"), F.col("heading_path")), F.lit("")).alias("noise"), "selector_score")


#: Titles of these tables name no domain and every document is a chunk, so neither domains, quotas nor duplicates decide here;
#: tests hold those rules to cases of their own.
@query(f"""with {_BM25}, c as (select query_id, doc_id, rank, b.text as question, d.text as text, lower(source || '  ' || d.text) as t from ranked join documents d using (doc_id) join benchmark b on item_id = query_id where rank <= 18),
x as (select *, {_ROLE.replace('text', 'question')} as role, {' + '.join(f"cast(contains(t, '{w}') as integer)" for w in C.RELATION_EVIDENCE)} as hits, {' + '.join(f"cast(contains(t, '{w}') and contains(lower(question), '{w}') as integer)" for w in C.KEY_TERMS)} as shared from c),
s as (select query_id, doc_id as chunk_id, rank as candidate_rank, {_NOISE} as noise,
round(round(1.0 / (60 + rank), 9) + 0.016 + case when len(text) < 80 then -0.010 else 0 end + case when len(text) > 2200 then -0.006 else 0 end + 0.01 * shared + case when role = 'relationship' then least(0.045, 0.009 * hits) else 0 end, 6)::double as selector_score from x),
p as (select *, cast(row_number() over (partition by query_id, noise order by selector_score desc, candidate_rank) as integer) as position from s)
select query_id, chunk_id, candidate_rank, case when noise = '' then selector_score end as selector_score, case when noise = '' and position <= 6 then position end as position, case when noise <> '' then noise when position > 6 then 'below_selected_cut' end as reason from p""")
def evidence_select(spark, sf_dir):
    return selection.select_evidence(selection.selector_score(candidates(spark, sf_dir)))


@query(f"""with {_BM25}, need as (select item_id as query_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_./:+-]+')), lambda x: len(x) >= 3 and not regexp_full_match(x, '\\d+')
  and not list_contains([{', '.join(f"'{w}'" for w in sorted({*C.GENERIC_TERMS, *C.ACTION_TERMS, *(k for d, _ in C.DOMAINS.values() for k in d if len(k) >= 3 and k.isascii() and ' ' not in k)}))}], x)) as required, {_tags('lower(text)', 0)} as domains from benchmark),
ev as (select query_id, list_distinct(flatten(list(regexp_extract_all(lower(source || chr(10) || text), '[a-z0-9_./:+-]+')))) as tokens, lower(string_agg(source || chr(10) || chr(10) || text, chr(10))) as t from ranked join documents using (doc_id) where rank <= 6 group by all),
c as (select query_id, domains, required, list_filter(required, lambda x: list_contains(tokens, x) or ((contains(x, '-') or contains(x, '_')) and contains(t, x))) as covered from need left join ev using (query_id)),
r as (select *, len(required) as n, len(required) - len(covered) as lacking, case when len(required) = 0 then 1.0 else len(covered) / len(required)::double end as ratio from c),
w as (select *, case when n = 0 then 'no_specific_terms' when lacking > 0 and n <= 3 then 'specific_terms_missing' when lacking > 0 and ratio < 0.5 then 'low_specific_term_coverage' when lacking > 0 and len(domains) = 0 then 'out_of_scope_terms_missing' else 'covered_or_domain_supported' end as reason from r)
select query_id, reason in ('no_specific_terms', 'covered_or_domain_supported') as passed, n as n_required, n - lacking as n_covered, round(ratio, 6) as ratio, reason from w""")
def coverage_gate(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.lit("").alias("heading_path"), F.col("text").alias("content"))
    evidence = lexical_top(spark, sf_dir, C.FINAL_EVIDENCE).join(docs, "doc_id")
    out = selection.coverage(questions(spark, sf_dir), evidence)
    return out.select("query_id", "passed", F.size("required").cast("long").alias("n_required"), F.size("covered").cast("long").alias("n_covered"), F.round("ratio", 6).alias("ratio"), "reason")


@query("""with t as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_./:+-]+')) as k, source from documents),
p as (select a.doc_id as a_id, b.doc_id as b_id, len(list_intersect(a.k, b.k)) as shared, len(a.k) + len(b.k) as total from t a join t b on b.doc_id = a.doc_id + 1)
select a_id, b_id, round(case when total = 0 or shared = 0 then 0 else shared / (total - shared)::double end, 6) as similarity, shared / greatest(total - shared, 1)::double >= 0.45 as duplicate from p""")
def near_dup_pairs(spark, sf_dir):
    tokens = load(spark, sf_dir, "documents").select("doc_id", T.lexical_tokens(F.col("text")).alias("k"))
    pairs = tokens.select(F.col("doc_id").alias("a_id"), (F.col("doc_id") + 1).alias("b_id"), F.col("k").alias("a")).join(tokens.select(F.col("doc_id").alias("b_id"), F.col("k").alias("b")), "b_id")
    alike = selection.jaccard(F.col("a"), F.col("b"))
    reason = selection.duplicate_reason(F.col("a_id"), F.col("b_id"), F.lit(True), F.lit(False), alike)
    return pairs.select("a_id", "b_id", F.round(alike, 6).alias("similarity"), reason.isNotNull().alias("duplicate"))


@query(f"""with {_BM25}, c as (select query_id, doc_id, b.text as question, trim(regexp_replace(d.text, '\\s+', ' ', 'g')) as t from ranked join documents d using (doc_id) join benchmark b on item_id = query_id where rank <= 6),
s as (select *, list_filter(list_transform(string_split(regexp_replace(t, '([.!?;])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') as u from c),
w as (select query_id, doc_id, question, case when t = '' then [] when len(u) <= 1 and len(t) > 220 then list_transform(range(0, cast(floor((len(t) - 1) / 220) as bigint) + 1), lambda i: trim(substr(t, cast(i * 220 + 1 as bigint), 220))) else u end as u from s),
e as (select query_id, doc_id, question, unnest(u) as unit, generate_subscripts(u, 1) - 1 as position from w),
k as (select *, list_distinct(regexp_extract_all(lower(question), '[a-z0-9_./:+-]+')) as a, list_distinct(regexp_extract_all(lower(unit), '[a-z0-9_./:+-]+')) as b from e)
select query_id, doc_id as chunk_id, cast(position as integer) as position, len(unit) as n_chars, round(case when len(b) = 0 then 0 else 2.0 * len(list_intersect(a, b)) + len(list_intersect(a, b)) / len(b)::double + case when position <= 1 then 0.35 else 0 end + case when {_any('unit', C.UNIT_MARKS)} then 0.25 else 0 end end, 6) as score from k""")
def snippet_units(spark, sf_dir):
    items = candidates(spark, sf_dir).where(F.col("candidate_rank") <= C.FINAL_EVIDENCE).select("query_id", "question", "chunk_id", "content")
    return selection.scored_units(items).select("query_id", "chunk_id", "position", F.length("unit").cast("long").alias("n_chars"), F.round("score", 6).alias("score"))


_SNIPPETS = f"""{_BM25}, c as (select query_id, doc_id, rank, b.text as question, d.text as content, source, trim(regexp_replace(d.text, '\\s+', ' ', 'g')) as t from ranked join documents d using (doc_id) join benchmark b on item_id = query_id where rank <= 6),
sp as (select *, list_filter(list_transform(string_split(regexp_replace(t, '([.!?;])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') as u from c),
w as (select query_id, doc_id, question, case when t = '' then [] when len(u) <= 1 and len(t) > 220 then list_transform(range(0, cast(floor((len(t) - 1) / 220) as bigint) + 1), lambda i: trim(substr(t, cast(i * 220 + 1 as bigint), 220))) else u end as u from sp),
e as (select query_id, doc_id, question, unnest(u) as unit, generate_subscripts(u, 1) - 1 as position from w),
k as (select *, list_distinct(regexp_extract_all(lower(question), '[a-z0-9_./:+-]+')) as a, list_distinct(regexp_extract_all(lower(unit), '[a-z0-9_./:+-]+')) as b from e),
us as (select query_id, doc_id, position, unit, round(case when len(b) = 0 then 0 else 2.0 * len(list_intersect(a, b)) + len(list_intersect(a, b)) / len(b)::double + case when position <= 1 then 0.35 else 0 end + case when {_any('unit', C.UNIT_MARKS)} then 0.25 else 0 end end, 9) as score from k),
ur as (select *, row_number() over (partition by query_id, doc_id order by score desc, position) as rank from us qualify rank <= {C.SNIPPET_RANKED}),
un as (select *, row_number() over (partition by query_id, doc_id order by rank) as step from ur where len(unit) >= {C.SNIPPET_MIN}),
fold as (select query_id, doc_id, 0::bigint as step, 0::bigint as total, []::integer[] as held from c
  union all select f.query_id, f.doc_id, f.step + 1, case when s then total else total + len(unit) end, case when s then held else list_append(held, position::integer) end
  from (select f.*, unit, position, len(held) >= {C.SNIPPET_UNITS} or total >= {C.SNIPPET_CHARS} or (total + len(unit) > {C.SNIPPET_CHARS} and len(held) > 0) as s from fold f join un on un.query_id = f.query_id and un.doc_id = f.doc_id and un.step = f.step + 1) f),
picked as (select query_id, doc_id, held from fold qualify row_number() over (partition by query_id, doc_id order by step desc) = 1),
texts as (select query_id, doc_id, string_agg(unit, ' ' order by position) as joined from picked join us using (query_id, doc_id) where list_contains(held, position::integer) group by all),
snip as (select c.query_id, c.doc_id as chunk_id, c.rank, c.source, c.content, c.question, coalesce(rtrim(substr(joined, 1, {C.SNIPPET_CHARS}), ' '), regexp_replace(substr(c.content, 1, {C.SNIPPET_CHARS}), '^\\s+|\\s+$', '', 'g')) as snippet from c left join texts using (query_id, doc_id))"""


@query(f"with recursive {_SNIPPETS} select query_id, chunk_id, sha256(snippet) as snippet_hash, len(snippet) as n_chars from snip")
def snippet_select(spark, sf_dir):
    items = candidates(spark, sf_dir).where(F.col("candidate_rank") <= C.FINAL_EVIDENCE)
    out = selection.snippets(items.select("query_id", "question", "chunk_id", "content"))
    return out.select("query_id", "chunk_id", F.sha2(F.encode("snippet", "UTF-8"), 256).alias("snippet_hash"), F.length("snippet").cast("long").alias("n_chars"))


@query(f"""with recursive {_SNIPPETS}, ro as (select *, {_ROLE.replace('text', 'question')} as role from snip), li as (select * from ro where rank <= case role {' '.join(f"when '{k}' then {v}" for k, v in C.ROLE_LIMITS.items())} end)
select query_id, any_value(role) as role, count(*) as n_evidence, cast(sum(len(content)) as bigint) as original_chars, sha256(string_agg('[E:' || chunk_id || '] source=' || source || '; page=unknown; heading=' || chr(10) || snippet, chr(10) || chr(10) order by rank)) as context_hash from li group by query_id""")
def compact_context(spark, sf_dir):
    items = candidates(spark, sf_dir).where(F.col("candidate_rank") <= C.FINAL_EVIDENCE)
    out = selection.compact_context(items.withColumnRenamed("candidate_rank", "position"))
    return out.select("query_id", "role", "n_evidence", "original_chars", F.sha2(F.encode("context", "UTF-8"), 256).alias("context_hash"))


@query("select doc_id, lower(trim(text)) like 'contents %' or (len(text) - len(replace(text, '. . .', ''))) / 5 >= 3 or len(regexp_extract_all(text, '\\b\\d+-\\d+\\b')) >= 8 or floor((len(text) - len(replace(lower(text), ' on page ', ''))) / 9) >= 5 as toc from documents")
def toc_filter(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", retrieval.toc_like(F.col("text"), F.lit(""), F.lit(None).cast("int")).alias("toc"))


@query(f"""with {_BM25}, h as (select query_id, count(*) as hits from ranked where rank <= 20 group by all), x as (select item_id as query_id, text, coalesce(hits, 0) as hits, {_any('lower(text)', C.SOLVER_TERMS)} as solver from benchmark left join h on item_id = query_id)
select query_id, hits, coalesce(case when {_any('lower(text)', C.SKIP_DENSE_TERMS)} and hits >= case when solver then 4 else 8 end then case when {_any('lower(text)', ('autosar', 'arxml'))} then 'skip:dense_fast_path_autosar' when solver then 'skip:dense_fast_path_solver' when {_any('lower(text)', ('stateflow', '状态机'))} then 'skip:dense_fast_path_stateflow' when {_any('lower(text)', C.CODEGEN_TERMS)} then 'skip:dense_fast_path_codegen' when {_any('lower(text)', C.SIMPLE_CUES)} and not {_any('lower(text)', C.COMPLEX_CUES)} then 'skip:dense_fast_path_simple_domain' when contains(lower(text), 'simulink') and hits >= 10 then 'skip:dense_fast_path_simulink' end end, '') as reason from x""")
def dense_skip_gate(spark, sf_dir):
    hits = lexical_top(spark, sf_dir, C.TOP_K).groupBy("query_id").agg(F.count("*").alias("hits"))
    rows = questions(spark, sf_dir).join(hits, "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))
    return rows.select("query_id", "hits", F.coalesce(retrieval.dense_skip_reason(F.col("text"), F.col("hits")), F.lit("")).alias("reason"))


@query(f"""with {_BM25}, g as (select doc_id from labels group by all having max(quality) = 1), r as (select query_id, rank, g.doc_id is not null as good from ranked left join g using (doc_id) where rank <= 20)
select query_id, case when count(*) filter (good and rank <= 6) > 0 then 1.0::double else 0.0::double end as recall_at_k, round(count(*) filter (good and rank <= 6) / 6.0::double, 6) as precision_at_k, round(coalesce(1.0::double / min(rank) filter (good), 0), 6) as reciprocal_rank from r group by all""")
def eval_metrics(spark, sf_dir):
    top = lexical_top(spark, sf_dir, C.TOP_K).withColumnRenamed("doc_id", "item")
    good = load(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("item")).agg(F.max("quality").alias("quality")).where("quality = 1")
    relevant = top.select("query_id", "item").join(good, "item", "left_semi")
    out = chat.retrieval_metrics(top, relevant, C.FINAL_EVIDENCE)
    return out.select("query_id", "recall_at_k", F.round("precision_at_k", 6).alias("precision_at_k"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"))
