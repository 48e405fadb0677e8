"""Queries: row changes and lists, prompts and model outputs, the heterogeneous graph, wiki files and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata import config as C
from lodestrata.functions import text as T
from lodestrata.operators import answers, chat, graph, records, wiki
from lodestrata.plans.dialogue import _EDGES, _mentions
from lodestrata.plans.registry import load, query
from lodestrata.plans.retrieval import _ROLE, _any, questions
from lodestrata.sources import files


@query("""with gone as (select distinct label from embeddings where label % 5 = 1), new as (select vec_id + 1000000 as vec_id, label from embeddings where label % 2 = 0 and vec_id % 3 = 0)
select vec_id, label from embeddings where label not in (select label from gone) and label not in (select label from new) union all select * from new""")
def vector_upsert(spark, sf_dir):
    """The vector index after the even labels' documents were indexed again and others deleted."""
    table = load(spark, sf_dir, "embeddings").select("vec_id", "label")
    new = table.where("label % 2 = 0 and vec_id % 3 = 0").select((F.col("vec_id") + 1000000).alias("vec_id"), "label")
    return records.replaced(table, new, "label", table.where("label % 5 = 1").select("label"))


@query("""with t as (select doc_id, max(quality) as passed from labels group by all), n as (select doc_id, lang, n_chars % 2 as passed from documents where doc_id % 4 = 0)
select doc_id, cast(coalesce(n.passed, t.passed) as integer) as passed from t full join n using (doc_id)""")
def evaluation_upsert(spark, sf_dir):
    """Judgements of a background run put in place of earlier ones."""
    table = load(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("int").alias("passed"))
    docs = load(spark, sf_dir, "documents").where("doc_id % 4 = 0")
    runs = docs.select("doc_id", (F.col("n_chars") % 2).cast("int").alias("passed"), F.lit(2).alias("run")).union(docs.select("doc_id", F.lit(9), F.lit(1)))
    return records.upserted(table, runs, ["doc_id"], "run")


@query("select 'parents' as tab, doc_id from documents where doc_id % 7 <> 0 union all select 'labels', doc_id from labels where doc_id % 7 <> 0 union all select 'vectors', vec_id from embeddings where vec_id not in (select doc_id from documents where doc_id % 7 = 0)")
def cascade_delete(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id")
    children = {"labels": (load(spark, sf_dir, "labels").select("doc_id"), "doc_id"), "vectors": (load(spark, sf_dir, "embeddings").select("vec_id"), "vec_id")}
    left = records.deleted(docs, children, docs.where("doc_id % 7 = 0"), "doc_id")
    rows = [df.select(F.lit(name).alias("tab"), F.col(df.columns[0]).alias("doc_id")) for name, df in left.items()]
    return rows[0].union(rows[1]).union(rows[2])


@query("select doc_id, case when doc_id % 6 = 0 then 'xx' else lang end as lang, case when doc_id % 6 = 3 then 'moved' else source end as source from documents")
def row_updates(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    changes = docs.where("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 6 == 0, "xx").alias("lang"), F.when(F.col("doc_id") % 6 == 3, "moved").alias("source"))
    return records.updated(docs, changes, "doc_id")


@query("select distinct item_id * 9 as doc_id, d.doc_id is not null as found, d.source from benchmark left join documents d on d.doc_id = item_id * 9")
def point_lookups(spark, sf_dir):
    wanted = load(spark, sf_dir, "benchmark").select((F.col("item_id") * 9).alias("doc_id"))
    return records.looked_up(load(spark, sf_dir, "documents").select("doc_id", "source"), wanted, "doc_id").select("doc_id", "found", "source")


_WIKI_ROWS = "select page_id, url as slug, 'Page ' || page_id as title, case when page_id % 3 = 0 then 'source' else 'source_section' end as page_type, case when page_id % 2 = 0 then 'draft' else 'published' end as status from pages"


@query(f"select page_id, slug from ({_WIKI_ROWS}) where page_type = 'source_section' and status = 'draft' and (contains(lower(title || ' ' || slug || ' ' || page_type || ' ' || status), 'page 1'))")
def page_search(spark, sf_dir):
    load(spark, sf_dir, "pages").createOrReplaceTempView("wiki_source")
    return records.page_filter(spark.sql(_WIKI_ROWS.replace("from pages", "from wiki_source")), "source_section", "draft", " PAGE 1").select("page_id", "slug")


@query("with t as (select conv_id, conv_id % 10 = 3 as pinned, max(turn) as updated from conversations group by all) select conv_id, pinned, updated, cast(row_number() over (order by pinned desc, updated desc, conv_id desc) as integer) as place from t qualify place <= 100")
def conversation_list(spark, sf_dir):
    table = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("updated")).select("conv_id", (F.col("conv_id") % 10 == 3).alias("pinned"), "updated")
    return records.listed(table, [F.desc("pinned"), F.desc("updated"), F.desc("conv_id")], 100)


@query("select distinct source as release from documents where source is not null")
def release_list(spark, sf_dir):
    return load(spark, sf_dir, "documents").where("source is not null").select(F.col("source").alias("release")).distinct()


@query("with q as (select trim(text) as question from benchmark union select trim(text) from conversations where role = 'user' and conv_id % 2 = 0) select question from q where question not in (select trim(text) from conversations where role = 'user' and text is not null)")
def acceptance_missing(spark, sf_dir):
    told = load(spark, sf_dir, "conversations")
    wanted = questions(spark, sf_dir).select(F.col("text").alias("question")).union(told.where("role = 'user' and conv_id % 2 = 0").select("text")).where("question is not null").select(F.trim("question").alias("question")).distinct()
    return records.unasked(wanted, told)


@query("""with a as (select conv_id * 1000 + turn as answer_id, text, case when turn % 4 = 1 then 0.35 else 0.75 end as f from conversations where role = 'assistant')
select answer_id, case when f < 0.65 and answer_id % 3 <> 0 then 'again ' || text else text end as answer, case when f < 0.65 and answer_id % 3 <> 0 then 0.75 else f end::double as faithfulness, f < 0.65 and answer_id % 3 <> 0 as retried from a""")
def answer_retry(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.col("text").alias("answer"), F.when(F.col("turn") % 4 == 1, 0.35).otherwise(0.75).alias("faithfulness"))
    again = rows.where("answer_id % 3 <> 0").select("answer_id", F.concat(F.lit("again "), "answer").alias("answer"), F.lit(0.75).alias("faithfulness"))
    return records.retried(rows, again)


@query("""with r as (select doc_id, doc_id % 3 = 0 as has, doc_id % 2 = 0 as hit, doc_id % 5 = 0 as refused, doc_id % 10 = 0 as should, n_chars % 7 / 7.0 as dense, n_chars % 4 as cited, n_chars % 4 + 1 as paragraphs, doc_id % 3 as points, doc_id % 3 - doc_id % 2 * (doc_id % 3 > 0)::int as good from documents)
select round(count(*) filter (has and hit) / count(*) filter (has)::double, 6) as domain_accuracy, round(count(*) filter (has and not hit) / count(*) filter (has)::double, 6) as wrong_domain_rate, round(avg(dense::double), 6) as dense_contribution,
round(sum(cited) filter (not refused) / sum(paragraphs) filter (not refused)::double, 6) as citation_coverage, round(sum(good) filter (not refused) / sum(points) filter (not refused)::double, 6) as completeness,
round(count(*) filter (refused and should) / count(*) filter (should)::double, 6) as refusal_accuracy, round(count(*) filter (refused and not should) / count(*) filter (not should)::double, 6) as false_refusal_rate from r""")
def answer_metrics(spark, sf_dir):
    d = F.col("doc_id")
    none = F.array().cast("array<string>")
    rows = load(spark, sf_dir, "documents").select(
        F.when(d % 3 == 0, F.array(F.lit("solver"))).otherwise(none).alias("domains"), F.when(d % 2 == 0, F.array(F.lit("solver"), F.lit("testing"))).otherwise(F.array(F.lit("autosar"))).alias("found_domains"),
        (F.col("n_chars") % 7 / 7).alias("dense_share"), (F.col("n_chars") % 4).alias("cited"), (F.col("n_chars") % 4 + 1).alias("paragraphs"), (d % 5 == 0).alias("refused"), (d % 10 == 0).alias("should_refuse"),
        (d % 3).alias("points"), (d % 3 - (d % 2) * (d % 3 > 0).cast("int")).alias("covered_points"),
    )
    return records.answer_metrics(rows)


def _prompt_sql() -> str:
    parts = [p.replace("'", "''") for p in C.PROMPT.split("{}")]
    contracts = " ".join(f"when '{k}' then '{v}'" for k, v in C.CONTRACTS.items())
    said = f"'{parts[0]}' || case role {contracts} end || '{parts[1]}' || coalesce(memories, '{C.NOTHING}') || '{parts[2]}' || coalesce(history, '{C.NOTHING}') || '{parts[3]}' || text || '{parts[4]}' || coalesce(context, '') || '{parts[5]}'"
    budgets = " ".join(f"when '{k}' then {v}" for k, v in C.ROLE_BUDGETS.items())
    return f"""with h as (select conv_id as query_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) order by turn) as history from (select * from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 12) group by all),
m as (select item_id as query_id, '- prefers ' || item_id || chr(10) || '- is brief' as memories from benchmark where item_id % 2 = 0), c as (select doc_id as query_id, substr(text, 1, 300) as context from documents),
q as (select item_id as query_id, text, {_ROLE} as role from benchmark)
select query_id, role, cast(case role {budgets} end as integer) as token_budget, sha256(regexp_replace({said}, '\\s+$', '')) as prompt_hash from q left join h using (query_id) left join m using (query_id) left join c using (query_id)"""


@query(_prompt_sql())
def prompt_assembly(spark, sf_dir):
    """Questions with the conversation, the memories and the document of their number."""
    asked = questions(spark, sf_dir)
    context = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 300).alias("context"))
    told = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("at"), "role", "text")
    even = asked.where("query_id % 2 = 0")
    known = even.select("query_id", F.lit(0).alias("at"), F.concat(F.lit("prefers "), F.col("query_id").cast("string")).alias("content")).union(even.select("query_id", F.lit(1), F.lit("is brief")))
    out = answers.prompts(asked, context, told, known)
    return out.select("query_id", "role", "token_budget", F.sha2(F.encode("prompt", "UTF-8"), 256).alias("prompt_hash"))


_HINTS = C.NOTHING_FOUND


@query(f"""select item_id as query_id, '{C.UNCOVERED.split("{}")[0]}' || case when item_id % 2 = 0 then '{C.KEY_TERMS_TEXT}' else 'a{C.LIST_MARK}b' || item_id end || '{C.UNCOVERED.split("{}")[1]}' as uncovered,
'- {_HINTS[0]}' || case when item_id % 3 = 0 then chr(10) || '- {_HINTS[1]}' else '' end || case when item_id % 2 = 1 then chr(10) || '- {_HINTS[2].split("{}")[0]}' || 'a / b' || item_id || '{_HINTS[2].split("{}")[1]}' else '' end || chr(10) || '- {_HINTS[3]}' as nothing_found from benchmark""")
def insufficient_answers(spark, sf_dir):
    i = F.col("item_id")
    words = F.when(i % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.concat(F.lit("b"), i.cast("string"))))
    return load(spark, sf_dir, "benchmark").select(i.alias("query_id"), answers.uncovered_answer(words).alias("uncovered"), answers.nothing_found_answer(i % 3 == 0, words).alias("nothing_found"))


@query("""select item_id, case item_id % 4 when 3 then null else cast(item_id as integer) end as score, case item_id % 4 when 0 then 'fenced' when 1 then 'bare' when 2 then 'plain' end as kind from benchmark""")
def json_objects(spark, sf_dir):
    """Outputs with a fence, with words around the object, the object alone, and without one."""
    i = F.col("item_id").cast("string")
    made = lambda kind: F.concat(F.lit('{"score": '), i, F.lit(f', "kind": "{kind}"}}'))
    said = F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("Here:\n```json\n"), made("fenced"), F.lit("\n```\n{\"score\": 1}"))).when(F.col("item_id") % 4 == 1, F.concat(F.lit("I say "), made("bare"), F.lit(" done"))).when(F.col("item_id") % 4 == 2, made("plain")).otherwise("{no object")
    rows = load(spark, sf_dir, "benchmark").select("item_id", answers.json_fields(said, "score int, kind string").alias("x"))
    return rows.select("item_id", "x.score", "x.kind")


def _outputs(spark, sf_dir):
    i = F.col("page_id").cast("string")
    said = F.concat(F.lit('{"entities": [{"label": "Topic '), i, F.lit('", "type": "method", "confidence": 1.5}, {"label": "the", "type": "tool"}, {"label": "Signal Bus '), i, F.lit('", "type": "planet"}], "relations": [{"source": "Topic '), i, F.lit('", "target": "Signal Bus '), i, F.lit('", "type": "part_of", "confidence": 0.4}, {"source": "Signal Bus '), i, F.lit('", "target": "signal bus '), i, F.lit('"}]}'))
    return load(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 5 == 4, "no answer").otherwise(F.concat(F.lit("Sure: "), said)).alias("answer"))


@query("select page_id, unnest(['topic-' || page_id, 'signal-bus-' || page_id]) as entity_key, unnest(['method', 'concept']) as entity_type, unnest([1.0, 0.72])::double as confidence from pages where page_id % 5 <> 4")
def extracted_entities(spark, sf_dir):
    return answers.extracted(_outputs(spark, sf_dir))[0].select("page_id", "entity_key", "entity_type", "confidence")


@query("select page_id, 'topic-' || page_id as source_key, 'signal-bus-' || page_id as target_key, 'part_of' as relation_type, 'partof' as label, 0.4::double as confidence from pages where page_id % 5 <> 4")
def extracted_relations(spark, sf_dir):
    return answers.extracted(_outputs(spark, sf_dir))[1].drop("at")


_WIKI_PAGES = "select page_id, url as slug, 'Page ' || page_id as title, regexp_replace(html, '<[^>]*>', ' ') || ' [E:' || page_id || '] [E:' || (page_id + 1) || '] [[Page ' || (page_id + 2) || ']] [[Bus ' || (page_id % 7) || ']]' as content, case when page_id % 4 > 0 then page_id end as document_id, page_id as updated from pages"
_WIKI_PAGES_SQL = _WIKI_PAGES.replace("'<[^>]*>', ' ')", "'<[^>]*>', ' ', 'g')")


def _wiki(spark, sf_dir):
    load(spark, sf_dir, "pages").createOrReplaceTempView("graph_pages")
    return spark.sql(_WIKI_PAGES.replace("from pages", "from graph_pages"))


def _known(spark, sf_dir):
    """Phrases of documents that begin a text, as entities with their number of pages."""
    return _mentions(spark, sf_dir).where("position <= 2").groupBy("entity_key").agg(F.countDistinct("page_id").alias("wiki_count")).select("entity_key", F.col("entity_key").alias("label"), F.lit("concept").alias("entity_type"), "wiki_count", F.col("wiki_count").alias("evidence_count"), F.lit(0.5).alias("confidence"))


_KNOWN = f"{_EDGES}, wp as ({_WIKI_PAGES_SQL}), known as (select k as entity_key, count(distinct page_id) as wiki_count from m where position <= 2 group by all)"
_MENTIONED = """mentioned as (select slug, entity_key from (select page_id, slug, lower(title || chr(10) || content) as t from wp) p join known on len(entity_key) >= 2 and contains(t, entity_key)
qualify row_number() over (partition by page_id order by wiki_count desc, entity_key) <= 18)"""
_HETERO = f"""with {_KNOWN}, {_MENTIONED}, cites as (select slug, unnest([page_id, page_id + 1]) as chunk_id from wp), rels as (select source_key, target_key from edges where source_key in (select entity_key from known) and target_key in (select entity_key from known)),
nodes as (select 'doc:' || doc_id as node, 'document' as type, source as label from documents union all select 'wiki:' || slug, 'wiki_page', title from wp union all select distinct 'evidence:' || chunk_id, 'evidence', 'E:' || chunk_id from cites union all select 'entity:' || entity_key, 'entity', entity_key from known),
es as (select 'doc:' || document_id as src, 'wiki:' || slug as dst, 'compiled_to' as edge_type from wp where document_id is not null union select 'wiki:' || slug, 'evidence:' || chunk_id, 'cites' from cites
union select 'wiki:' || a.slug, 'wiki:' || b.slug, 'links_to' from wp a join (select title, max_by(slug, page_id) as slug from wp group by all) b on b.title = 'Page ' || (a.page_id + 2)
union select 'wiki:' || slug, 'entity:' || entity_key, 'mentions' from mentioned union select 'evidence:' || doc_id, 'doc:' || doc_id, 'from_document' from documents where doc_id in (select chunk_id from cites)
union select 'entity:' || source_key, 'entity:' || target_key, 'co_occurs' from rels)"""


def _hetero(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    known = _known(spark, sf_dir)
    pairs = graph.relations(graph.cooccurrences(_mentions(spark, sf_dir)))
    return graph.hetero_graph(docs.select(F.col("doc_id").alias("document_id"), F.col("source").alias("title")), _wiki(spark, sf_dir), docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id")), known, graph.known_ends(pairs, known))


@query(f"{_HETERO} select node, type, label from nodes")
def hetero_graph_nodes(spark, sf_dir):
    return _hetero(spark, sf_dir)[0]


@query(f"{_HETERO} select src, dst, edge_type from es")
def hetero_graph_edges(spark, sf_dir):
    return _hetero(spark, sf_dir)[1]


@query(f"""{_HETERO}, w as (select 'wiki:' || slug as node from wp), f as (select src as node, edge_type, list_sort(list(distinct dst)) as l from es group by all), b as (select dst as node, list_sort(list(distinct src)) as l from es where edge_type = 'links_to' group by all)
select node, coalesce(array_to_string(list_slice(a.l, 1, 12), ','), '') as entities, coalesce(array_to_string(list_slice(c.l, 1, 18), ','), '') as evidence, coalesce(array_to_string(list_slice(o.l, 1, 12), ','), '') as outlinks, coalesce(array_to_string(list_slice(b.l, 1, 12), ','), '') as backlinks
from w left join (select * from f where edge_type = 'mentions') a using (node) left join (select * from f where edge_type = 'cites') c using (node) left join (select * from f where edge_type = 'links_to') o using (node) left join b using (node)""")
def wiki_context(spark, sf_dir):
    pages = _wiki(spark, sf_dir).select(F.concat(F.lit("wiki:"), "slug").alias("node"))
    out = graph.wiki_context(_hetero(spark, sf_dir)[1], pages)
    return out.select("node", *[F.array_join(c, ",").alias(c) for c in out.columns[1:]])


@query(f"with wp as ({_WIKI_PAGES_SQL}) select a.slug as src, b.slug as dst from wp a join (select title, max_by(slug, page_id) as slug from wp group by all) b on b.title = 'Page ' || (a.page_id + 2)")
def wiki_page_links(spark, sf_dir):
    return graph.page_links(_wiki(spark, sf_dir))[0]


@query(f"with {_KNOWN} select source_key, target_key, 0.45::double as weight from edges where source_key in (select entity_key from known) and target_key in (select entity_key from known)")
def relation_endpoints(spark, sf_dir):
    """Relations whose ends are both entities."""
    pairs = graph.relations(graph.cooccurrences(_mentions(spark, sf_dir)))
    return graph.known_ends(pairs, _known(spark, sf_dir)).select("source_key", "target_key", F.col("weight").cast("double").alias("weight"))


@query()
def graph_entities(spark, sf_dir):
    return graph.compiled(_wiki(spark, sf_dir), answers.extracted(_outputs(spark, sf_dir)))[0]


@query()
def graph_relations(spark, sf_dir):
    return graph.compiled(_wiki(spark, sf_dir), answers.extracted(_outputs(spark, sf_dir)))[1]


@query(f"""with {_EDGES}, d as (select node, count(*) as degree from (select source_key as node from edges union all select target_key from edges) group by all), n as (select node, case when len(node) % 2 = 0 then 'concept' else 'entity' end as type, degree from d),
a as (select *, 2 * pi() * (row_number() over (partition by type order by degree desc, node) - 1) / count(*) over (partition by type) as a, case type when 'concept' then 120.0 else 240.0 end::double as r from n) select node, type, degree, round(r * cos(a), 6) + 0.0 as x, round(r * sin(a), 6) + 0.0 as y from a""")
def ring_layout(spark, sf_dir):
    edges = graph.cooccurrences(_mentions(spark, sf_dir)).select(F.col("source_key").alias("src"), F.col("target_key").alias("dst"))
    nodes = graph.degrees(edges).select("node", F.when(F.length("node") % 2 == 0, "concept").otherwise("entity").alias("type"))
    return graph.rings(nodes, edges, {"concept": 120.0, "entity": 240.0})


@query(f"""with s as (select cast(substr(source, 4) as bigint) as doc_id, lang, row_number() over (partition by source order by lang) as section, count(*) as n, min(doc_id) as sample from documents group by source, lang),
l as (select doc_id, string_agg('- [[' || lang || ']]：' || n || ' 个证据块，页面 `s' || section || '` [E:' || sample || ']', chr(10) order by section) as lines from s group by all)
select doc_id, 'source-' || doc_id || '-src' || doc_id as slug, '# src' || doc_id || chr(10) || chr(10) || '## {C.INDEX_HEAD}' || chr(10) || chr(10) || lines || chr(10) || chr(10) || '## {C.INDEX_RULES[0]}' || chr(10) || chr(10) || '{C.INDEX_RULES[1]}' || chr(10) || '{C.INDEX_RULES[2]}' as content from l""")
def wiki_index_pages(spark, sf_dir):
    """Sources stand in for documents and their languages for sections."""
    from pyspark.sql import Window

    docs = load(spark, sf_dir, "documents")
    parts = docs.groupBy("source", "lang").agg(F.count("*").alias("n_chunks"), F.min("doc_id").alias("sample"))
    section = F.row_number().over(Window.partitionBy("source").orderBy("lang"))
    parts = parts.withColumn("section", section).select(F.substring("source", 4, 9).cast("long").alias("doc_id"), "section", F.col("lang").alias("title"), F.concat(F.lit("s"), F.col("section").cast("string")).alias("slug"), "n_chunks", "sample")
    sources = docs.select("source").distinct().select(F.substring("source", 4, 9).cast("long").alias("doc_id"), F.col("source").alias("title"))
    return wiki.index_pages(parts, sources).select("doc_id", "slug", "content")


@query("select case when page_id % 3 = 0 then 'published/' else 'drafts/' end || 'page-' || page_id || '.md' as path, sha256(html) as sha256 from pages where page_id % 3 < 2")
def wiki_files(spark, sf_dir):
    """Pages written as files, drafts and published ones apart, and read back."""
    status = F.element_at(F.array(F.lit("published"), F.lit("draft"), F.lit("rejected")), (F.col("page_id") % 3 + 1).cast("int"))
    pages = load(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("slug"), status.alias("status"), F.col("html").alias("content"))
    folder = files.work_folder(spark, "pages")
    files.write_pages(wiki.page_files(pages), folder)
    return files.read_pages(spark, folder).select("path", F.sha2(F.encode("content", "UTF-8"), 256).alias("sha256"))


@query("""with p as (select conv_id, turn, text as output, (select u.text from conversations u where u.conv_id = a.conv_id and u.role = 'user' and u.turn < a.turn order by u.turn desc limit 1) as instruction from conversations a where role = 'assistant' and trim(coalesce(text, '')) <> '')
select instruction, '' as input, output from p where instruction is not null""")
def training_samples(spark, sf_dir):
    """Training pairs written as JSON lines and read back."""
    folder = files.work_folder(spark, "samples")
    files.write_samples(chat.training_pairs(load(spark, sf_dir, "conversations")), folder)
    return spark.read.schema("instruction string, input string, output string").json(folder)


@query("""with r as (select item_id as id, case when item_id % 3 = 0 then 'failed' else 'ok' end as status, replace(replace(substr(text, 1, 40), '|', '\\|'), chr(10), ' ') as question from benchmark), c as (select status, count(*) as n from r group by all)
select sha256('# Acceptance' || chr(10) || chr(10) || (select string_agg('- ' || status || ': ' || n, chr(10) order by '- ' || status || ': ' || n) from c) || chr(10) || chr(10) || '| id | status | question |' || chr(10) || '|---|---|---|' || chr(10) || (select string_agg('| ' || id || ' | ' || status || ' | ' || question || ' |', chr(10) order by id) from r)) as report_hash""")
def detail_report(spark, sf_dir):
    rows = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.when(F.col("item_id") % 3 == 0, "failed").otherwise("ok").alias("status"), F.substring("text", 1, 40).alias("question"))
    return files.detail_report(rows, "Acceptance", ["question"]).select(F.sha2(F.encode("value", "UTF-8"), 256).alias("report_hash"))


_ODD_LABELS = ("Page 12", "pages 3 - 9", "Introduction / Basics", "MathWorks Guide R2024a", "Simulink User Guide R2023b", "bad æ label", "\\u00e9 escape", "a/b", "AUTOSAR/Simulink", "abc", "bus", "E: 12", "3.4.1", "x", "核心结论", "信号的关系", "Overview", "State Chart", "block")


@query("with l as (select distinct regexp_extract(text, '[A-Za-z]+( [A-Za-z]+)?') as label from documents union select unnest([" + ", ".join(f"'{x}'" for x in _ODD_LABELS) + f"""]))
select label, len(label) >= 2 and not list_contains([{', '.join(f"'{w}'" for w in C.STOP_LABELS)}], lower(trim(label))) and not {_any('label', C.LABEL_FRAGMENTS)} and not regexp_matches(label, '{C.BROKEN_LABEL.replace("(?iu)", "(?i)")}') and not ({' or '.join(f"regexp_matches(label, '{p}')" for p in (*C.GENERIC_LABELS, *C.NUMBER_LABELS))})
and not (contains(label, '/') and not {_any('lower(label)', ('autosar', 'simulink', 'stateflow'))}) and not (len(string_split_regex(trim(label), '\\s+')) = 1 and not list_contains([{', '.join(f"'{w}'" for w in C.SINGLE_WORDS)}], lower(trim(label))) and len(label) < 4) as valid,
case {' '.join(f"when {_any('lower(label)', words)} then '{kind}'" for kind, words in C.TYPE_KEYWORDS)} else 'concept' end as entity_type from l""")
def label_rules(spark, sf_dir):
    odd = spark.createDataFrame([(x,) for x in _ODD_LABELS], "label string")
    rows = load(spark, sf_dir, "documents").select(F.regexp_extract("text", "[A-Za-z]+( [A-Za-z]+)?", 0).alias("label")).union(odd).distinct()
    return rows.select("label", T.valid_label(F.col("label")).alias("valid"), T.entity_type(F.col("label")).alias("entity_type"))
