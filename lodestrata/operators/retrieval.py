"""Retrieval for batches of questions: lexical and vector channels, fusion, graph expansion, boosts.

Every operator takes all questions at once and keys its rows by query_id, so ranking is a window per question. Terms that
no question asks for are dropped before postings are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata import config as C
from lodestrata.functions import text as T


def corpus(docs: DataFrame, id_column: str, *columns: str, raw: bool = False) -> DataFrame:
    """``(doc_id, terms, dl)``: index terms over all the given text columns, in order. ``raw`` texts are indexed as they are,
    with all repeats (the page index); others by their distinct lexical tokens (the chunk index)."""
    parts = [T.raw_terms(F.coalesce(F.col(c), F.lit(""))) if raw else T.index_terms(T.lexical_tokens(F.coalesce(F.col(c), F.lit("")))) for c in columns]
    return docs.select(F.col(id_column).alias("doc_id"), F.concat(*parts).alias("terms")).withColumn("dl", F.size("terms"))


def question_phrases(questions: DataFrame, limit: int = C.FTS_TERMS) -> DataFrame:
    """``(query_id, phrase)``: each of a question's first distinct tokens, as the list of its index terms."""
    tokens = F.explode(T.query_terms(F.col("text"), limit)).alias("token")
    return questions.select("query_id", tokens).select("query_id", T.sub_terms(F.col("token")).alias("phrase")).where(F.size("phrase") > 0)


def bm25(docs: DataFrame, questions: DataFrame, id_column: str = "doc_id", columns: tuple[str, ...] = ("text",), *, raw: bool = False) -> DataFrame:
    """``(query_id, doc_id, score)`` of all matching pairs, higher is better: an OR of the question's phrases. A phrase of
    several terms matches where they stand next to each other."""
    return bm25_indexed(corpus(docs, id_column, *columns, raw=raw), questions)


def bm25_indexed(indexed: DataFrame, questions: DataFrame) -> DataFrame:
    """The same over ``indexed(doc_id, terms, dl)``, such as a stored index."""
    asked = question_phrases(questions).groupBy("query_id", "phrase").agg(F.count("*").alias("times"))
    phrases = asked.select("phrase").distinct()
    longest = phrases.agg(F.max(F.size("phrase"))).first()[0] or 1  # at most as many as a token has parts
    # a row per place, with as many terms as the longest phrase has, so that no row drags its document along; and one without
    # terms per document, which carries its length: all that follows comes from one grouping, so texts are read and cut once
    if longest == 1:
        places = indexed.select("doc_id", "dl", F.explode(F.concat(F.array(F.lit("")), "terms")).alias("term")).withColumn("window", F.array("term"))
    else:
        windows = F.transform("terms", lambda _, i: F.slice("terms", i + 1, longest))
        places = indexed.select("doc_id", "dl", F.explode(F.concat(F.array(F.array(F.lit(""))), windows)).alias("window")).withColumn("term", F.element_at("window", 1))
    blank = F.array(F.lit(""))
    heads = phrases.select(F.element_at("phrase", 1).alias("term"), "phrase").union(questions.sparkSession.range(1).select(F.lit(""), blank))
    hits = places.join(heads, "term").where(F.slice("window", 1, F.size("phrase")) == F.col("phrase"))
    # the mark is an aggregate, so that no filter on it goes below the grouping and the shuffle serves every use
    counted = hits.groupBy("doc_id", "phrase").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"), F.max(F.col("phrase") == blank).alias("whole"))
    stats = counted.where("whole").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    matched = counted.where("not whole")
    df = matched.groupBy("phrase").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(C.IDF_FLOOR))
    weight = idf * F.col("tf") * (C.BM25_K1 + 1) / (F.col("tf") + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * F.col("dl") / F.col("avgdl")))
    scored = matched.join(df, "phrase").join(F.broadcast(stats)).select("doc_id", "phrase", weight.alias("weight"))  # stats: one row
    return scored.join(asked, "phrase").groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * F.col("times")).alias("score"))


def ranked(scored: DataFrame, limit: int, score: str = "score", item: str = "doc_id", by: str = "query_id") -> DataFrame:
    """The best rows of each question with their 1-based rank; near-equal scores (9 digits) go to the smaller id."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.round(score, 9).desc(), item))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Questions that one pass over the vectors serves: what a broadcast of them holds at most.
ASKED = 4096


def _dense_best(ids: pa.Array, asked: np.ndarray, limit: int, width: int):
    """Scores a task's vectors against the asked ones; each batch lets its best ``limit`` of each question go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1))
            batch = batch.filter(pc.fill_null(pc.equal(sizes, width), False))
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                v = np.nan_to_num(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width))
                norm = np.linalg.norm(v, axis=1)
                at = np.flatnonzero(norm > 0)
                if not len(at):
                    continue
                score = np.round(asked @ (v[at] / norm[at, None]).T, 12)
                keep = min(limit, len(at))
                low = np.partition(np.round(score, 9), len(at) - keep, axis=1)[:, len(at) - keep]
                rows, cols = np.nonzero(np.round(score, 9) >= low[:, None])  # ties at the last place go on together
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), part.column(0).take(pa.array(at[cols])), pa.array(score[rows, cols])], names=["query_id", "vec_id", "score"])

    return run


def cosine_topk(vectors: DataFrame, queries: DataFrame, limit: int = C.TOP_K) -> DataFrame:
    """``(query_id, vec_id, score, rank)``. Both sides are ``(id, embedding)``. Questions are broadcast in parts of about
    ``ASKED``, and each part is one pass over the vectors: a task scores its batches as matrix products and lets only the best
    ``limit`` of each question go on, so the shuffle carries neither vectors nor pairs of low rank. Null vectors, zero
    vectors and those of another length than most questions' are left out."""
    asked = queries.where("embedding is not null").select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    total, width = asked.agg(F.count("*"), F.mode(F.size("embedding"))).first()
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {vectors.schema['vec_id'].dataType.simpleString()}, score double"
    parts = max(1, -(-total // ASKED))
    found = None
    for i in range(parts):
        rows = asked.where((F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) & (F.size("embedding") == F.lit(width))).toArrow()
        v = np.nan_to_num(rows.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)) if rows.num_rows else np.empty((0, 1))
        norm = np.linalg.norm(v, axis=1)
        held = np.flatnonzero(norm > 0)
        if not len(held):
            continue
        run = _dense_best(rows.column(0).combine_chunks().take(pa.array(held)), v[held] / norm[held, None], limit, width)
        best = vectors.select("vec_id", "embedding").where("embedding is not null").mapInArrow(run, kinds)
        found = best if found is None else found.union(best)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], kinds)
    return ranked(found, limit, item="vec_id")


def variants(questions: DataFrame, expansions: tuple = C.EXPANSIONS) -> DataFrame:
    """``(query_id, variant, text)``: the question and its expansions, distinct, 2 for simple relation questions, else 4."""
    low = F.lower("text")
    more = [F.when(T.contains_any(low, [t.lower() for t in triggers]), F.concat("text", F.lit(" " + words))) for triggers, words in expansions]
    kept = F.slice(F.array_distinct(F.array_compact(F.array("text", *more))), 1, F.when(T.simple_relation(F.col("text")), C.SIMPLE_VARIANTS).otherwise(C.VARIANTS))
    return questions.select("query_id", F.posexplode(kept).alias("variant", "text"))


def with_rewrites(rows: DataFrame, rewrites: DataFrame, most: int = C.REWRITES) -> DataFrame:
    """``(query_id, variant, text)`` of ``variants`` with a model's rewrites ``(query_id, at, text)`` between the question and its
    expansions: at most ``most`` of a question, without repeats and blanks, all of them cut to the question's limit."""
    written = rewrites.where(T.strip(F.coalesce("text", F.lit(""))) != "").groupBy("query_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), 1, most).alias("more"))
    all_ = rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("variant", "text"))), lambda x: x["text"]).alias("own")).join(written, "query_id", "left")
    first = F.slice("own", 1, 1)
    texts = F.array_distinct(F.concat(first, F.coalesce("more", F.array().cast("array<string>")), F.slice("own", 2, C.VARIANTS)))
    return all_.select("query_id", F.posexplode(F.slice(texts, 1, F.when(T.simple_relation(F.element_at("own", 1)), C.SIMPLE_VARIANTS).otherwise(C.VARIANTS))).alias("variant", "text"))


def wiki_search(pages: DataFrame, questions: DataFrame, limit: int = C.WIKI_PAGES) -> DataFrame:
    """``(query_id, page_id, rank, score)``: the best pages ``(page_id, title, content)`` of each question over the raw texts of
    title and content."""
    return ranked(bm25(pages, questions, "page_id", ("title", "content"), raw=True), limit).withColumnRenamed("doc_id", "page_id")


def reranked(candidates: DataFrame, orders: DataFrame) -> DataFrame:
    """Candidates ``(query_id, chunk_id, position)`` in a model's order ``(query_id, ids array)``: named ids first, in the order
    in which they were named; the others after them as they stood."""
    place = orders.select("query_id", F.posexplode(F.array_distinct("ids")).alias("place", "chunk_id"))
    rows = candidates.join(place, ["query_id", "chunk_id"], "left")
    new = F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("place", F.lit(999)), "position"))
    return rows.withColumn("position", new).drop("place")


def hybrid_search(questions: DataFrame, chunks: DataFrame, pages: DataFrame, vectors: DataFrame, asked_vectors: DataFrame, relations: DataFrame, limit: int = C.SEARCH_LIMIT, *, allowed: DataFrame | None = None, rewrites: DataFrame | None = None) -> DataFrame:
    """The whole search for a batch of questions ``(query_id, text)``: variants through the lexical, page and vector channels,
    fusion, graph expansion from the best of them, pool, contents filter, boosts; ``limit`` rows of each question.

    ``chunks(chunk_id, document_id, title, heading_path, content, page)``; ``pages(page_id, title, content)``;
    ``vectors(vec_id, embedding)`` by chunk_id; ``asked_vectors(query_id, variant, embedding)``; ``relations`` as for
    ``graph_channel``; ``allowed(document_id)`` keeps ranks and drops rows of other documents. Returns ``query_id, position,
    chunk_id, rrf_score, channels, concept_boost, domain_boost, final_score, wiki_refs, dense_reason``."""
    spoken = variants(questions)
    spoken = with_rewrites(spoken, rewrites) if rewrites is not None else spoken
    keyed = spoken.select(F.struct("query_id", "variant").alias("query_id"), "text")
    own = lambda df: df.withColumn("query_id", F.col("query_id.query_id"))
    inside = chunks.join(allowed, "document_id", "left_semi") if allowed is not None else chunks
    known = inside.select("chunk_id")

    def filtered(rows: DataFrame) -> DataFrame:
        return rows.join(known, "chunk_id", "left_semi") if allowed is not None else rows

    lexical = ranked(bm25(chunks, keyed, "chunk_id", ("title", "heading_path", "content")), C.TOP_K)
    lexical = filtered(own(channel_scores(lexical, "bm25")))
    paged = own(wiki_channel(wiki_search(pages, keyed), pages))
    paged = filtered(paged)
    early = lexical.unionByName(paged.select(*lexical.columns))
    hits = early.groupBy("query_id").agg(F.countDistinct("chunk_id").alias("hits"))
    gate = questions.join(hits, "query_id", "left").select("query_id", dense_skip_reason(F.col("text"), F.coalesce("hits", F.lit(0)), limit).alias("dense_reason"))
    dense = cosine_topk(vectors, asked_vectors.join(spoken, ["query_id", "variant"], "left_semi").select(F.struct("query_id", "variant").alias("query_id"), "embedding"))
    dense = filtered(own(channel_scores(dense, "dense", item="vec_id"))).join(gate.where("dense_reason is null"), "query_id", "left_semi")
    scored = fused(early, dense.select(*lexical.columns))
    seeds = ranked(scored, max(limit, C.SEED_MIN), "rrf_score", "chunk_id").select("query_id", "chunk_id")
    linked = filtered(graph_channel(seeds, relations)).select("query_id", "chunk_id", "score", F.lit("graph").alias("channel"))
    again = scored.select("query_id", "chunk_id", F.col("rrf_score").alias("score"), F.explode_outer("channels").alias("channel"))
    first = F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("channel"))
    again = again.withColumn("score", F.when(first == 1, F.col("score")).otherwise(0.0))  # a chunk's score counts once
    best = pool(fused(again, linked), limit)
    refs = paged.groupBy("query_id", "chunk_id").agg(F.array_distinct(F.flatten(F.collect_list(F.transform("refs", lambda r: F.struct(r["page_id"].alias("page_id"), r["title"].alias("title")))))).alias("wiki_refs"))
    asked = questions.select("query_id", F.col("text").alias("question"), T.domains(F.col("text")).alias("query_domains"))
    rows = best.join(asked, "query_id").join(inside, "chunk_id").join(refs, ["query_id", "chunk_id"], "left").join(gate, "query_id", "left")
    rows = boosted(without_toc(rows.withColumn("document_domains", T.domains(F.col("title"), "title")), limit))
    position = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final_score"), "pool_rank"))
    return rows.withColumn("position", position).where(F.col("position") <= limit).select("query_id", "position", "chunk_id", "rrf_score", "channels", "concept_boost", "domain_boost", "final_score", F.coalesce("wiki_refs", F.array().cast(refs.schema["wiki_refs"].dataType)).alias("wiki_refs"), "dense_reason")


def channel_scores(top: DataFrame, channel: str, k: int = C.RRF_K, item: str = "doc_id") -> DataFrame:
    return top.select("query_id", F.col(item).alias("chunk_id"), (1 / (F.lit(k) + F.col("rank"))).alias("score"), F.lit(channel).alias("channel"))


def fused(*channels: DataFrame) -> DataFrame:
    """``(query_id, chunk_id, rrf_score, channels)``: reciprocal ranks summed over channels and variants."""
    rows = reduce(lambda a, b: a.unionByName(b), channels)
    return rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum("score"), 9).alias("rrf_score"), F.array_sort(F.collect_set("channel")).alias("channels"))


def pool(scores: DataFrame, limit: int = C.CANDIDATES) -> DataFrame:
    return ranked(scores, max(C.POOL_MIN, C.POOL_FACTOR * limit), "rrf_score", "chunk_id").withColumnRenamed("rank", "pool_rank")


def source_filter(rows: DataFrame, documents: DataFrame, ids: list[int] | None = None, releases: list[str] | None = None) -> DataFrame:
    """Rows of allowed documents; no filter if neither is given. Applied after ranking, so ranks keep their gaps."""
    if ids is None and releases is None:
        return rows
    allowed = documents
    if ids is not None:
        allowed = allowed.where(F.col("doc_id").isin(*ids) if ids else F.lit(False))
    if releases is not None:
        allowed = allowed.where(F.col("source").isin(*releases) if releases else F.lit(False))
    return rows.join(allowed.select("doc_id"), "doc_id", "left_semi")


def wiki_channel(top_pages: DataFrame, pages: DataFrame) -> DataFrame:
    """``(query_id, chunk_id, score, channel, refs)`` from ranked wiki pages ``(query_id, page_id, rank)`` and their content:
    the first citations of each page, scored by the best page rank and best place, once per chunk."""
    cited = pages.select("page_id", "title", F.posexplode(F.slice(T.citations(F.col("content")), 1, C.CITATIONS_PER_PAGE)).alias("place", "chunk_id"))
    met = top_pages.join(cited, "page_id")
    ref = F.struct("rank", "place", "page_id", "title")
    out = met.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("page_rank"), (F.min("place") + 1).alias("local_rank"), F.slice(F.array_sort(F.collect_list(ref)), 1, C.WIKI_REFS).alias("refs"))
    return out.select("query_id", "chunk_id", (1 / (C.WIKI_RRF_K + F.col("page_rank") + F.col("local_rank"))).alias("score"), F.lit("wiki").alias("channel"), "refs")


def dense_skip_reason(question: Column, hits: Column, limit: int = C.CANDIDATES) -> Column:
    """Why the vector channel can be left out in the fast profile; null if it can't."""
    low = F.lower(question)
    solver = T.contains_any(low, C.SOLVER_TERMS)
    enough = hits >= F.when(solver, 4).otherwise(min(8, limit))
    reason = (
        F.when(T.contains_any(low, ("autosar", "arxml")), "skip:dense_fast_path_autosar")
        .when(solver, "skip:dense_fast_path_solver")
        .when(T.contains_any(low, ("stateflow", "状态机")), "skip:dense_fast_path_stateflow")
        .when(T.contains_any(low, C.CODEGEN_TERMS), "skip:dense_fast_path_codegen")
        .when(T.simple_relation(question), "skip:dense_fast_path_simple_domain")
        .when(F.contains(low, F.lit("simulink")) & (hits >= min(10, limit)), "skip:dense_fast_path_simulink")
    )
    return F.when(T.contains_any(low, C.SKIP_DENSE_TERMS) & enough, reason)


def rerank_gate(question: Column, candidates: Column, in_domain: Column, final: int = C.FINAL_EVIDENCE) -> Column:
    short = (F.size(T.lexical_tokens(question)) <= 3) & (candidates <= 12) & ~T.contains_any(F.lower(question), C.COMPLEX_CUES)
    return (
        F.when(candidates <= final, "skip:not_enough_extra_candidates")
        .when(T.simple_relation(question), "skip:simple_relation")
        .when(in_domain >= final, "skip:domain_enough")
        .when(short, "skip:short_query")
        .otherwise("use:complex_or_many_candidates")
    )


def toc_like(content: Column, heading: Column, page: Column) -> Column:
    """Whether a chunk looks like a table of contents (never past page 35)."""
    low = F.lower(T.strip(content))
    dots = F.floor((F.length(content) - F.length(F.replace(content, F.lit(". . .")))) / 5)
    refs = F.regexp_count(content, F.lit("\\b\\d+-\\d+\\b"))
    on_page = F.floor((F.length(low) - F.length(F.replace(low, F.lit(" on page ")))) / 9)
    opens = (F.coalesce(heading, F.lit("")) == "") & low.startswith("contents ")
    return ~F.coalesce(page > 35, F.lit(False)) & (opens | (dots >= 3) | (refs >= 8) | (on_page >= 5))


def without_toc(candidates: DataFrame, limit: int) -> DataFrame:
    """Drops contents-like candidates of a question if at least ``limit`` others remain."""
    flag = toc_like(F.col("content"), F.col("heading_path"), F.col("page"))
    left = F.count_if(~F.col("toc")).over(Window.partitionBy("query_id"))
    return candidates.withColumn("toc", flag).withColumn("left", left).where(~F.col("toc") | (F.col("left") < limit)).drop("toc", "left")


def concept_boost(question: Column, heading: Column, content: Column) -> Column:
    q, t = F.lower(question), F.lower(F.concat_ws(" ", heading, content))

    def has(word: str) -> Column:
        return F.contains(t, F.lit(word))

    chart = F.when(T.contains_any(q, ("stateflow", "状态机")), F.when(has("finite state machine"), 0.04).otherwise(0.0) + F.when(has("model a finite state machine"), 0.03).otherwise(0.0) + F.when(has("types of stateflow blocks"), 0.02).otherwise(0.0)).otherwise(0.0)
    parts = F.when(F.contains(q, F.lit("autosar")) & (has("component") | has("composition")), 0.02).otherwise(0.0)
    steps = F.when(T.contains_any(q, ("solver", "求解器")) & (has("fixed-step") | has("variable-step")), 0.02).otherwise(0.0)
    return F.when(T.contains_any(q, C.DEFINITION_BOOST_CUES), chart + parts + steps).otherwise(0.0)


def boosted(candidates: DataFrame) -> DataFrame:
    """Adds concept and domain boosts and the final score. Candidates of the graph channel alone get no concept boost and at
    most 0.01 for their domain."""
    alone = F.col("channels") == F.array(F.lit("graph"))
    shared = F.size(F.array_intersect("query_domains", "document_domains"))
    domain = F.least(F.lit(0.08), 0.04 * shared)
    out = candidates.withColumn("concept_boost", F.when(alone, 0.0).otherwise(concept_boost(F.col("question"), F.col("heading_path"), F.col("content"))))
    out = out.withColumn("domain_boost", F.when(alone, F.least(F.lit(0.01), domain)).otherwise(domain))
    return out.withColumn("final_score", F.round(F.col("rrf_score") + F.col("concept_boost") + F.col("domain_boost"), 9))


def entity_matches(entities: DataFrame, questions: DataFrame) -> DataFrame:
    """``(query_id, entity_id)``: the label or an alias stands in the question, or both share a token of four characters.

    Labels meet questions through shared tokens, not pair by pair: a label that stands in a text shares its longest token
    with it, whole or as part of a word, so parts of three characters are the join key and the text is then checked."""
    def grams(text: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3))))

    low = F.lower("text")
    names = entities.select("entity_id", F.explode(F.array_union(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).select("entity_id", F.lower("name").alias("name")).where(F.length("name") >= 3)
    keyed = names.withColumn("key", F.substring("name", 1, 3))
    asked = questions.select("query_id", low.alias("q"), F.explode(grams(low)).alias("key"))
    inside = asked.join(keyed, "key").where(F.contains("q", "name")).select("query_id", "entity_id")
    long = lambda c: F.filter(T.lexical_tokens(c), lambda x: F.length(x) >= 4)
    shared = questions.select("query_id", F.explode(long(F.col("text"))).alias("token")).join(entities.select("entity_id", F.explode(long(F.col("label"))).alias("token")), "token").select("query_id", "entity_id")
    return inside.union(shared).distinct()


def graph_channel(seeds: DataFrame, relations: DataFrame, matched: DataFrame | None = None, domains: DataFrame | None = None, limit: int = C.GRAPH_TOP) -> DataFrame:
    """One-hop expansion: ``(query_id, chunk_id, score, reasons)``.

    ``seeds(query_id, chunk_id)``; ``relations(relation_id, source_id, target_id, refs, weight, confidence)``;
    ``matched(query_id, entity_id)``; ``domains(query_id, chunk_id)`` where domains agree. A relation that cites a seed
    brings in its other references; matched entities and domains only add to those."""
    refs = relations.select("relation_id", "source_id", "target_id", "weight", "confidence", F.explode("refs").alias("chunk_id"))
    touched = refs.join(seeds, "chunk_id").select("query_id", "relation_id").distinct()
    found = touched.join(refs, "relation_id").join(seeds, ["query_id", "chunk_id"], "left_anti")
    weight = F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight"))
    trust = F.when(F.coalesce("confidence", F.lit(0.0)) == 0, 0.7).otherwise(F.col("confidence"))
    found = found.withColumn("score", 0.012 * F.least(F.lit(1.2), F.greatest(F.lit(0.5), weight))).withColumn("named", F.lit(False))
    if matched is not None:
        hit = touched.join(relations.select("relation_id", F.explode(F.array("source_id", "target_id")).alias("entity_id")), "relation_id").join(matched, ["query_id", "entity_id"]).select("query_id", "relation_id", F.lit(True).alias("hit")).distinct()
        found = found.join(hit, ["query_id", "relation_id"], "left").withColumn("named", F.coalesce("hit", F.lit(False))).drop("hit")
        found = found.withColumn("score", F.col("score") + F.when(F.col("named"), 0.006 * F.least(F.lit(1.0), F.greatest(F.lit(0.5), trust))).otherwise(0.0))
    out = found.groupBy("query_id", "chunk_id").agg(F.sum("score").alias("score"), F.max("named").alias("named"))
    if domains is not None:
        out = out.join(domains.select("query_id", "chunk_id", F.lit(True).alias("aligned")).distinct(), ["query_id", "chunk_id"], "left")
    else:
        out = out.withColumn("aligned", F.lit(None).cast("boolean"))
    aligned = F.coalesce("aligned", F.lit(False))
    total = F.round(F.least(F.col("score") + F.when(aligned, 0.003).otherwise(0.0), F.lit(C.GRAPH_CAP)), 6)
    reasons = F.array_compact(F.array(F.when(aligned, "domain_aligned"), F.when(F.col("named"), "query_entity"), F.lit("seed_relation")))
    return ranked(out.select("query_id", "chunk_id", total.alias("score"), reasons.alias("reasons")), limit, item="chunk_id")
