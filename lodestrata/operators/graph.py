"""Knowledge graph: rule entities of pages, co-occurrence relations, degrees, views, neighbourhoods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata import config as C
from lodestrata.functions import text as T

PHRASE = "(?U)\\b[A-Z][A-Za-z0-9/+.-]*(?:\\s+[A-Z][A-Za-z0-9/+.-]*){0,4}\\b"


def phrases(pages: DataFrame, limit: int = 18) -> DataFrame:
    """``(page_id, phrase, n, first_at)``: a page's most frequent capitalized phrases, ties by first use."""
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("content", F.lit(PHRASE), F.lit(0))).alias("at", "phrase"))
    counted = found.groupBy("page_id", "phrase").agg(F.count("*").alias("n"), F.min("at").alias("first_at"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("n"), "first_at"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= limit)


def page_entities(pages: DataFrame, limit: int = C.RULE_ENTITIES) -> DataFrame:
    """``(page_id, position, entity_key, label, entity_type, source, confidence)`` by rules: parts of the title and links,
    headings, phrases; one per key, the first wins. ``pages(page_id, title, content)``."""
    titles = F.slice(F.filter(F.transform(F.split(F.coalesce("title", F.lit("")), "/"), T.strip), lambda x: x != ""), 1, 3)
    links = pages.select("page_id", F.posexplode(F.concat(titles, T.wiki_links(F.coalesce("content", F.lit(""))))).alias("at", "raw"), F.lit("wiki_link").alias("source"), F.lit(0.9).alias("confidence"), F.lit(1).alias("kind"))
    headings = pages.select("page_id", F.posexplode(F.slice(F.regexp_extract_all("content", F.lit("(?m)^#{1,4}\\s+(.+)$"), F.lit(1)), 1, 16)).alias("at", "raw"), F.lit("heading").alias("source"), F.lit(0.78).alias("confidence"), F.lit(2).alias("kind"))
    spoken = phrases(pages).select("page_id", F.col("rank").alias("at"), F.col("phrase").alias("raw"), F.lit("phrase").alias("source"), F.lit(0.68).alias("confidence"), F.lit(3).alias("kind"))
    described = T.let(T.canonical_label(F.col("raw")), lambda x: F.struct(x.alias("label"), T.valid_label(x).alias("valid"), T.slug(x).alias("entity_key"), T.entity_type(x).alias("entity_type")))
    rows = links.unionByName(headings).unionByName(spoken).withColumn("d", described).select("page_id", "at", "source", "confidence", "kind", "d.*")
    rows = rows.where(F.col("valid") & ((F.col("kind") != 3) | ~F.col("label").isin(*C.PHRASE_STOPS)))
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("page_id", "entity_key").orderBy("kind", "at"))).where("rn = 1")
    position = F.row_number().over(Window.partitionBy("page_id").orderBy("kind", "at"))
    return first.withColumn("position", position).where(F.col("position") <= limit).select("page_id", "position", "entity_key", "label", "entity_type", "source", "confidence")


def entities(mentions: DataFrame, pages: DataFrame) -> DataFrame:
    """``(entity_key, label, entity_type, source, confidence, wiki_count, evidence_count)``: the first page that names an
    entity gives its label; confidence is the highest; counts are of pages and of distinct citations."""
    cited = pages.select("page_id", F.explode(T.citations(F.coalesce("content", F.lit("")))).alias("chunk_id"))
    counts = mentions.select("page_id", "entity_key").join(cited, "page_id").groupBy("entity_key").agg(F.countDistinct("chunk_id").alias("evidence_count"))
    at = F.struct("page_id", "position")
    out = mentions.groupBy("entity_key").agg(*[F.min_by(c, at).alias(c) for c in ("label", "entity_type", "source")], F.max("confidence").alias("confidence"), F.countDistinct("page_id").alias("wiki_count"))
    return out.join(counts, "entity_key", "left").withColumn("evidence_count", F.coalesce("evidence_count", F.lit(0).cast("long")))


def cooccurrences(mentions: DataFrame, strong: int = C.STRONG_ENTITIES, reach: int = C.NEXT_ENTITIES) -> DataFrame:
    """``(source_key, target_key, pages, first_page)``: pairs of a page's first entities within ``reach`` places of each
    other, once per direction. Each mention is offset to the places it may pair with, so the join is an equality."""
    rows = mentions.where(F.col("position") <= strong).select("page_id", "position", "entity_key")
    ahead = rows.withColumn("place", F.explode(F.array(*[F.col("position") + d for d in range(1, reach + 1)])))
    behind = rows.select("page_id", F.col("position").alias("place"), F.col("entity_key").alias("target_key"))
    pairs = ahead.withColumnRenamed("entity_key", "source_key").join(behind, ["page_id", "place"]).where("source_key <> target_key")
    return pairs.groupBy("source_key", "target_key").agg(F.countDistinct("page_id").alias("pages"), F.min("page_id").alias("first_page"))


def relations(pairs: DataFrame, stated: DataFrame | None = None) -> DataFrame:
    """One relation per (source, target, type): stated ones first, then co-occurrence with its fixed weight."""
    out = pairs.select("source_key", "target_key", F.lit("co_occurs").alias("relation_type"), F.lit(0.45).alias("weight"), F.lit(0.55).alias("confidence"), F.col("first_page").alias("page"), F.lit(1).alias("kind"))
    if stated is not None:
        valid = stated.where(F.col("relation_type").isin(*C.RELATION_TYPES) & (F.col("source_key") != F.col("target_key")))
        out = out.unionByName(valid.select("source_key", "target_key", "relation_type", "weight", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")).alias("confidence"), "page", F.lit(0).alias("kind")))
    first = F.row_number().over(Window.partitionBy("source_key", "target_key", "relation_type").orderBy("kind", "page"))
    return out.withColumn("rn", first).where("rn = 1").drop("rn", "kind", "page")


def degrees(edges: DataFrame) -> DataFrame:
    """``(node, degree)`` of edges ``(src, dst)``."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def merged_nodes(nodes: DataFrame) -> DataFrame:
    """One row per node id; of each attribute the last value that isn't null, in the order of ``seq``."""
    rest = [c for c in nodes.columns if c not in ("node", "seq")]
    return nodes.groupBy("node").agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in rest])


def merged_edges(edges: DataFrame) -> DataFrame:
    """One row per (src, dst, edge_type): the first in the order of ``seq``."""
    return edges.groupBy("src", "dst", "edge_type").agg(F.min("seq").alias("seq"))


#: So many of the most used labels are looked for in each page at first.
MOST_USED = 64
#: A place in a text is found by counting from its start, so texts are cut into stretches of so many places first.
STRETCH = 256


def page_mentions(pages: DataFrame, known: DataFrame, limit: int = 18) -> DataFrame:
    """``(page_id, entity_key, rank)``: entities whose label stands in a page's text, at most ``limit`` by counts. The first
    ``MOST_USED`` labels in that order are looked for in every page; where ``limit`` of them stand, no other label can count.
    Pages with fewer are met with all labels."""
    order = (F.desc("wiki_count"), F.desc("evidence_count"), F.desc("confidence"), F.col("entity_key"))
    labels = known.where(F.length("label") >= 2).select("entity_key", "wiki_count", "evidence_count", "confidence", F.lower("label").alias("low"))
    texts = pages.select("page_id", F.lower(F.concat_ws("\n", "title", "content")).alias("text"))
    most = labels.orderBy(*order).limit(MOST_USED).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    most = most.agg(F.array_sort(F.collect_list(F.struct("rank", "entity_key", "low"))).alias("most"))  # one row
    tried = texts.join(F.broadcast(most)).withColumn("held", F.filter("most", lambda x: F.contains(F.col("text"), x["low"]))).drop("most")
    full = tried.where(F.size("held") >= limit).select("page_id", F.posexplode(F.slice("held", 1, limit)).alias("at", "x"))
    met = _met_labels(tried.where(F.size("held") < limit).select("page_id", "text"), labels)
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(*order))
    rest = met.withColumn("rank", rank).where(F.col("rank") <= limit).select("page_id", "entity_key", "rank")
    return full.select("page_id", F.col("x.entity_key").alias("entity_key"), (F.col("at") + 1).alias("rank")).unionByName(rest)


def _met_labels(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels`` that stand in ``texts(page_id, text)``. They meet on the label's first ten characters (eight, six, four, or
    all, of shorter ones), which a page has once per distinct string and carries without its text; the text is fetched for
    what meets, and the whole label is looked for."""
    n = F.length("low")
    size = F.when(n >= 10, 10).when(n >= 8, 8).when(n >= 6, 6).when(n >= 4, 4).otherwise(n)
    heads_of = labels.withColumn("head", F.substring("low", F.lit(1), size))

    none = F.array().cast("array<string>")

    def strings(n: int) -> Column:
        def of(part: Column) -> Column:
            return F.when(F.length(part) >= n, F.transform(F.sequence(F.lit(1), F.length(part) - n + 1), lambda i: F.substring(part, i, F.lit(n)))).otherwise(none)

        parts = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / STRETCH).cast("int")), lambda k: F.substring("text", k * STRETCH + 1, F.lit(STRETCH + n - 1)))
        return F.array_distinct(F.flatten(F.transform(parts, of)))

    heads = texts.select("page_id", F.explode(F.concat(*[strings(n) for n in (2, 3, 4, 6, 8, 10)])).alias("head"))
    return heads.join(heads_of, "head").drop("head").join(texts, "page_id").where(F.contains("text", "low"))


def neighbourhood(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges among the chosen nodes and their direct neighbours."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src"))
    near = both.join(chosen.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).union(chosen.select("node")).distinct()
    inside = edges.join(near.withColumnRenamed("node", "src"), "src", "left_semi")
    return inside.join(near.withColumnRenamed("node", "dst"), "dst", "left_semi")


def top_view(edges: DataFrame, nodes: int, most_edges: int = 900) -> DataFrame:
    """The graph view: edges among the ``nodes`` of highest degree, capped, by the ends' degrees."""
    best = degrees(edges).orderBy(F.desc("degree"), "node").limit(nodes)
    ends = edges.join(best.select(F.col("node").alias("src"), F.col("degree").alias("a")), "src").join(best.select(F.col("node").alias("dst"), F.col("degree").alias("b")), "dst")
    return ends.orderBy(F.desc(F.col("a") + F.col("b")), "src", "dst").limit(most_edges).select("src", "dst")


def compiled(pages: DataFrame, stated: tuple[DataFrame, DataFrame] | None = None, newest: int = C.GRAPH_PAGES) -> tuple[DataFrame, DataFrame]:
    """The knowledge graph of the ``newest`` pages ``(page_id, title, content, updated)``, rebuilt as a whole.

    Entities ``(entity_key, label, entity_type, source, confidence, wiki_count, evidence_count)`` come by rules and from
    ``stated`` entities of a model, which replace those of a lower confidence in their place; at most ``PAGE_ENTITIES`` of a
    page. Relations ``(source_key, target_key, relation_type, label, weight, confidence, page_id, evidence_refs)`` are the
    stated ones whose ends are entities, then co-occurrences of a page's first entities, each once."""
    chosen = pages.orderBy(F.desc("updated"), "page_id").limit(newest)
    mentions = page_entities(chosen)
    if stated is not None:
        more = stated[0].select("page_id", (F.col("at") + 1000).alias("position"), "entity_key", "label", "entity_type", F.lit("llm").alias("source"), "confidence")
        key = Window.partitionBy("page_id", "entity_key")
        both = mentions.unionByName(more).withColumn("first", F.min("position").over(key))
        best = both.withColumn("rn", F.row_number().over(key.orderBy(F.desc("confidence"), "position"))).where("rn = 1")
        place = F.row_number().over(Window.partitionBy("page_id").orderBy("first"))
        mentions = best.withColumn("position", place).where(F.col("position") <= C.PAGE_ENTITIES).drop("rn", "first")
    nodes = entities(mentions, chosen)
    cited = chosen.select("page_id", F.array_sort(T.citations(F.coalesce("content", F.lit("")))).alias("refs"))
    near = cooccurrences(mentions).select("source_key", "target_key", F.lit("co_occurs").alias("relation_type"), F.lit("co_occurs").alias("label"), F.lit(0.45).alias("weight"), F.lit(0.55).alias("confidence"), F.col("first_page").alias("page_id"), F.lit(6).alias("most"), F.lit(1).alias("kind"), F.lit(0).alias("at"))
    if stated is not None:
        said = stated[1].select("source_key", "target_key", "relation_type", "label", F.lit(1.0).alias("weight"), "confidence", "page_id", F.lit(12).alias("most"), F.lit(0).alias("kind"), "at")
        near = said.unionByName(near)
    whole = known_ends(near, nodes)
    first = F.row_number().over(Window.partitionBy("source_key", "target_key", "relation_type").orderBy("kind", "page_id", "at"))
    rows = whole.withColumn("rn", first).where("rn = 1").join(cited, "page_id", "left")
    return nodes, rows.select("source_key", "target_key", "relation_type", "label", "weight", "confidence", "page_id", F.slice(F.coalesce("refs", F.array().cast("array<long>")), F.lit(1), F.col("most")).alias("evidence_refs"))


def known_ends(relations: DataFrame, entities_: DataFrame) -> DataFrame:
    """Relations both of whose ends are entities; dangling ones go."""
    keys = entities_.select("entity_key")
    inside = relations.join(keys.withColumnRenamed("entity_key", "source_key"), "source_key", "left_semi")
    return inside.join(keys.withColumnRenamed("entity_key", "target_key"), "target_key", "left_semi").select(*relations.columns)


def page_links(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Wiki links of ``pages(page_id, slug, title, content)``: ``(src, dst)`` slugs where a link names a page's title (the last
    page of a title), and ``(page_id, concept)`` of the others."""
    links = pages.select("page_id", "slug", F.explode(T.wiki_links(F.coalesce("content", F.lit("")))).alias("concept"))
    titles = pages.groupBy(F.col("title").alias("concept")).agg(F.max_by("slug", "page_id").alias("dst"))
    met = links.join(titles, "concept", "left")
    return met.where("dst is not null").select(F.col("slug").alias("src"), "dst"), met.where("dst is null").select("page_id", "concept")


def hetero_graph(documents: DataFrame, pages: DataFrame, chunks: DataFrame, entities_: DataFrame, relations_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The whole graph: nodes ``(node, type, label)`` and edges ``(src, dst, edge_type)``.

    Documents, wiki pages, cited chunks and entities are nodes; pages come from documents, cite chunks, link to pages by title
    and mention entities; chunks come from documents; relations join entities. Without entities, links that name no page
    become concepts. ``documents(document_id, title)``, ``pages(page_id, slug, title, content, document_id)``,
    ``chunks(chunk_id, document_id)``."""
    node = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
    edge = lambda df, src, dst, kind: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("edge_type"))
    cited = pages.select("slug", F.explode(T.citations(F.coalesce("content", F.lit("")))).alias("chunk_id"))
    linked, concepts = page_links(pages)
    bare = entities_.agg((F.count("*") == 0).alias("bare"))  # one row
    named = concepts.join(pages.select("page_id", "slug"), "page_id").withColumn("key", T.slug(F.col("concept"))).join(F.broadcast(bare)).where("bare")
    mentions = page_mentions(pages, entities_).join(pages.select("page_id", "slug"), "page_id")
    nodes = [
        documents.select(node("doc", "document_id").alias("node"), F.lit("document").alias("type"), F.col("title").alias("label")),
        pages.select(node("wiki", "slug").alias("node"), F.lit("wiki_page").alias("type"), F.col("title").alias("label")),
        cited.select(node("evidence", "chunk_id").alias("node"), F.lit("evidence").alias("type"), F.concat(F.lit("E:"), F.col("chunk_id").cast("string")).alias("label")).distinct(),
        entities_.select(node("entity", "entity_key").alias("node"), F.lit("entity").alias("type"), "label"),
    ]
    edges = [
        edge(pages.where("document_id is not null"), node("doc", "document_id"), node("wiki", "slug"), "compiled_to"),
        edge(cited, node("wiki", "slug"), node("evidence", "chunk_id"), "cites"),
        edge(linked, node("wiki", "src"), node("wiki", "dst"), "links_to"),
        edge(mentions, node("wiki", "slug"), node("entity", "entity_key"), "mentions"),
        edge(chunks.join(cited.select("chunk_id").distinct(), "chunk_id", "left_semi"), node("evidence", "chunk_id"), node("doc", "document_id"), "from_document"),
        relations_.select(node("entity", "source_key").alias("src"), node("entity", "target_key").alias("dst"), F.col("relation_type").alias("edge_type")),
    ]
    nodes.append(named.groupBy(node("concept", "key").alias("node")).agg(F.lit("concept").alias("type"), F.max_by("concept", "page_id").alias("label")))
    edges.append(edge(named, node("wiki", "slug"), node("concept", "key"), "mentions"))
    union = lambda parts: reduce(lambda a, b: a.unionByName(b), parts)
    return union(nodes), union(edges).distinct()


def wiki_context(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """``(node, entities, evidence, outlinks, backlinks)`` of the pages ``(node)``: the first 12 entities, 18 chunks, 12 pages each
    links to and 12 that link to it, by name."""
    mine = edges.join(pages.select(F.col("node").alias("src")), "src", "left_semi")
    few = lambda df, by, item, most, name: df.groupBy(F.col(by).alias("node")).agg(F.slice(F.array_sort(F.collect_set(item)), 1, most).alias(name))
    out = pages.select("node")
    for part in (
        few(mine.where("edge_type = 'mentions'"), "src", "dst", 12, "entities"),
        few(mine.where("edge_type = 'cites'"), "src", "dst", 18, "evidence"),
        few(mine.where("edge_type = 'links_to'"), "src", "dst", 12, "outlinks"),
        few(edges.where("edge_type = 'links_to'"), "dst", "src", 12, "backlinks"),
    ):
        out = out.join(part, "node", "left")
    return out.select("node", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("entities", "evidence", "outlinks", "backlinks")])


def rings(nodes: DataFrame, edges: DataFrame, radii: dict[str, float]) -> DataFrame:
    """``(node, type, degree, x, y)``: a ring per type, its nodes by descending degree at equal angles."""
    rows = nodes.join(degrees(edges), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))
    by = Window.partitionBy("type")
    angle = 2 * F.pi() * (F.row_number().over(by.orderBy(F.desc("degree"), "node")) - 1) / F.count("*").over(by)
    radius = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for pair in radii.items() for v in pair]), F.col("type")), F.lit(max(radii.values())))
    return rows.withColumn("a", angle).withColumn("r", radius).select("node", "type", "degree", (F.round(F.col("r") * F.cos("a"), 6) + 0.0).alias("x"), (F.round(F.col("r") * F.sin("a"), 6) + 0.0).alias("y"))
