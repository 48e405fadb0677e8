"""Composed operators on cases of their own: search under filters, evidence rules, model outputs, row changes, files."""

import io
import time
import zipfile

import pytest

from lodestrata.operators import answers, graph, records, retrieval, selection, wiki
from lodestrata.sources import files


def test_vector_parts_ties_and_odd_vectors(spark, monkeypatch):
    rows = [(i, [float(i % 3), 1.0]) for i in range(12)] + [(20, None), (21, [0.0, 0.0]), (22, [1.0]), (23, [1.0, None])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id in (0, 1, 2, 21)").withColumnRenamed("vec_id", "query_id")
    want = None
    for size in (4096, 1):
        monkeypatch.setattr(retrieval, "ASKED", size)
        got = sorted((r.query_id, r["rank"], r.vec_id) for r in retrieval.cosine_topk(vectors, asked, 3).collect())
        assert want is None or got == want
        want = got
    assert [x for x in want if x[0] == 0] == [(0, 1, 0), (0, 2, 3), (0, 3, 6)] and {x[0] for x in want} == {0, 1, 2}
    assert retrieval.cosine_topk(vectors, asked.limit(0)).count() == 0


def test_search_keeps_to_allowed_documents(spark):
    chunks = spark.createDataFrame([(i, i % 3, "title", "", f"solver step {'alpha ' * (i % 5)} word{i}", None) for i in range(30)], "chunk_id long, document_id long, title string, heading_path string, content string, page int")
    pages = spark.createDataFrame([(1, "Solver", "solver [E:4] and [E:5]"), (2, "Other", "nothing")], "page_id long, title string, content string")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "vec_id long, embedding array<double>")
    own = spark.createDataFrame([(1, v, [9.0, 1.0]) for v in range(4)], "query_id long, variant int, embedding array<double>")
    relations = spark.createDataFrame([(1, 1, 2, [4, 5, 6, 7], 1.0, 0.8)], "relation_id long, source_id long, target_id long, refs array<long>, weight double, confidence double")
    asked = spark.createDataFrame([(1, "alpha word3 steps")], "query_id long, text string")
    every = retrieval.hybrid_search(asked, chunks, pages, vectors, own, relations, 8).collect()
    assert [r.position for r in every] == list(range(1, 9)) and every == sorted(every, key=lambda r: -r.final_score)
    assert {c for r in every for c in r.channels} >= {"bm25", "dense"}
    some = retrieval.hybrid_search(asked, chunks, pages, vectors, own, relations, 8, allowed=spark.createDataFrame([(1,)], "document_id long")).collect()
    assert some and all(r.chunk_id % 3 == 1 for r in some)
    rewritten = retrieval.hybrid_search(asked, chunks, pages, vectors, own, relations, 30, rewrites=spark.createDataFrame([(1, 0, "word29"), (1, 1, " ")], "query_id long, at int, text string")).collect()
    assert 29 in {r.chunk_id for r in rewritten}


SCORED = "query_id long, question string, query_domains array<string>, chunk_id long, document_id long, ordinal long, page int, heading_path string, content string, document_domains array<string>, selector_score double, candidate_rank int, role string, evidence_role string"


def scored(i, document, domains, score, role="general", kind="general", asked=("solver", "testing"), ordinal=None, content=None):
    text = content or f"words that belong to number {i} alone {'abcdefghij'[i % 10] * 7}"
    return (1, "q", list(asked), i, document, i * 10 if ordinal is None else ordinal, None, "", text, list(domains), score, i, role, kind)


def chosen(spark, rows, **more):
    return {r.chunk_id: (r.position, r.reason) for r in selection.select_evidence(spark.createDataFrame(rows, SCORED), **more).collect()}


def test_evidence_rules(spark):
    # both domains come first though others score higher; no document gives more than three of six
    rows = [scored(i, 1, ["solver"], 0.9 - i / 100) for i in range(6)] + [scored(7, 2, ["testing"], 0.1), scored(8, 3, [], 0.5), scored(9, 4, [], 0.4)]
    got = chosen(spark, rows)
    assert got[0] == (1, None) and got[7] == (2, None) and got[1] == (3, None) and got[2] == (4, None)
    assert got[3] == (None, "document_quota") and got[8] == (None, "off_domain_after_enough_core") and got[9][0] is None
    # a relationship question takes relationship evidence of a primary domain before better general evidence
    rows = [scored(0, 1, ["solver"], 0.9, "relationship"), scored(1, 2, ["testing"], 0.8, "relationship"), scored(2, 3, ["solver"], 0.7, "relationship"), scored(3, 4, ["testing"], 0.1, "relationship", "relationship")]
    assert {i: p for i, (p, _) in chosen(spark, rows, final=3).items()} == {0: 1, 1: 2, 3: 3, 2: None}
    # one primary domain has no quota; duplicates fill up only to four
    rows = [scored(i, 1, ["solver"], 0.8 - i / 100, asked=["solver"], ordinal=0, content="the very same words in each of these chunks") for i in range(6)]
    got = chosen(spark, rows)
    assert [got[i][0] for i in range(6)] == [1, 2, 3, 4, None, None] and got[5] == (None, "duplicate_neighbor")


def test_outputs_that_are_no_json(spark):
    texts = ["", None, "no braces", "{broken", '```json\n{"entities": 5}\n```', '{"entities": [null, {"label": "Signal Router", "confidence": -3}], "relations": [{"source": "Signal Router", "target": "Signal Router"}, {"source": "Signal Router", "target": "State Chart", "type": "odd", "confidence": 9}]}']
    df = spark.createDataFrame(list(enumerate(texts)), "page_id long, answer string")
    entities, relations = answers.extracted(df)
    assert [(r.page_id, r.entity_key, r.entity_type, r.confidence) for r in entities.collect()] == [(5, "signal-router", "concept", 0.0)]
    assert [(r.source_key, r.target_key, r.relation_type, r.label, r.confidence) for r in relations.collect()] == [("signal-router", "state-chart", "relates_to", "odd", 1.0)]


def test_graph_of_the_newest_pages(spark):
    pages = spark.createDataFrame([(1, "Signal Bus / State Chart", "about Signal Bus [E:3] [E:1]", 5), (2, "State Chart", "the State Chart and Solver Step [E:1]", 9), (3, "Old Page Title", "Old Words", 1)], "page_id long, title string, content string, updated long")
    stated = answers.extracted(spark.createDataFrame([(2, '{"entities": [{"label": "Solver Step", "type": "method", "confidence": 0.95}], "relations": [{"source": "Solver Step", "target": "State Chart", "type": "part_of"}, {"source": "Solver Step", "target": "Unknown Thing"}]}')], "page_id long, answer string"))
    nodes, edges = graph.compiled(pages, stated, newest=2)
    got = {r.entity_key: r for r in nodes.collect()}
    assert {"signal-bus", "state-chart", "solver-step"} <= set(got) and "old-words" not in got
    assert got["solver-step"].confidence == 0.95 and got["solver-step"].entity_type == "method" and got["state-chart"].wiki_count == 2 and got["state-chart"].evidence_count == 2
    found = {(r.source_key, r.target_key, r.relation_type): r for r in edges.collect()}
    assert found["solver-step", "state-chart", "part_of"].weight == 1.0 and found["signal-bus", "state-chart", "co_occurs"].evidence_refs == [1, 3]
    assert not any("unknown-thing" in k for k in found)


def test_graph_without_entities_has_concepts(spark):
    pages = spark.createDataFrame([(1, "a", "A Page", "[[B Page]] [[Topic]] [E:2]", 7), (2, "b", "B Page", None, None)], "page_id long, slug string, title string, content string, document_id long")
    none = spark.createDataFrame([], "entity_key string, label string, wiki_count long, evidence_count long, confidence double")
    nodes, edges = graph.hetero_graph(spark.createDataFrame([(7, "d")], "document_id long, title string"), pages, spark.createDataFrame([(2, 7)], "chunk_id long, document_id long"), none, spark.createDataFrame([], "source_key string, target_key string, relation_type string"))
    assert {(r.node, r.type) for r in nodes.collect()} == {("doc:7", "document"), ("wiki:a", "wiki_page"), ("wiki:b", "wiki_page"), ("evidence:2", "evidence"), ("concept:topic", "concept")}
    assert {tuple(r) for r in edges.collect()} == {("doc:7", "wiki:a", "compiled_to"), ("wiki:a", "evidence:2", "cites"), ("wiki:a", "wiki:b", "links_to"), ("wiki:a", "concept:topic", "mentions"), ("evidence:2", "doc:7", "from_document")}


def test_mentions_of_the_most_used_labels(spark, monkeypatch):
    # pages 0 to 3 hold ever fewer of thirty labels, which have ties in their counts; page 4 has no text
    words = [f"{a}{b}{'xyz' * (i % 4)}" for i, (a, b) in enumerate((a, b) for a in "kmnpr" for b in "aeiou")] + ["longer label of words", "é", "éa", "ab", "b"]
    known = [(w, w.upper(), i % 5, i % 3, 0.5) for i, w in enumerate(words)]
    pages = [(p, "Page", " - ".join(words[: 30 - 6 * p])) for p in range(4)] + [(4, None, None)]
    known_rows = spark.createDataFrame(known, "entity_key string, label string, wiki_count long, evidence_count long, confidence double")
    page_rows = spark.createDataFrame(pages, "page_id long, title string, content string")
    want = set()
    for p, title, content in pages:
        text = "\n".join(x for x in (title, content) if x is not None).lower()
        held = sorted((k for k in known if len(k[0]) > 1 and k[0] in text), key=lambda k: (-k[2], -k[3], k[0]))
        want |= {(p, k[0], i + 1) for i, k in enumerate(held[:7])}
    sought, whole = [], graph._met_labels
    monkeypatch.setattr(graph, "_met_labels", lambda texts, labels: sought.append({r.page_id for r in texts.collect()}) or whole(texts, labels))
    for most in (64, 12, 1):
        monkeypatch.setattr(graph, "MOST_USED", most)
        assert {tuple(r) for r in graph.page_mentions(page_rows, known_rows, 7).collect()} == want
    assert sought[0] == {4} and sought[2] == {0, 1, 2, 3, 4}


def test_labels_in_texts_of_any_length(spark):
    # a long text takes time in proportion; labels lie over the ends of stretches, and no label comes twice
    sizes = [0, 1, 9, *range(graph.STRETCH - 12, graph.STRETCH + 12), 3 * graph.STRETCH]
    ends = [(i, "é" * n + "tail of label") for i, n in enumerate(sizes)] + [(90, "ab"), (91, "")]
    rows = [(100, "word " * 80_000 + "tail of label"), *ends]
    labels = spark.createDataFrame([(x,) for x in ("tail of label", "of la", "ab", "label", "éta", "absent")], "low string")
    began = time.monotonic()
    got = sorted((r.page_id, r.low) for r in graph._met_labels(spark.createDataFrame(rows, "page_id long, text string"), labels).collect())
    assert got == sorted((i, x.low) for i, t in rows for x in labels.collect() if x.low in t)
    assert time.monotonic() - began < 60


def test_context_of_pages_with_many_and_few_labels(spark, tmp_path, monkeypatch):
    # page 0 holds all labels, page 1 the first three, page 2 none, page 3 shares the slug of page 0; only 1 and 2 meet all labels
    import duckdb

    from lodestrata import plans

    words = [f"{a}{b}x{'yz' * (i % 3)}" for i, (a, b) in enumerate((a, b) for a in "KMNPR" for b in "aeiou")]
    spark.createDataFrame([(i, f"{w} and {words[i * i % 25]} end", "s") for i, w in enumerate(words)], "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    texts = (" or ".join(words), " or ".join(words[:3]), "nothing", " or ".join(reversed(words)))
    spark.createDataFrame([(i, f"u{i % 3}", f"<p>{t}</p>") for i, t in enumerate(texts)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    for table in ("documents", "pages"):
        duck.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    want = sorted(duck.execute(plans.oracle_sql()["wiki_context"]).fetchall())
    sought, whole = [], graph._met_labels
    monkeypatch.setattr(graph, "_met_labels", lambda texts, labels: sought.append({r.page_id for r in texts.collect()}) or whole(texts, labels))
    got = plans.queries()["wiki_context"](spark, str(tmp_path)).select("node", "entities", "evidence", "outlinks", "backlinks")
    assert sorted(map(tuple, got.collect())) == want and len(want) == 4 and sought == [{1, 2}]
    held = {node: entities.split(",") if entities else [] for node, entities, *_ in want}
    assert {k: len(v) for k, v in held.items()} == {"wiki:u0": 12, "wiki:u1": 3, "wiki:u2": 0}


def test_reviews_of_pages_that_share_a_slug(spark, tmp_path):
    import duckdb

    from lodestrata import plans

    spark.createDataFrame([(i, f"u{i // 4}", "") for i in range(12)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(duck.execute(plans.oracle_sql()["wiki_review"]).fetchall())
    assert sorted(map(tuple, plans.queries()["wiki_review"](spark, str(tmp_path)).collect())) == want and len(want) == 12


def test_rows_that_change(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id long, v string, seq int")
    assert sorted(map(tuple, records.upserted(table, new, ["id"], "seq").collect())) == [(1, "a"), (2, "y"), (3, "z")]
    assert sorted(map(tuple, records.updated(table, spark.createDataFrame([(1, None), (9, "q")], "id long, v string"), "id").collect())) == [(1, "a"), (2, "b")]
    assert {tuple(r) for r in records.looked_up(table, spark.createDataFrame([(2,), (5,), (5,)], "id long"), "id").collect()} == {(2, "b", True), (5, None, False)}


def test_files_by_kind(spark, tmp_path):
    body = "<w:document xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'><w:body><w:p><w:r><w:t>Hello Word</w:t></w:r></w:p></w:body></w:document>"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as out:
        out.writestr("word/document.xml", body)
    for name, data in (("a.md", b"# T"), ("b.docx", raw.getvalue()), ("c.docx", b"broken"), ("d.pdf", b"%PDF")):
        (tmp_path / name).write_bytes(data)
    got = {r.name: r for r in files.parsed_files(files.uploads(spark, str(tmp_path))).collect()}
    assert got["a.md"].text == "# T" and got["b.docx"].text == "Hello Word" and got["c.docx"].error and got["d.pdf"].error == "unsupported: pdf"


def test_pages_as_files(spark, tmp_path):
    pages = spark.createDataFrame([("a", "draft", "x\ny\n"), ("b", "published", "é"), ("c", "rejected", "no")], "slug string, status string, content string")
    files.write_pages(wiki.page_files(pages), f"{tmp_path}/pages")
    assert {tuple(r) for r in files.read_pages(spark, f"{tmp_path}/pages").collect()} == {("drafts/a.md", "x\ny\n"), ("published/b.md", "é")}


def test_no_folder_on_a_cluster_without_a_shared_one(spark):
    assert files.work_folder(spark, "x").startswith(("file:", "hdfs:", "/")) and "lodestrata-x-" in files.work_folder(spark, "x")
    with pytest.raises(AttributeError):
        files.work_folder(None, "x")
