import sqlite3

from pyspark.sql import functions as F

from lodestrata.operators import retrieval

DOCS = [(1, "solver step size fixed-step solver"), (2, "chart state transition event"), (3, "fixed point and step"), (4, "fixed-step variable-step solver. step."), (5, "")]


def test_bm25_equals_fts5_with_phrases(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "fixed-step solver"), (2, "state chart"), (3, "...")], "query_id long, text string")
    got = {(r.query_id, r.doc_id): r.score for r in retrieval.bm25(docs, asked).collect()}
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(id unindexed, content)")
    tokens = {r.doc_id: r.t for r in docs.select("doc_id", F.array_join(retrieval.T.lexical_tokens(F.col("text")), " ").alias("t")).collect()}
    con.executemany("insert into f values (?, ?)", tokens.items())
    want = {}
    for q, match in ((1, '"fixed-step" or "solver"'), (2, '"state" or "chart"')):
        for doc, score in con.execute("select id, bm25(f) from f where f match ?", (match.replace(" or ", " OR "),)):
            want[q, int(doc)] = -score
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_cosine_matches_brute_force(spark):
    rows = [(i, [float((i * 7 + j * 3) % 5 - 2), 1.0]) for i, j in ((i, i % 3) for i in range(20))] + [(99, None), (98, [0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r.rank): r.vec_id for r in retrieval.cosine_topk(vectors, vectors.where("vec_id < 3").withColumnRenamed("vec_id", "query_id"), 5).collect()}
    full = {i: v for i, v in rows if v and any(v)}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    for q in range(3):
        order = sorted(full, key=lambda i: (-round(cos(full[q], full[i]), 9), i))[:5]
        assert [got[q, r + 1] for r in range(5)] == order


def test_variants(spark):
    rows = spark.createDataFrame([(1, "autosar simulink solver chart event"), (2, "stateflow 是什么 chart event"), (3, "plain")], "query_id long, text string")
    got = retrieval.variants(rows).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {1: 4, 2: 2, 3: 1}


def test_filter_keeps_rank_gaps(spark):
    top = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc_id long, rank int")
    documents = spark.createDataFrame([(10, "a"), (11, "b")], "doc_id long, source string")
    assert [r["rank"] for r in retrieval.source_filter(top, documents, releases=["b"]).collect()] == [2]
    assert retrieval.source_filter(top, documents, ids=[]).count() == 0
    assert retrieval.source_filter(top, documents).count() == 2


def test_toc_is_dropped_only_if_enough_remain(spark):
    rows = [(1, "contents 1 a", "", 1), (1, "text", "h", 2), (2, "contents 1 a", "", 1)]
    got = retrieval.without_toc(spark.createDataFrame(rows, "query_id long, content string, heading_path string, page int"), 1).collect()
    assert sorted((r.query_id, r.content) for r in got) == [(1, "text"), (2, "contents 1 a")]


def test_boosts(spark):
    rows = [("what is stateflow", "", "a finite state machine", ["bm25"], ["stateflow"], ["stateflow"], 0.1), ("what is stateflow", "", "a finite state machine", ["graph"], ["stateflow"], ["stateflow"], 0.1)]
    df = spark.createDataFrame(rows, "question string, heading_path string, content string, channels array<string>, query_domains array<string>, document_domains array<string>, rrf_score double")
    assert [r.final_score for r in retrieval.boosted(df).collect()] == [0.18, 0.11]


def test_graph_expansion(spark):
    relations = spark.createDataFrame([(1, 5, 6, [10, 11, 12], 2.0, 0.9), (2, 7, 8, [12, 13], 0.0, 0.0), (3, 7, 8, [20, 21], 1.0, 1.0)], "relation_id long, source_id long, target_id long, refs array<long>, weight double, confidence double")
    seeds = spark.createDataFrame([(1, 10), (1, 13)], "query_id long, chunk_id long")
    matched = spark.createDataFrame([(1, 5)], "query_id long, entity_id long")
    got = {r.chunk_id: (r.score, r.reasons) for r in retrieval.graph_channel(seeds, relations, matched).collect()}
    assert got == {12: (round(0.0144 + 0.0054 + 0.012, 6), ["query_entity", "seed_relation"]), 11: (round(0.0144 + 0.0054, 6), ["query_entity", "seed_relation"])}


def test_entity_matches(spark):
    entities = spark.createDataFrame([(1, "Truth Table", None), (2, "bus", ["signal bus"]), (3, "xy", None), (4, "Solver setup", None)], "entity_id long, label string, aliases array<string>")
    asked = spark.createDataFrame([(1, "a truth table?"), (2, "which solver fits the bus")], "query_id long, text string")
    got = {(r.query_id, r.entity_id) for r in retrieval.entity_matches(entities, asked).collect()}
    assert got == {(1, 1), (2, 2), (2, 4)}
