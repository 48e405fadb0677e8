from pyspark.sql import functions as F

from lodestrata.operators import chat, graph, selection, wiki
from lodestrata.streaming import jobs

CANDIDATE = "query_id long, question string, query_domains array<string>, chunk_id long, document_id long, ordinal long, page int, title string, heading_path string, content string, document_domains array<string>, channels array<string>, final_score double, candidate_rank int"


def candidate(i, content, document=None, domains=(), score=0.01, question="solver question"):
    return (1, question, ["solver"], i, document or i, i * 10, None, "t", "", content, list(domains), ["bm25"], score, i)


def test_selection_rejects_noise_duplicates_and_low_ranks(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows = [candidate(1, text + " one", 7, score=0.9), candidate(2, text + " two", 7, score=0.8), candidate(3, "short"), *[candidate(i, f"unique words number {i} {'abcdefgh'[i - 4] * 9} here", score=0.5 - i / 100) for i in range(4, 12)]]
    rows = [r[:5] + (100 if r[3] == 1 else 101 if r[3] == 2 else r[5],) + r[6:] for r in rows]
    got = {r.chunk_id: (r.position, r.reason) for r in selection.select_evidence(selection.selector_score(spark.createDataFrame(rows, CANDIDATE))).collect()}
    assert got[1] == (1, None) and got[2] == (None, "duplicate_neighbor") and got[3] == (None, "too_short")
    assert sorted(p for p, _ in got.values() if p) == [1, 2, 3, 4, 5, 6] and got[11] == (None, "below_selected_cut")


def test_forced_domains(spark):
    question = "relationship between Simulink and Stateflow"
    rows = [candidate(i, f"text number {i} is long enough to count here", domains=["simulink"], score=1 - i / 10, question=question) for i in range(1, 7)]
    rows.append(candidate(7, "a chart text that is long enough to count", domains=["stateflow"], score=0.0, question=question))
    rows = [r[:2] + (["simulink", "stateflow"],) + r[3:] for r in rows]
    got = {r.chunk_id: r.position for r in selection.select_evidence(selection.selector_score(spark.createDataFrame(rows, CANDIDATE))).collect()}
    assert got[1] == 1 and got[7] == 2


def test_coverage(spark):
    asked = spark.createDataFrame([(1, "Can Simulink generate ROS 2 nodes"), (2, "what is simulink"), (3, "quaternion kinematics")], "query_id long, text string")
    evidence = spark.createDataFrame([(1, "t", "", "ros nodes"), (3, "t", "", "quaternion")], "query_id long, title string, heading_path string, content string")
    got = {r.query_id: (r.passed, r.reason) for r in selection.coverage(asked, evidence).collect()}
    assert got == {1: (True, "covered_or_domain_supported"), 2: (True, "no_specific_terms"), 3: (False, "specific_terms_missing")}


def test_snippets_and_context(spark):
    item = (1, "solver step", 5, 1, "Alpha is the first unit. The solver step is chosen here. Nothing else of note follows.", ["solver"], "T", 3, "H")
    df = spark.createDataFrame([item], "query_id long, question string, chunk_id long, position int, content string, document_domains array<string>, title string, page int, heading_path string")
    assert selection.snippets(df).first()["snippet"] == item[4]
    row = selection.compact_context(df).first()
    assert row.context == f"[E:5] source=T; page=3; heading=H\n{item[4]}" and row.n_evidence == 1


def test_answers(spark):
    rows = spark.createDataFrame([("a", "Fact. [E:1]\n\nUncited claim that is too long to stay.\n\n标题", [1, 2]), ("b", "No marks.", [3, 4, 5, 6]), ("c", "x", [])], "answer_id string, answer string, evidence array<long>")
    got = {r.answer_id: (r.answer, r.cited) for r in chat.bound_citations(rows).collect()}
    assert got == {"a": ("Fact. [E:1]\n\n标题", [1]), "b": ("No marks.\n\n主要依据：[E:3] [E:4] [E:5]", [3, 4, 5]), "c": ("x", [])}


def test_judge(spark):
    rows = spark.createDataFrame([("x" * 80 + "[E:1]", "c"), ("证据不足", "c"), ("short [E:1]", "")], "answer string, context string")
    assert [(r.passed, r.judge_passed) for r in chat.judged(rows).collect()] == [(True, True), (False, False), (False, False)]


def test_pairs_context_and_memories(spark):
    rows = [(1, 1, "user", "我用 R2024b，请用中文"), (1, 2, "assistant", "ok"), (1, 3, "user", "它呢"), (1, 4, "user", "again"), (1, 5, "assistant", "fine"), (2, 1, "assistant", "hi"), (3, 1, "user", "我的项目是雷达，谢谢")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [(r.turn, r.user_turn) for r in chat.training_pairs(df).orderBy("turn").collect()] == [(2, 1), (5, 4)]
    context = {(r.conv_id, r.turn): (len(r.history), r.rewrite) for r in chat.recent_context(df).collect()}
    assert context[1, 3] == (2, True) and context[1, 1] == (0, False)
    got = {(r.memory_type, r.content) for r in chat.memories(df).collect()}
    assert got == {("simulink_release", "用户主要使用 Simulink R2024B"), ("response_style", "用户偏好中文回答"), ("project", "当前项目：雷达")}
    known = spark.createDataFrame([("project", "当前项目：雷达")], "memory_type string, content string")
    assert chat.memories(df, known).count() == 2


def test_sections(spark):
    rows = [(1, 0, "A / B", 1), (1, 1, "A / B", 2), (1, 2, "A / C", 3), (2, 0, "", 3), (2, 1, "", 12), (2, 2, "", 13), (3, 0, "", None)]
    got = {(r.doc_id, r.section): (r.title, r.n_chunks) for r in wiki.sections(spark.createDataFrame(rows, "doc_id long, ordinal int, heading_path string, page int")).collect()}
    assert got == {(1, 1): ("A / B", 2), (1, 2): ("A / C", 1), (2, 1): ("Pages 3-12", 2), (2, 2): ("Page 13", 1), (3, 1): ("Evidence 1-1", 1)}
    many = spark.createDataFrame([(1, i, f"H{i}", None) for i in range(61)], "doc_id long, ordinal int, heading_path string, page int")
    assert wiki.sections(many).count() == 21  # bundles of three


def test_even_sample(spark):
    for n in (5, 12, 13, 40, 101):
        step = (n - 1) / 11
        want = sorted({round(i * step) for i in range(12)}) if n > 12 else list(range(n))
        got = sorted(r.o for r in wiki.even_sample(spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("o")), ["k"], "o").collect())
        assert got == want, n


def test_pages_and_slugs(spark):
    df = spark.createDataFrame([(["[[ E : 3 ]]"], [3, 4]), (["[E:9]"], [3])], "c array<string>, allowed array<long>")
    assert [r.x for r in df.select(wiki.valid_page(F.col("c")[0], F.col("allowed")).alias("x")).collect()] == [True, False]
    assert spark.range(1).select(wiki.section_slug(F.lit(4), F.lit("My Doc"), F.lit(2), F.lit("仿真")).alias("x")).first().x == "source-4-my-doc-s2-section-2"


def test_graph(spark):
    pages = spark.createDataFrame([(1, "Solver / Guide", "# Fixed Step\nThe Simulink Model uses [[Signal Bus]]. Simulink Model again [E:1] [E:2]"), (2, "Solver", "Simulink Model [E:2]")], "page_id long, title string, content string")
    mentions = graph.page_entities(pages)
    first = [(r.label, r.source) for r in mentions.where("page_id = 1").orderBy("position").collect()]
    assert first[:4] == [("Solver", "wiki_link"), ("Guide", "wiki_link"), ("Signal Bus", "wiki_link"), ("Fixed Step", "heading")]
    found = {r.entity_key: (r.wiki_count, r.evidence_count) for r in graph.entities(mentions, pages).collect()}
    assert found["solver"] == (2, 2)
    pairs = graph.cooccurrences(mentions)
    assert all(r.source_key != r.target_key for r in pairs.collect())
    stated = spark.createDataFrame([("a", "b", "part_of", 1.0, 1.5, 1), ("a", "a", "part_of", 1.0, 1.0, 1), ("a", "b", "bad", 1.0, 1.0, 1), ("a", "b", "part_of", 1.0, 0.5, 2)], "source_key string, target_key string, relation_type string, weight double, confidence double, page long")
    assert [(r.source_key, r.confidence) for r in graph.relations(pairs, stated).where("relation_type = 'part_of'").collect()] == [("a", 1.0)]
    assert graph.page_mentions(pages, graph.entities(mentions, pages)).where("entity_key = 'signal-bus'").count() == 1


def test_stream_ingest_is_idempotent(spark, tmp_path):
    source, table = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string").write.parquet(source)
    for run in range(2):
        stream = spark.readStream.schema("doc_id long, text string").parquet(source)
        jobs.ingest(stream, table, f"file://{tmp_path}/check{run}").awaitTermination()  # a new checkpoint replays all
    assert sorted(r.doc_id for r in spark.read.parquet(table).collect()) == [1, 3]


def test_stream_windows(spark, tmp_path, sf_dir):
    source = f"file://{tmp_path}/events"
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(source)
    events = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    running = jobs.windowed_counts(events, late="365 days").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    running.awaitTermination()
    batch = jobs.windowed_counts(spark.read.parquet(source))
    assert sorted(map(tuple, spark.table("windows").select("w.start", "event_type", "n").collect())) == sorted(map(tuple, batch.select("w.start", "event_type", "n").collect()))


def test_jobs(spark):
    rows = spark.createDataFrame([(1, "running", "parsing"), (2, "queued", ""), (3, "failed", "")], "job_id long, status string, stage string")
    assert [r.status for r in jobs.recovered(rows).orderBy("job_id").collect()] == ["queued", "queued", "failed"]
    assert jobs.claimable(rows).first().job_id == 2
    assert {r.job_id: r.status for r in jobs.retried(rows, rows.where("job_id > 1")).collect()} == {1: "running", 2: "queued", 3: "queued"}
