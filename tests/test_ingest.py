import os

from pyspark.sql import functions as F

from lodestrata.operators import chunking, ingest, models
from lodestrata.sources import files


def test_skipped_heading_levels_nest():
    assert [(k, p, c) for k, p, c in ingest.blocks_of("# A\n### C\nx\n### E\ny\n\n|a|\n|---|\n# B\nz")] == [("text", ["A", "C"], "x"), ("text", ["A", "C", "E"], "y"), ("table", ["A", "C", "E"], "|a|\n|---|"), ("text", ["B"], "z")]


def test_toc_stops_at_first_later_page(spark):
    paths = ingest.toc_paths([(1, "A", 1), (2, "B", 9), (2, "C", 3), (1, "", 4), (1, "D", 0)])
    toc = spark.createDataFrame([(1, i, p, h) for i, (p, h) in enumerate(paths)], "doc_id long, seq int, start_page int, path array<string>")
    pages = spark.createDataFrame([(1, 0), (1, 5), (1, 9)], "doc_id long, page int")
    assert {r.page: r.heading_path for r in ingest.heading_for_pages(pages, toc).collect()} == {0: [], 5: ["A"], 9: ["A", "C"]}


def test_noise(spark):
    lines = spark.createDataFrame([("d", p, t, True) for p in range(4) for t in ("Header  Line", f"body {p}", str(p), "- 3 -", "··")], "doc string, page int, line string, edge boolean")
    got = {r.line for r in ingest.without_noise(lines, ["doc"]).collect()}
    assert got == {f"body {p}" for p in range(4)}


def test_quality(spark):
    rows = [("good", 4, 0), ("good", 3, 0), ("poor", 0, 0), ("poor", 0, 0), ("warn", 1, 1), ("warn", 1, 0)]
    got = {r.k: r.status for r in ingest.parse_quality(spark.createDataFrame(rows, "k string, blocks int, short_blocks int"), ["k"]).collect()}
    assert got == {"good": "GOOD", "poor": "POOR", "warn": "WARNING"}


def block(content, kind="text", path=("H",), page=1):
    return {"content": content, "block_type": kind, "heading_path": list(path), "page": page, "bbox": [0.0, 1.0, 2.0, 3.0], "source_method": "x"}


def test_table_stays_whole_and_breaks_prose():
    got = chunking.chunks_of([block("before."), block("|a|\n|---|\n|1|", "table"), block("after.")])
    assert [c["block_type"] for c in got] == ["text", "table", "text"]


def test_page_change_splits_and_overlap_stays_in_its_group():
    got = chunking.chunks_of([block("One. " * 3, page=1), block("Two.", page=2), block("Three.", path=("Other",), page=2)])
    assert [c["page"] for c in got] == [1, 2, 2]
    assert "One" not in got[1]["content"]


def test_overlap_and_duplicate_overlap_chunk():
    long = " ".join(f"Sentence number {i} is here." for i in range(40))
    got = chunking.chunks_of([block(long)], target=50, limit=80, overlap=10)
    assert all(c["estimated_tokens"] <= 80 + 10 for c in got) and len(got) > 3
    assert got[1]["content"].split(".")[0] in got[0]["content"]
    units = [("a" * 200, None), ("b" * 300, None)]  # 50 and 75 tokens
    loose = chunking.prose_parts(units, 50, 80, 10)
    a, b = units[0][0], units[1][0]
    assert [c for c, _ in loose] == [a, a, f"{a} {b}"]  # the overlap alone closes a chunk, and one unit always overlaps
    assert [c for c, _ in chunking.prose_parts(units, 50, 80, 10, strict=True)] == [a, f"{a} {b}"]


def test_long_units_and_tables_split():
    assert [chunking.tokens_of(p) for p in chunking.pieces_of("字" * 25, 10)] == [10, 10, 5]
    table = "\n".join(["|h|", "|---|", *[f"|{'x' * 30}{i}|" for i in range(10)]])
    parts = chunking.table_parts(table, 40)
    assert all(p.startswith("|h|\n|---|") for p in parts) and parts[1].splitlines()[2] == parts[0].splitlines()[-1]


def test_chunk_table(spark):
    rows = spark.createDataFrame([(1, 0, "text", ["A"], "One. Two."), (1, 1, "table", ["A"], "|a|"), (2, 0, "text", [], "  ")], "doc_id long, block int, block_type string, heading_path array<string>, content string")
    chunks = chunking.chunk(rows)
    assert [(r.doc_id, r.ordinal, r.block_type) for r in chunks.orderBy("doc_id", "ordinal").collect()] == [(1, 0, "text"), (1, 1, "table")]
    linked = {r.ordinal: (r.previous_id, r.next_id) for r in chunking.linked(chunks).collect()}
    assert linked == {0: (None, "1:1"), 1: ("1:0", None)}
    assert '"version":"structure-token-v1"' in chunking.manifest(chunks).first()["manifest"]


def test_uploads(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\nbody")
    (tmp_path / "b.exe").write_bytes(b"x")
    (tmp_path / "c.txt").write_text("# T\nbody")
    rows = files.uploads(spark, str(tmp_path))
    assert {r.name: r.status for r in rows.collect()} == {"a.md": 202, "b.exe": 415, "c.txt": 202}
    assert {r.text for r in files.decoded(rows).collect()} == {"# T\nbody"}
    stored = files.store_raw(rows.where("status = 202"), f"file://{tmp_path}/raw")
    assert stored.count() == 1
    assert files.store_raw(rows.where("status = 202"), f"file://{tmp_path}/raw", spark.read.parquet(f"file://{tmp_path}/raw")).count() == 0
    assert os.path.isdir(tmp_path / "raw")


def test_word_files(spark, tmp_path):
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, style="": f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>' if style else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    row = lambda *c: "<w:tr>" + "".join(f"<w:tc>{p(x)}</w:tc>" for x in c) + "</w:tr>"
    body = p("Top", "Heading1") + "<w:tbl>" + row("a", "b") + row("1", "2") + "</w:tbl>" + p("first") + p("Sub", "Heading2") + p("second")
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as out:
        out.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    (tmp_path / "b.docx").write_bytes(b"not a zip")
    rows = files.docx_blocks(files.uploads(spark, str(tmp_path)))
    got = [(r.block_type, r.heading_path, r.content) for r in rows.where("error is null").orderBy("block").collect()]
    assert got == [("text", ["Top"], "first"), ("text", ["Top", "Sub"], "second"), ("table", ["Top", "Sub"], "| a | b |\n| --- | --- |\n| 1 | 2 |")]
    files.error_book(rows, "parsing", f"file://{tmp_path}/errors")
    assert [(r.name, r.stage) for r in spark.read.json(f"file://{tmp_path}/errors").collect()] == [("b.docx", "parsing")]


def test_question_sets(spark):
    table = spark.createDataFrame([("| id | t | q | e |",), ("| Q1 | fact | What? | yes |",), ("| Q2 | x |",)], "value string")
    assert [(r.id, r.question) for r in files.question_table(table).collect()] == [("Q1", "What?")]
    lines = spark.createDataFrame(list(enumerate(["## One", "1. First", "text", "## Two", "2) Second"])), "line long, value string")
    assert [(r.section, r.question) for r in files.question_list(lines).orderBy("line").collect()] == [("One", "First"), ("Two", "Second")]
    assert files.question_list(lines, "Two").count() == 1


def test_embedding_falls_back_row_by_row(spark):
    stub = models.hashed_embedder(8)

    def picky(texts):
        if "bad" in texts:
            raise ValueError
        return stub(texts)

    rows = spark.createDataFrame([(1, "a b"), (2, "bad"), (3, None)], "id long, text string").coalesce(1)
    got = {r.id: r.embedding for r in models.embedded(rows, picky).collect()}
    assert got[2] is None and abs(sum(x * x for x in got[1]) - 1) < 1e-9 and got[3] is not None
    assert models.generated(spark.createDataFrame([(1, "p")], "id long, prompt string"), str.upper).first()["answer"] == "P"


def test_new_documents(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "doc_id long, text string").withColumn("sha256", F.sha2("text", 256))
    old = rows.where("doc_id = 1").select("sha256")
    assert [r.doc_id for r in ingest.new_documents(rows, old).collect()] == [2]
