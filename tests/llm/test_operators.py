"""The operators on Spark: whole small tables and every odd case, against brute force."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from lodestrata.llm import bpe_codec, chained_passages, common, crf_quality, decontaminate, exact_topk, license_scan, line_dedup, queries, sharding, simhash_dedup, suffix_dedup

from .test_units import brute_hits

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))
TEXTS = [(1, "One line here that is long enough to matter.\nsecond"), (2, None), (3, ""), (4, LONG), (5, "One line here that is long enough to matter.\nsecond"), (6, "  \n\n"), (6, "  \n\n"), (None, "no id at all"), (7, "é" * 150), (8, f"start {PASSAGE} end"), (9, f"other words first {PASSAGE.replace('passage30', 'edited')} then more")]
SCHEMA = "doc_id long, text string, lang string, fp long, score double, bucket int, key string, spans string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, long, equal, repeated and anonymous rows, with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", 7, 0.5, 3, "k", "s", len(t or "")) for i, t in TEXTS], SCHEMA).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 150), (7, 7), (100, 200)] + [(1000, 1000 + i) for i in range(1, 300)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 61)}, 150: 100, 200: 100, **{1000 + i: 1000 for i in range(1, 300)}}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash(spark, sf_dir, odd, none):
    rows = {(r.doc_id, r.text): simhash_dedup.fingerprint((r.text or "").encode()) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    fps = {d: f for (d, _), f in rows.items()}
    root = {d: d for d in fps}
    find = lambda x: x if root[x] == x else find(root[x])
    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.queries()["op4_simhash_deletion_variants"](spark, sf_dir).collect()}
    assert got == {d: (f"{f:016x}", find(d)) for d, f in fps.items()}
    found = [(r.doc_id, r.component_id) for r in simhash_dedup.simhash_groups(odd).collect()]
    assert len(found) == len(TEXTS) and {(5, 1), (2, 2), (3, 2), (6, 2)} <= set(found)
    kept = simhash_dedup.keep_one(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 4, 7, 8, 9]
    assert simhash_dedup.keep_one(none).count() == 0
    assert simhash_dedup.simhash_groups(none).count() == 0


def test_simhash_keeps_every_text_of_a_repeated_id(spark):
    one, two, three = (" ".join(f"{w}{i * i % 89}" for i in range(80)) for w in ("red", "blue", "green"))
    four = " ".join(f"gold{i * i % 97}" for i in range(80))
    rows = [(5, one, "b"), (5, two, "a"), (5, one, "a"), (5, one, "a"), (7, three, "a"), (9, two, "a"), (None, four, "a"), (None, four, "a"), (None, one, "a"), (None, "  ", "b")]
    for seed in (0, 1):
        docs = spark.createDataFrame([rows[i] for i in np.random.default_rng(seed).permutation(len(rows))], "doc_id long, text string, kept string").withColumn("row", F.create_map(F.lit("a"), F.lit(1)))
        kept = [(r.doc_id or 0, r.text, r.kept) for r in simhash_dedup.keep_one(docs).collect()]
        assert sorted(x[:2] for x in kept) == sorted([(5, one), (5, two), (7, three), (0, four), (0, "  ")])
        assert seed == 0 or sorted(kept) == before
        before = sorted(kept)


def test_bpe(spark, sf_dir, odd, none):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_codec.read_ranks(path), special_tokens={})
    want = lambda t: (len(x := encoding.encode_ordinary(t)), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.queries()["op5_bpe_bitmap_queue"](spark, sf_dir).collect()}
    assert got == {d: want(t) for d, t in texts.items()}
    rows = bpe_codec.encoded(odd, path, public_tokenizers.PATTERN, with_ids=True)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows.collect()) == sorted((d or 0, want(t or "")[0]) for d, t in TEXTS)
    back = {r.doc_id: bytes(r.bytes) for r in bpe_codec.decoded(rows.where("doc_id in (4, 7)"), path).collect()}
    assert back == {4: LONG.encode(), 7: ("é" * 150).encode()}
    assert bpe_codec.encoded(none, path, public_tokenizers.PATTERN).count() == 0


def test_shards(spark, sf_dir, odd, none, tmp_path):
    docs = table(spark, sf_dir, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = queries.queries()["op6_virtual_slots"](spark, sf_dir).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {d: (len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in texts.items()}
    loads = {}
    for s in range(40):
        mine = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        loads[s] = sum(r.size for r in mine)
    assert max(loads.values()) <= max(max(r.size for r in rows), 1.05 * sum(loads.values()) / 40)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    odd_rows = sharding.shard_documents(odd, 3).collect()
    assert len(odd_rows) == len(TEXTS) and {r.size for r in odd_rows if r.doc_id == 2} == {16}
    assert sharding.shard_documents(none).count() == 0
    slots = sharding.slot_bytes(sharding.sized(docs))
    first = sharding.stored(sharding.first_map(slots, 4), f"file://{tmp_path}/map")
    again = sharding.stored(sharding.rebalanced(first, slots, 5), f"file://{tmp_path}/map").join(slots, "vslot", "left").na.fill(0)
    assert again.first()["version"] == 2 and sharding.read_map(spark, f"file://{tmp_path}/map", 1).count() == sharding.SLOTS
    sums = [r.s for r in again.groupBy("shard").agg(F.sum("bytes").alias("s")).collect()]
    biggest = slots.agg(F.max("bytes")).first()[0]
    assert len(sums) == 5 and max(sums) - sum(sums) / 5 <= biggest
    moved = again.join(first.select("vslot", F.col("shard").alias("old")), "vslot").where("shard <> old")
    assert moved.count() < sharding.SLOTS / 2


def test_quality(spark, sf_dir, odd, none):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = queries.queries()["op7_crf_quality"](spark, sf_dir).collect()
    assert len(rows) == docs.count() and all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    larger = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in table(spark, larger, "labels").collect()}
    scored = [r for r in queries.queries()["op7_crf_quality"](spark, larger).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in scored]) >= 0.95
    model = crf_quality.train(odd, labels.limit(0))
    assert {r.score for r in crf_quality.scored(odd, model).collect()} == {0.5} and crf_quality.scored(none, model).count() == 0
    messy = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (4, None, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    assert crf_quality.keep_good(odd, crf_quality.train(odd, messy)).columns == odd.columns


def test_lines(spark, odd, none):
    base = "the quick brown fox jumps over the lazy dog while the small cat sleeps on the old wall near the river"
    rows = [(1, f"{base}\nkept\n\nshort"), (2, f"unique to two\n{base[:-1]}s\nshort"), (3, f"{base}\n{base}"), (4, None), (None, "anonymous line of text"), (5, "anonymous line of text")]
    docs = spark.createDataFrame([(i, t, 0, "x", 1, "i") for i, t in rows], "doc_id long, text string, n_chars long, lids string, GONE_NUMBERS int, gone_id string")
    out = {r.doc_id: (r.text, r.n_chars, r.lids) for r in line_dedup.drop_lines(docs).collect()}
    assert line_dedup.drop_lines(docs).columns == docs.columns
    assert out == {1: (f"{base}\nkept\n\nshort", len(base) + 12, "x"), 2: ("unique to two", 13, "x"), 3: ("", 0, "x"), 4: (None, None, "x"), None: ("anonymous line of text", 22, "x"), 5: ("", 0, "x")}
    digest = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.line_digest(docs).collect()}
    assert digest == {1: (4, 0), 2: (3, 2), 3: (2, 2), 4: (0, 0), None: (1, 0), 5: (1, 1)}
    assert line_dedup.line_digest(odd).count() == len(TEXTS) and line_dedup.line_digest(none).count() == 0


def test_lines_of_a_table_match_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    places, root = {}, {}
    for d, t in texts:
        for i, line in enumerate(t.split("\n")):
            if line.strip():
                places.setdefault(line, (d, i))
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    sets = [(x, line_dedup.shingles(x)) for x in places]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 0.8 <= len(x) / len(y) <= 1.25 and len(x & y) >= 0.8 * len(x | y):
                p, q = find(a), find(b)
                if p != q:
                    lo, hi = sorted((p, q), key=places.get)
                    root[hi] = lo
    gone = {d: sum(bool(line.strip()) and places[find(line)] != (d, i) for i, line in enumerate(t.split("\n"))) for d, t in texts}
    got = {r.doc_id: r.n_removed for r in line_dedup.line_digest(docs).collect()}
    assert sum(got[d] != n for d, n in gone.items()) <= 0.01 * len(gone)  # banding finds 99.5 % of pairs at 0.8


def test_lines_of_a_large_mixed_group_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(31)
    letters = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n))
    template, lines = letters(150), []
    for _ in range(1400):  # about 0.6 to 0.7 alike through the template
        lines.append(template + letters(int(rng.integers(34, 46))) + ".")
        if rng.random() < 0.4:  # at 0.8 or more to the one before
            cut = int(rng.integers(150, 180))
            lines.append(lines[-1][:cut] + "#" + lines[-1][cut + 1 :])
    lines = [lines[i] for i in rng.permutation(len(lines))]
    assert np.unique(line_dedup.band_keys([x.encode() for x in lines]), return_counts=True)[1].max() > 500
    root = list(range(len(lines)))
    find = lambda x: x if root[x] == x else find(root[x])
    sets = [line_dedup.shingles(x) for x in lines]
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if both >= 0.8 * (len(x) + len(sets[j]) - both):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    gone = {i for i in range(len(lines)) if find(i) != i}
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)
    assert len(gone) > 400 and len(gone) < len(lines) / 2
    for crowd in (line_dedup.CROWD, 200):  # a group in one cell, and over a grid
        monkeypatch.setattr(line_dedup, "CROWD", crowd)
        got = {r.doc_id for r in line_dedup.line_digest(docs).where("n_removed > 0").collect()}
        assert got <= gone and len(got) >= 0.99 * len(gone)


def test_decontamination(spark, sf_dir, odd, none, monkeypatch):
    bench = [(r.item_id, r.text.encode()) for r in table(spark, sf_dir, "benchmark").collect()]
    got = {r.doc_id: r for r in queries.queries()["op9_wu_manber"](spark, sf_dir).collect()}
    for r in table(spark, sf_dir, "documents").collect():
        hit, found = brute_hits(r.text.encode(), bench)
        x = got[r.doc_id]
        assert (x.n_words, x.n_hit, x.n_items, x.contaminated) == (len(decontaminate.words_of(r.text.encode())), len(hit), len(found), bool(hit))
        assert x.items_sha256 == hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
    items = spark.createDataFrame([(1, "no ID"), (1, "no ID"), (2, None), (3, ""), (4, PASSAGE), (None, "x")], "item_id long, text string")
    one = sorted((r.doc_id or 0, r.n_hit, r.n_items) for r in decontaminate.contamination(odd, items).collect())
    assert len(one) == len(TEXTS) and (0, 2, 1) in one and (8, 60, 1) in one
    monkeypatch.setattr(decontaminate, "PART_WINDOWS", 20)  # item 4 is cut into pieces
    assert sorted((r.doc_id or 0, r.n_hit, r.n_items) for r in decontaminate.contamination(odd, items).collect()) == one
    assert sorted(r.doc_id or 0 for r in decontaminate.drop_contaminated(odd, items).collect()) == [1, 2, 3, 4, 5, 6, 6, 7]
    assert decontaminate.drop_contaminated(odd, items).columns == odd.columns and decontaminate.drop_contaminated(odd, items.limit(0)).count() == len(TEXTS)
    assert decontaminate.contamination(odd, items.limit(0)).where("contaminated").count() == 0 and decontaminate.contamination(none, items).count() == 0


def test_decontamination_of_rows_that_share_an_id(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "red blue"), (1, "red stone"), (None, "blue one"), (None, "two stone"), (2, "plain text")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "red"), (8, "blue"), (None, "stone")], "item_id long, text string")
    for size in (decontaminate.PART_WINDOWS, 1):
        monkeypatch.setattr(decontaminate, "PART_WINDOWS", size)
        got = sorted((r.doc_id or 0, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(docs, items).collect())
        assert got == [(0, 1, 0, True), (0, 1, 1, True), (1, 2, 1, True), (1, 2, 2, True), (2, 0, 0, False)]


def brute_suffix(rows):
    seen, out = {}, {}
    for d, t in sorted(rows):
        cover = set()
        for s in range(len(t) - 99):
            if seen.setdefault(t[s : s + 100], (d, s)) != (d, s):
                cover |= set(range(s, s + 100))
        kept = bytes(b for i, b in enumerate(t) if i not in cover)
        out[d] = (len(t), len(cover), sum(i - 1 not in cover for i in cover), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, sf_dir, odd, none, monkeypatch):
    rows = [(r.doc_id, r.text.encode()) for r in table(spark, sf_dir, "documents").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.queries()["op10_deep_shallow"](spark, sf_dir).collect()}
    assert got == brute_suffix(rows)
    rng = np.random.default_rng(29)
    letters = lambda n: "".join(rng.choice(list("abcd"), n))
    shared, run = letters(130), "a" * 400
    texts = [(i, letters(20) + shared[: rng.integers(90, 131)] + letters(int(rng.integers(0, 30)))) for i in range(120)] + [(500, run), (501, letters(5) + run + letters(9)), (502, None), (503, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = brute_suffix([(d, (t or "").encode()) for d, t in texts])
    for pairs, hot, slice_ in ((48, 50_000, 100_000), (4, 50_000, 500), (48, 20, 100), (4, 3, 100_000)):  # in pairs, window by window, hot grams
        for name, value in (("PAIRS", pairs), ("HOT", hot), ("SLICE", slice_), ("REACH", 150 if slice_ == 100 else 2 << 20)):
            monkeypatch.setattr(suffix_dedup, name, value)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicated(df).collect()}
        assert got == want
    assert suffix_dedup.deduplicated(odd, with_text=True).count() == len(TEXTS) and suffix_dedup.deduplicated(none).count() == 0


def test_passages(spark, sf_dir, odd, none):
    rows = {(r.doc_id, r.other_id): r for r in chained_passages.passages(odd).collect()}
    assert set(rows) == {(9, 8)}
    r = rows[9, 8]
    assert (r.start_word, r.end_word, r.other_start, r.other_end, r.n_equal) == (3, 63, 1, 61, 59)
    assert chained_passages.passages(none).count() == 0
    texts = {r.doc_id: r.text.encode().lower().split() for r in table(spark, sf_dir, "documents").collect()}
    links, root = queries.queries()["op1_collinear_passages"](spark, sf_dir).collect(), {d: d for d in texts}
    find = lambda x: x if root[x] == x else find(root[x])
    for r in links:
        assert r.similarity >= 0.8 and r.end_word - r.start_word >= chained_passages.MIN_WORDS
        root[find(r.doc_id)] = find(r.other_id)
    holders = {}
    for d, w in texts.items():
        for i in range(len(w) - 49):
            holders.setdefault(tuple(w[i : i + 50]), set()).add(d)
    shared = [h for h in holders.values() if len(h) > 1]
    assert shared and all(len({find(d) for d in h}) == 1 for h in shared)


def test_passages_that_no_first_holder_shares(spark):
    left, right, other = ([f"{w}{i}" for i in range(30)] for w in ("left", "right", "else"))
    rows = [(1, left), (2, right), (3, ["a", *left, *right]), (4, [*left, *right, "b"]), (5, [*other, *left]), (6, [*right, *other]), (7, ["c", *left, *right, *other])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {(r.doc_id, r.other_id): r.n_words for r in chained_passages.passages(docs).collect()}
    assert got[4, 3] == 60 and any(pair[0] == 7 and pair[1] in (3, 4) for pair in got)


def test_passages_whose_seeds_all_have_earlier_holders(spark):
    # 2, 4 and 6 share 60 words; 1, 3, and 5 hold stretches of these in other company, so no holder is first or next to another
    rng = np.random.default_rng(7)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    shared = word(60)
    torn = lambda: [w for k in range(0, 60, 6) for w in (*shared[max(0, k - 5) : k + 11], *word(30))]
    bent = lambda k: [f"x{k}" if i % 20 == k else w for i, w in enumerate(shared)]
    rows = [(1, torn()), (2, word(20) + bent(2) + word(20)), (3, torn()), (4, word(9) + bent(9) + word(5)), (5, torn()), (6, bent(16) + word(30))]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {(r.doc_id, r.other_id) for r in chained_passages.passages(docs.coalesce(1)).collect()}
    assert got >= {(4, 2), (6, 2), (6, 4)}


def test_passages_of_frequent_seeds(spark):
    # 80 texts before, and 40 between, hold stretches of what 100 and 200 share; 300 to 369 are near copies, with an edit in about twenty words
    rng = np.random.default_rng(17)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    shared, copied = word(60), word(90)
    torn = lambda: [w for k in range(0, 60, 6) for w in (*shared[max(0, k - 5) : k + 11], *word(30))]
    bent = lambda k: [f"x{k}" if i % 20 == k else w for i, w in enumerate(shared)]
    edits = lambda v: [[v], word(1), [v, v], []][rng.choice(4, p=[0.95, 0.03, 0.01, 0.01])]
    near = lambda: [w for v in copied for w in edits(v)]
    rows = {i: torn() for i in (*range(80), *range(101, 141))} | {100: word(20) + bent(2) + word(20), 200: word(9) + bent(9) + word(5)}
    rows |= {i: word(30) + near() + word(20) for i in range(300, 370)}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")
    forty = {i: {tuple(rows[i][k : k + 40]) for k in range(len(rows[i]) - 39)} for i in range(300, 370)}
    for df in (docs.coalesce(1), docs.repartition(3)):
        got = {(r.doc_id, r.other_id) for r in chained_passages.passages(df).collect()}
        assert (200, 100) in got
        missing = [(a, b) for a in range(300, 370) for b in range(300, a) if (a, b) not in got and forty[a].isdisjoint(forty[b])]
        assert len(missing) <= 0.01 * 70 * 69 / 2, len(missing)


def test_short_texts_are_aligned_once(spark):
    rng = np.random.default_rng(43)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 300)]
    near = [f"x{i}" if i % 25 == 7 else w for i, w in enumerate(words)]
    rows = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near))], "doc_id long, text string")
    run = np.array([1, 133, 133, 24], "<u4").tobytes()  # from here the passage goes on to both texts' ends
    found = spark.createDataFrame([(2, 1, bytearray(run))], "doc_id long, other_id long, chain binary")
    once, = chained_passages._aligned_chains(found, rows, chained_passages.MARGIN).collect()
    assert not once.cut and (once.start_word, once.end_word, once.n_equal) == (0, 300, 288)


def test_passages_of_texts_that_repeat_themselves(spark):
    rows = [(1, ["start", *["a", "b"] * 200, "end"]), (2, ["a", "b"] * 300), (3, ["x", *["a", "b"] * 100])]
    got = chained_passages.passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.other_id) for r in got} >= {(2, 1), (3, 1)} and len(got) <= 12
    for r in got:  # no passage lies inside another with the same document
        assert not any(o is not r and (o.doc_id, o.other_id) == (r.doc_id, r.other_id) and o.start_word <= r.start_word and r.end_word <= o.end_word for o in got)


def test_passages_of_repeated_ids_and_long_extensions(spark, monkeypatch):
    rng = np.random.default_rng(41)
    words = lambda n: [f"w{i}" for i in rng.integers(0, 10**6, n)]
    shared = words(400)
    rows = [(1, words(80) + shared + words(50)), (1, words(20)), (2, words(7) + shared + words(9)), (2, shared[:50])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    chosen = {i: min(" ".join(w) for j, w in rows if i == j).split() for i in (1, 2)}
    want = sum(len(set(chosen[1]) & set(chosen[2])) >= 40 for _ in (1,))
    assert chained_passages.passages(docs).count() == want
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in (rows[0], rows[2])], "doc_id long, text string")
    monkeypatch.setattr(chained_passages, "MARGIN", 1)
    monkeypatch.setattr(chained_passages, "RUNGS", ((5, 0), (8, 64), (40, 300)))
    monkeypatch.setattr(chained_passages, "KEPT", 0.01)
    assert [(r.start_word, r.end_word, r.other_start, r.other_end) for r in chained_passages.passages(docs).collect()] == [(7, 407, 80, 480)]


def test_licences(spark, sf_dir, odd, none):
    rows = queries.queries()["op2_license_classifier"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        for phrase, family in (("MIT License", "MIT"), ("Apache License", "Apache"), ("GNU General Public License", "GPL"), ("CC BY", "CC")):
            assert (phrase in texts[r.doc_id]) == (family in r.families)
    model = license_scan.train(none)
    assert license_scan.scanned(odd, model).count() == len(TEXTS) and license_scan.scanned(none, model).count() == 0


def test_top_k(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    want = sorted(con.execute(exact_topk.ORACLE_SQL).fetchall())
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in queries.queries()["op3_norm_sorted_topk"](spark, sf_dir).collect())
    assert got == want
    rows = [(0, [1.0, 2.0], "a"), (20, [1.0], "a"), (1, None, "a"), (2, [float("nan"), 1.0], "a"), (3, [None, 1.0], "a"), (4, [1.0, 2.0], "a"), (4, [1.0, 2.0], "a"), (None, [1.0, 1.0], "a"), (5, [], "a"), (40, [float("inf")], "a"), (6, [1e30, 0.0], "a")]
    odd = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in exact_topk.top_k(odd).collect()}
    assert got[0, 2] == (4, 64 * 64 * 5) and got[20, 2] == (0, 4096) and got[20, 3] == (4, 4096) and (0, 1) in got and (40, 1) not in got
    assert len([k for k in got if k[0] == 0]) == 4
    assert exact_topk.top_k(odd.limit(0)).count() == 0


def test_top_k_over_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(53)
    vectors = [(i, (rng.normal(0, 1, 12) * (4 if i % 9 == 0 else 1) / (1 + i % 7)).tolist()) for i in range(700)] + [(2000 + i, [0.5] * 12) for i in range(60)]
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in vectors}
    want = {}
    for q in (i for i in whole if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[c])), c) for c in whole if c != q)[:5]
        want.update({(q, n + 1): (c, -s) for n, (s, c) in enumerate(best)})
    for name, value in (("BLOCK", 40), ("QUERIES", 10), ("AT_ONCE", 4), ("BORDERS", 3)):
        monkeypatch.setattr(exact_topk, name, value)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in exact_topk.top_k(df, 5).collect()} == want
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(50)], "vec_id long, embedding array<double>")
    got = exact_topk.top_k(same, 3).collect()
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == {(0, 1, 1), (0, 2, 2), (0, 3, 3), (20, 1, 0), (20, 2, 1), (20, 3, 2), (40, 1, 0), (40, 2, 1), (40, 3, 2)}


def python_steps(plan):
    """The most Python nodes on a way through one stage of the plan, and the nodes since the stage's beginning."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return python_steps(plan.executedPlan())
    below = [python_steps(plan.children().apply(i)) for i in range(plan.children().size())]
    most, here = (max((x[i] for x in below), default=0) for i in (0, 1))
    here = 0 if "Exchange" in plan.nodeName() else here + ("MapInArrow" in plan.nodeName())
    return max(most, here), here


def test_pipeline_tasks_take_one_python_worker(spark, sf_dir, monkeypatch):
    """Else an executor ends up with more workers than cores, and each keeps its own table of pieces in the BPE stage."""
    steps, write = [], common.written

    def counted(df, name):
        steps.append((name, python_steps(df._jdf.queryExecution().executedPlan())[0]))
        return write(df, name)

    for module in (common, line_dedup, simhash_dedup):
        monkeypatch.setattr(module, "written", counted)
    docs = table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = counted(stage(spark, docs, sf_dir), name)
    assert len(steps) > len(corpus_pipeline.STAGES) and max(n for _, n in steps) == 1, steps


def test_pipeline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = common.written(stage(spark, before, sf_dir), "test")
        assert docs.columns == columns, name
        assert docs.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
    final = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in final) == sorted(r.doc_id for r in docs.collect())
    assert all(len(r.ids) == r.n_tokens for r in final)
    assert "pipeline" in queries.queries() and corpus_pipeline.ORACLE_SQL is None
