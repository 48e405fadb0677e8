"""The operators' cores against brute force, without Spark."""

import base64
import random
import textwrap
import tracemalloc
from itertools import combinations

import numpy as np
import pytest
import public_tokenizers
import tiktoken
import xxhash

from lodestrata.llm import bpe_codec, chained_passages, common, crf_quality, decontaminate, exact_topk, license_scan, line_dedup, simhash_dedup, suffix_dedup


def test_unioned_matches_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 40, 30), rng.integers(0, 40, 30)
        root = {}
        find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
        for x, y in zip(a.tolist(), b.tolist()):
            p, q = find(x), find(y)
            root[max(p, q)] = min(p, q)
        nodes, tops = common.unioned(a, b)
        assert dict(zip(nodes.tolist(), tops.tolist())) == {x: find(x) for x in list(root) if find(x) != x}


def test_fingerprint_bits(monkeypatch):
    text = "The quick brown fox\tjumps\n over THE lazy dog dog dog dog dog dog"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)]
    want = sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))
    assert simhash_dedup.fingerprint(text.encode()) == want
    many = text * 40
    whole = simhash_dedup.fingerprint(many.encode())
    monkeypatch.setattr(simhash_dedup, "STRETCH", 7)
    assert simhash_dedup.fingerprint(many.encode()) == whole and simhash_dedup.fingerprint(text.encode()) == want
    assert simhash_dedup.fingerprint(b" \n") == 0 and simhash_dedup.fingerprint(b"One two") == xxhash.xxh64_intdigest("one two", 42)


@pytest.mark.parametrize("cell", [16_384, 40])
def test_variant_links_find_every_component(monkeypatch, cell):
    monkeypatch.setattr(simhash_dedup, "CELL", cell)
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(20)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(25)} | {rng.getrandbits(64) for _ in range(100)}
    fps = np.array(sorted(fps), dtype=np.uint64)
    counts = {}
    for s, (first, n) in enumerate(simhash_dedup.SEGMENTS):
        for v, c in zip(*np.unique((fps >> np.uint64(first)) & np.uint64((1 << n) - 1), return_counts=True)):
            counts[s, int(v)] = int(c)
    hot = {k: c for k, c in counts.items() if c > cell // 2}
    assert bool(hot) == (cell == 40) or cell == 40
    keys, owners = simhash_dedup._variants(fps, hot)
    a, b = simhash_dedup.links(keys, owners)
    assert (np.bitwise_count(a ^ b) <= 4).all()
    nodes, roots = common.unioned(a.view(np.int64), b.view(np.int64))
    got = dict(zip(nodes.tolist(), roots.tolist()))
    x, y = zip(*[(p, q) for p, q in combinations(fps.view(np.int64).tolist(), 2) if ((p ^ q) & (2**64 - 1)).bit_count() <= 4])
    nodes, roots = common.unioned(np.array(x), np.array(y))
    assert got == dict(zip(nodes.tolist(), roots.tolist()))


@pytest.fixture(scope="module")
def vocabulary():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(vocabulary):
    path, ranks, encoding = vocabulary
    codec = bpe_codec.Codec(bpe_codec.read_ranks(path), public_tokenizers.PATTERN)
    rng = random.Random(5)
    texts = ["", " ", "<|endoftext|>", "a" * 5000, "ab" * 4000, "\u0000 x", "I'll go\n\n  now"] + ["".join(rng.choice(s) for _ in range(n)) for s in ("abcaéñ的語 theinr😀", "aabtheinrs", "  \n\t!?. ") for n in (5, 60, 900)]
    for text in texts:
        ids = codec.encode(text)
        assert ids == encoding.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()
    assert not any(codec.queue.leaf)


def brute_hits(text, items):
    words, hit, found = decontaminate.words_of(text), set(), set()
    for item, t in items:
        w = decontaminate.words_of(t)
        m = min(10, len(w))
        windows = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
        for i in range(len(words) - m + 1):
            if m and tuple(words[i : i + m]) in windows:
                hit |= set(range(i, i + m))
                found.add(item)
    return hit, found


def test_wu_manber_matches_brute_force():
    rng = random.Random(7)
    for _ in range(200):
        items = [(i, " ".join(rng.choices("abc", k=rng.choice([0, 1, 2, 3, 9, 10, 11, 14]))).encode()) for i in range(6)]
        text = " ".join(rng.choices("abcd", k=rng.choice([0, 5, 40, 120]))).encode()
        if rng.random() < 0.7:
            text += b" -- " + rng.choice(items)[1].upper() + b"! x"
        spans, found = decontaminate.Patterns(items).search(decontaminate.words_of(text))
        assert ({i for a, b in spans for i in range(a, b)}, found) == brute_hits(text, items)


def test_deep_shallow_orders_and_measures():
    rng = random.Random(9)
    for n, alphabet in ((1, "ab"), (50, "ab"), (400, "abc")):
        strings = []
        for _ in range(n):
            base = rng.choice(strings)[: rng.randint(0, 100)] if strings and rng.random() < 0.8 else ""
            strings.append((base + "".join(rng.choices(alphabet, k=100)))[:100])
        rows = np.array([list(s.encode()) for s in strings], np.uint8)
        order, common_ = suffix_dedup.deep_shallow(rows)
        got = [strings[i] for i in order]
        assert got == sorted(strings)
        for i in range(1, n):
            same = next((k for k in range(100) if got[i][k] != got[i - 1][k]), 100)
            assert common_[i] == (same if same >= suffix_dedup.GRAM else 0)


def test_seeds_and_chains():
    words = [f"w{i}".encode() for i in range(200)]
    text, at, keys = chained_passages.seeds([[], words, words[:60], [b"w"], words[5:45]])
    for i, n in ((1, 200), (2, 60), (4, 40)):  # texts don't change each other's seeds
        own = chained_passages.seeds([words[:n] if i < 4 else words[5:45]])
        assert set(zip(at[text == i].tolist(), keys[text == i].tolist())) == set(zip(own[1].tolist(), own[2].tolist()))
    assert (keys[text == 4] & np.uint64(3) == 2).sum() == 1 and chained_passages.seeds([])[0].size == 0
    forty = np.sort(at[(text == 1) & (keys & np.uint64(3) == 2)])
    assert np.diff(forty).max() <= chained_passages.RUNGS[2][1]
    other = [b"x"] * 30 + words[50:120] + [b"y"] * 10
    assert [found[:5] for found in matched(other, words)] == [(30, 100, 50, 120, 70)]


def matched(x, y):
    """What the operator reports of two documents alone."""
    known = dict(zip(*(v.tolist() for v in chained_passages.seeds([y])[:0:-1])))
    hits = [(p, known[k], chained_passages.RUNGS[k & 3][0]) for p, k in zip(*(v.tolist() for v in chained_passages.seeds([x])[1:])) if k in known]
    if not hits:
        return []
    found = [chained_passages.align(x, y, [f[:3] for f in path]) for path in chained_passages.chains(chained_passages.fragments(*map(np.array, zip(*hits))))]
    return [f for f in found if f[1] - f[0] >= chained_passages.MIN_WORDS and f[4] >= 0.8 * max(f[1] - f[0], f[3] - f[2])]


@pytest.mark.parametrize(("size", "changed"), [(50, 2), (50, 4), (50, 5), (50, 7), (80, 4), (80, 8), (80, 12), (200, 30)])
def test_fuzzy_passages_are_found(size, changed):
    rng = random.Random(size * 100 + changed)
    word = lambda: f"v{rng.randrange(3000)}".encode()
    tries = caught = 0
    for _ in range(150):
        passage = [word() for _ in range(size)]
        copy = list(passage)
        for i in rng.sample(range(1, size - 1), changed):
            copy[i] = rng.choice([b"other", b"", b"two words"]) if rng.random() < 0.3 else word()
        copy = b" ".join(copy).split()
        if chained_passages.common_words(passage, copy) < 0.8 * max(size, len(copy)):
            continue
        x, y = ([word() for _ in range(rng.randint(20, 200))] + p + [word() for _ in range(rng.randint(20, 200))] for p in (passage, copy))
        tries += 1
        caught += bool(matched(x, y))
    assert tries > 100 and caught >= 0.93 * tries


def test_common_words_match_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        x, y = ([rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 30))] for _ in range(2))
        row = [0] * (len(y) + 1)
        for a in x:
            old, row = row, [0]
            for j, b in enumerate(y):
                row.append(old[j] + 1 if a == b else max(old[j + 1], row[j]))
        assert chained_passages.common_words(x, y) == row[-1]


def test_occurrences_that_meet(monkeypatch):
    key, doc, pos = np.array([8, 8, 5, 8, 5, 8], np.uint64), np.array([3, 1, 7, 2, 7, 3], np.int64), np.array([4, 9, 0, 6, 5, 1], np.uint32)
    pairs = lambda found: sorted(zip(*(v.tolist() for v in found)))
    on, found = chained_passages.met(key, doc, pos)
    assert sorted(on) == [0, 1, 2, 3, 4, 5] and pairs(found) == [(2, 1, 1, 6, 9, 0), (3, 1, 1, 1, 9, 0), (3, 1, 1, 4, 9, 0), (3, 2, 1, 1, 6, 0), (3, 2, 1, 4, 6, 0)]
    assert len(chained_passages.met(key, doc, pos, False)[1][0]) == 0
    monkeypatch.setattr(chained_passages, "PAIRS", 3)
    on, found = chained_passages.met(key, doc, pos, False)
    assert sorted(on) == [1, 2, 4] and pairs(found) == [(2, 1, 1, 6, 9, 0), (3, 1, 1, 1, 9, 0), (3, 1, 1, 4, 9, 0), (3, 2, 1, 1, 6, 4)]
    assert chained_passages.met(key[:0], doc[:0], pos[:0])[0].size == 0


def dealt(fields, buckets=3):
    """Packed records as a task gets them: several blobs for each bucket, which their first field decides."""
    out = {}
    for part in (slice(0, None, 2), slice(1, None, 2)):
        chained_passages._by_bucket(suffix_dedup._dealt(0, fields[0][part].view(np.uint64), [x[part] for x in fields], buckets), out)
    return out


def test_matches_by_parts(monkeypatch):
    rng = np.random.default_rng(11)
    key = np.r_[rng.integers(0, 400, 3_000), np.full(500, 7), np.full(150, 9)].astype(np.uint64)  # two keys of more than PAIRS
    doc, pos = rng.integers(0, 300, len(key)), rng.integers(0, 5_000, len(key)).astype(np.uint32)
    whole = chained_passages.met(key, doc, pos)[1]
    monkeypatch.setattr(chained_passages, "AT_ONCE", 1_000)
    parts = list(chained_passages.met_by_parts(dealt([key, doc, pos])))
    rows = lambda x: sorted(zip(*(v.tolist() for v in x)))
    assert len(parts) > 10 and max(len(p[0]) for p in parts) <= 1_000 and rows(whole) == sorted(r for p in parts for r in rows(p))
    assert list(chained_passages.met_by_parts({})) == [] and list(chained_passages.stretches(key[:0], 5)) == []
    for weight in (1, 100, 10**6):  # a key of more than the limit stands alone, and no key is in two stretches
        found = list(chained_passages.stretches(key, weight))
        assert sorted(np.concatenate(found)) == [*range(len(key))] and len({k for f in found for k in set(key[f].tolist())}) == sum(len(set(key[f].tolist())) for f in found)
        assert all(len(f) <= weight or len(set(key[f].tolist())) == 1 for f in found)


def test_chains_by_parts_take_less_memory(monkeypatch):
    # 600 documents share passages with up to 12 before them: seeds of 5 words at every other place, the first holder in lead
    rng, records = np.random.default_rng(12), []
    for doc in range(600):
        others = sorted(rng.choice(10_000, 12, replace=False) - 20_000)
        for other in others:
            n, pos, at = int(rng.integers(5, 40)), int(rng.integers(0, 500)), int(rng.integers(0, 500))
            records += [(doc, other, others[0], pos + 2 * i, at + 2 * i + (i > 20), 0) for i in range(n)]
    fields = [np.array(x, np.dtype(kind)) for x, (_, kind) in zip(zip(*records), chained_passages._MATCH)]

    def measured(run):
        tracemalloc.start()
        out = run()
        _, peak = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        return out, peak

    whole, before = measured(lambda: chained_passages.pair_chains(*fields))
    monkeypatch.setattr(chained_passages, "AT_ONCE", 5_000)
    blobs = dealt(fields, 8)
    parts, peak = measured(lambda: [r for rows in chained_passages.chained_by_parts(blobs) for r in rows])
    assert len(whole) > 5_000 and sorted(parts) == sorted(whole) and not blobs
    assert peak < before / 2


def test_runs_of_frequent_seeds_by_parts(monkeypatch):
    # 80 texts of 300 words that all hold, with an edit in about thirty of them; each equal run of 40 words is linked with its first holder
    rng = random.Random(19)
    shared = [f"v{i}".encode() for i in range(300)]
    texts = [[b"w%d" % rng.randrange(10**6) if rng.random() < 0.03 else w for w in shared] for _ in range(80)]
    text, at, key = chained_passages.seeds(texts)
    often = chained_passages.frequent(key, np.zeros(len(key)))
    held = []
    for doc, words in enumerate(texts):
        mine = often & (text == doc)
        keys, pos, five, around = chained_passages.neighbourhoods(words, key[mine], at[mine])
        held.append((keys, np.full(len(keys), doc, np.int64), pos, five, around))
    fields = [np.concatenate(x) for x in zip(*held)]

    def runs():
        out = []
        for batch in chained_passages.runs_by_parts(dealt(fields)):
            out += [(d, o, *chained_passages.unpacked_chains(c)[0][0]) for d, o, c in zip(*(batch.column(i).to_pylist() for i in range(3)))]
        return out

    found = runs()
    assert all(texts[d][p : p + n] == texts[o][a : a + n] for d, o, p, a, n in found)
    links, first = set(), {}
    for doc, words in enumerate(texts):
        starts = set(at[often & (text == doc) & (key & np.uint64(3) == 0)].tolist())
        for i in range(len(words) - 39):
            lead = first.setdefault((i, *words[i : i + 40]), doc)
            if lead != doc and starts & {*range(i, i + 36)}:
                links.add((doc, lead))
    assert len(links) > 200 and links <= {x[:2] for x in found}
    assert len([x for x in found if x[4] == 40]) < 8 * len(links)
    monkeypatch.setattr(chained_passages, "TOGETHER", 1)
    assert set(runs()) == set(found)


def test_best_chain_matches_brute_force():
    rng = random.Random(11)
    for _ in range(200):
        parts = [(rng.randint(0, 60), rng.randint(0, 60), n := rng.randint(5, 15), n) for _ in range(7)]
        parts = list({p[:2]: p for p in parts}.values())

        def value(path):
            total = sum(f[3] for f in path)
            for f, g in zip(path, path[1:]):
                if f[0] + f[2] > g[0] or f[1] + f[2] > g[1]:
                    return -1
                total -= chained_passages.GAP * (g[0] - f[0] - f[2] + g[1] - f[1] - f[2])
            return total

        best = max(value(p) for r in range(1, len(parts) + 1) for p in combinations(sorted(parts), r))
        got = chained_passages.chains(parts)
        if sum(f[3] for f in (got[0] if got else [])) >= chained_passages.MIN_CHAIN:
            assert abs(max(value(p) for p in got) - best) < 1e-9 or best < chained_passages.MIN_CHAIN


def alike(a, b):
    return line_dedup.similar(line_dedup.shingles(a), line_dedup.shingles(b))


def test_verified_pairs_match_the_sets():
    rng = random.Random(23)
    lines = []
    for n in (7, 8, 40, 300, 3000):
        for letters in ("ab", "abcdefgh ", "abé€😀 "):
            base = "".join(rng.choices(letters, k=n))
            lines += [base, base + "x", base[: n // 2] + "yz" + base[n // 2 :], base[n // 10 :], base[: n // 2] * 2, "".join(rng.choices(letters, k=n))]
            for share in (0.005, 0.02, 0.1):
                lines.append("".join(rng.choice(letters) if rng.random() < share else c for c in base))
    lines = sorted({x for x in lines if len(x) >= line_dedup.SHINGLE})
    a, b = (np.array(x) for x in zip(*combinations(range(len(lines)), 2)))
    got = line_dedup.verified(lines, a, b)
    assert got.tolist() == [alike(lines[i], lines[j]) for i, j in zip(a, b)] and 30 < got.sum() < len(got) - 30


def test_line_similarity_and_bands():
    rng = random.Random(13)
    base = "".join(rng.choices("abcdefgh ", k=300))
    near = base[:150] + "X" + base[151:]
    assert alike(base, near) and not alike(base, base[::-1])
    keys = line_dedup.band_keys([base.encode(), near.encode(), base[::-1].encode()])
    assert (keys[0] == keys[1]).any() and not (keys[0] == keys[2]).any()
    found = caught = 0
    for _ in range(200):
        a = "".join(rng.choices("abcdefgh ", k=200))
        cut = list(a)
        for i in rng.sample(range(200), 3):
            cut[i] = "Z"
        b = "".join(cut)
        if alike(a, b):
            found += 1
            caught += bool((np.diff(line_dedup.band_keys([a.encode(), b.encode()]), axis=0) == 0).any())
    assert found > 50 and caught >= 0.97 * found


def test_top_k_scores_and_pruning():
    rng = np.random.default_rng(17)
    q, c = rng.integers(-64, 64, (30, 24)), rng.integers(-64, 64, (500, 24)) * rng.integers(1, 6, (500, 1))
    c = c[np.argsort(-np.linalg.norm(c, axis=1))]
    ids, own = np.arange(500, dtype=np.int64), np.arange(30, dtype=np.int64)
    rotation = np.linalg.eigh((c.T @ c).astype(float))[1][:, ::-1]
    exact = q @ c.T
    exact[own, own] = -(10**9)
    floor = np.sort(exact, axis=1)[:, -5].astype(float)
    for low in (np.full(30, -np.inf), floor):
        row, vec, score = exact_topk.best(own, q, ids, c, low, rotation, 5)
        for i in range(30):
            want = sorted(range(500), key=lambda j: (-exact[i, j], j))[:5]
            assert vec[row == i].tolist() == want and score[row == i].tolist() == [exact[i, j] for j in want]
    big = np.array([[2**40, 2**40]])
    assert exact_topk.scores(big, big)[0, 0] == 2**63 - 1


def test_crf_marginals_match_enumeration():
    rng = np.random.default_rng(19)
    per_text = np.array([1, 4, 3])
    node, trans = rng.normal(size=8), rng.normal(size=(2, 2))
    good, _, logs = crf_quality.forward_backward(node, trans, per_text)
    total, start = 0.0, 0
    for n in per_text:
        weights = {}
        for labels in np.ndindex(*[2] * n):
            weights[labels] = np.exp(sum(node[start + i] * x for i, x in enumerate(labels)) + sum(trans[a, b] for a, b in zip(labels, labels[1:])))
        z = sum(weights.values())
        total += np.log(z)
        for i in range(n):
            assert abs(good[start + i] - sum(w for k, w in weights.items() if k[i]) / z) < 1e-9
        start += n
    assert abs(total - logs) < 1e-9


def test_crf_learns_and_scores_anything():
    rng = random.Random(23)
    text = lambda ok: "\n".join(" ".join("".join(rng.choices("abcdef", k=5)) for _ in range(12)) if ok else "buy now!! " * 9 for _ in range(4)).encode()
    labels = np.array([i % 2 for i in range(60)], float)
    model = crf_quality.Model().train(*crf_quality.line_features([text(x) for x in labels]), labels)
    scores = model.score([text(1), text(0), b"", b"x" * 200_000, b"\n" * 1000])
    assert scores[0] > 0.9 and scores[1] < 0.1 and ((scores >= 0) & (scores <= 1)).all()


def test_licences():
    plain = [" ".join(random.Random(i).choices("the of and river stone walked quietly under old bridge".split(), k=20)).encode() for i in range(200)]
    model = license_scan.Model(plain)
    assert model.accuracy > 0.95 and model.unseen > 0.8
    text = b"A stone walked.\n\nReleased under the MIT License.\nThis work is licensed under the GNU General Public License, version 2.\nYou need a fishing license here."
    count, found = model.paragraphs(text)
    assert count == 4 and [(f[0], f[1], f[3]) for f in found] == [(2, "MIT", True), (3, "GPL", True)]
    assert model.paragraphs(b"") == (0, [])


def test_licence_wrapped_over_lines():
    words = "stone river walked under table with many small quiet horses and old trees near town".split()
    rng = random.Random(41)
    model = license_scan.Model([" ".join(rng.choices(words, k=25)).encode() for _ in range(200)])
    for family, texts in license_scan.TEMPLATES.items():
        for text in texts:
            for width in (72, 80):
                lines = textwrap.wrap(text, width)
                if len(lines) > 1 and model.predict(license_scan.words_of(text.encode()))[0] == family:
                    body = "A stone walked.\n\n * " + "\n * ".join(lines) + "\n\nQuiet horses."
                    count, found = model.paragraphs(body.encode())
                    assert count == len(lines) + 2 and [f[:2] + f[3:] for f in found if f[3]][:1] == [(2, family, True)], (text, found)


def test_long_texts_have_the_same_marginals():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 1000, 1030, 5000):
        node, trans = rng.normal(0, 3, n), rng.normal(0, 1, (2, 2))
        want = crf_quality.forward_backward(node, trans, np.array([n]))[0]
        assert np.allclose(crf_quality.long_marginals(node, trans), want, atol=1e-9)
    per_text = np.array([3, 1500, 1, 2000, 40])
    node = rng.normal(0, 2, per_text.sum())
    assert np.allclose(crf_quality.marginals(node, trans, per_text), crf_quality.forward_backward(node, trans, per_text)[0], atol=1e-9)


def test_line_scores_match_the_features(monkeypatch):
    texts = [b"one line\nANOTHER | line!!\n\nlast", b"", b"\n\n", "é 1 2 3\nx".encode(), b"alone"]
    weights = np.random.default_rng(4).normal(0, 1, 3 * crf_quality._OWN - 2)
    x, length, per_text = crf_quality.line_features(texts)
    for lines in (50_000, 2):
        monkeypatch.setattr(crf_quality, "LINES", lines)
        got = crf_quality.line_scores(texts, weights)
        assert np.allclose(got[0], x @ weights) and (got[1] == length).all() and (got[2] == per_text).all()


def test_a_text_of_a_million_lines_takes_bounded_memory():
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    model = crf_quality.Model()
    model.weights = np.random.default_rng(5).normal(0, 1, 3 * crf_quality._OWN - 2)
    assert 0 <= model.score([b"\n" * 2_000_000, b"x\n" * 300_000])[0] <= 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 700_000  # KB


def test_lean_steps_give_back_what_they_took(monkeypatch):
    monkeypatch.setattr(common, "_HELD", {"table": [0]})
    seen = []

    def step(batches):
        for batch in batches:
            seen.append(dict(common._HELD))
            yield batch + 1

    assert list(common.lean(step)(iter([1, 2]))) == [2, 3] and seen == [{"table": [0]}] * 2 and not common._HELD
