"""Fuzzy line dedup by MinHash: one line of every group of near-equal lines stays.

Lines end at a newline. A line's set is its distinct ``SHINGLE``-character substrings; lines are linked at a Jaccard
similarity of ``SIMILARITY`` = 0.8 or more. ``BANDS`` x ``ROWS`` minima per line make the band keys (a pair at 0.8 shares a
band with probability 0.995, at 0.85 with 0.9994); lines that share a key are candidates, their texts are compared
exactly, and a distributed union-find joins the links. Of each component, and of each set of exact copies, the first
occurrence by (doc_id, line number) stays.

Scale: signatures are made in the task that reads the document and only 16-byte records are shuffled. Texts of candidate
lines alone are fetched, by a second pass over the documents through a fixed-size Bloom filter. A band's group of up to
``ALL_PAIRS`` lines is written as pairs. A larger one (thousands of lines of one template) is dealt over a triangular grid
of cells of about ``CROWD`` lines or ``CROWD_BYTES`` of text a side, in which every two lines still meet; a cell counts
common shingles through an inverted index and emits a spanning forest of its links, so output stays linear. Work on such a
group grows with its square unless its lines are near copies of each other.

Cases: a null text stays null and has no lines; blank lines are never removed; a line shorter than a shingle is only
compared exactly; a text all of whose lines go becomes empty and its row stays; repeated rows keep the same lines; rows of
one doc_id with different texts are told apart by the line's hash; a null doc_id sorts first; an empty table returns no
rows; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import byte_column, components, mix64, packed, partitions, pieces, ship, unpacked, unused, written

SHINGLE, SIMILARITY, BANDS, ROWS = 7, 0.8, 10, 4
ALL_PAIRS, CROWD, CROWD_BYTES = 32, 2048, 512 << 10
#: Bits of a line's bitmap in the comparison.
SKETCH = 4096
#: The Bloom filter's bits; its size doesn't depend on the data.
FILTER_BITS = 1 << 26
_RECORD = np.dtype([("key", "<u8"), ("lid", "<u8")])
_ODD = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32) | np.uint32(1)


def line_hash(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(line)


def rolled(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of all shingles of the lines, one line after the other, and each line's first place among them; every
    line must have SHINGLE characters."""
    raw = "".join(lines).encode("utf-32-le", "surrogatepass")
    text = np.frombuffer(raw, np.uint32)
    counts = np.fromiter(map(len, lines), np.int64, len(lines)) - (SHINGLE - 1)
    width = len(text) - SHINGLE + 1
    shingle = np.zeros(width, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(SHINGLE):
            shingle = shingle * np.uint32(0x01000193) + text[i : i + width]
            shingle ^= shingle >> np.uint32(15)
        starts = np.cumsum(counts + SHINGLE - 1) - (counts + SHINGLE - 1)
        inside = np.ones(width + SHINGLE - 1, bool)  # not the windows that cross into the next line
        tails = (starts + counts)[:, None] + np.arange(SHINGLE - 1)[None, :]
        inside[tails.ravel()] = False
        shingle = shingle[inside[:width]]
        shingle = shingle * np.uint32(0x85EBCA6B)
        shingle ^= shingle >> np.uint32(13)
    return shingle, np.cumsum(counts) - counts


def band_keys(lines: list[bytes]) -> np.ndarray:
    """(lines, BANDS) keys; every line must have SHINGLE characters."""
    shingle, at = rolled([line.decode("utf-8", "surrogatepass") for line in lines])
    with np.errstate(over="ignore"):
        keys = np.empty((len(lines), BANDS), np.uint64)
        permuted = np.empty_like(shingle)
        for band in range(BANDS):
            key = np.full(len(lines), band + 1, np.uint64)
            for j in range(band * ROWS, (band + 1) * ROWS):
                low = np.minimum.reduceat(np.multiply(shingle, _ODD[j], out=permuted), at)
                key = mix64(key * np.uint64(0x100000001B3) ^ low.astype(np.uint64))
            keys[:, band] = key
    return keys


def candidates(keys: np.ndarray, lids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of line hashes (low, high) that share a key, and (key, line hash) of every line in a group of over ALL_PAIRS."""
    order = np.lexsort((lids, keys))
    keys, lids = keys[order], lids[order]
    if len(keys):
        new = np.r_[True, (keys[1:] != keys[:-1]) | (lids[1:] != lids[:-1])]
        keys, lids = keys[new], lids[new]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, int)
    sizes = np.diff(np.r_[starts, len(keys)])
    size = np.repeat(sizes, sizes)
    crowd = np.column_stack([keys[size > ALL_PAIRS], lids[size > ALL_PAIRS]])
    few = np.flatnonzero((size > 1) & (size <= ALL_PAIRS))
    k, l = keys[few], lids[few]
    out = [np.empty((0, 2), np.uint64)]
    for step in range(1, ALL_PAIRS):
        if len(k) <= step:
            break
        at = np.flatnonzero(k[step:] == k[:-step])
        if not len(at):
            break
        out.append(np.column_stack([l[at], l[at + step]]))
    pairs = np.sort(np.concatenate(out), axis=1)
    return np.unique(pairs, axis=0) if len(pairs) else pairs, crowd


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(len(line) - SHINGLE + 1)}


def similar(x: set[str], y: set[str]) -> bool:
    if min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
        return False
    both = len(x & y)
    return both >= SIMILARITY * (len(x) + len(y) - both) and both > 0


def sketches(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A bitmap of each line's hashed shingles, and how many shingles it has at most."""
    out, most = np.empty((len(lines), SKETCH // 64), np.uint64), np.fromiter(map(len, lines), np.int64, len(lines)) - (SHINGLE - 1)
    for a in range(0, len(lines), 2048):
        hashes, at = rolled(lines[a : a + 2048])
        n = len(at)
        flags = np.zeros(n * SKETCH, bool)
        owner = np.repeat(np.arange(n, dtype=np.int64) * SKETCH, np.diff(np.r_[at, len(hashes)]))
        flags[owner + (hashes >> np.uint32(8) & np.uint32(SKETCH - 1)).astype(np.int64)] = True
        out[a : a + n] = np.packbits(flags.reshape(n, SKETCH), axis=1).view(np.uint64)
    return out, most


def _prefix(x: str, y: str) -> int:
    """How many characters x and y begin with in common."""
    low, high = 0, min(len(x), len(y))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if x[low:middle] == y[low:middle] else (low, middle - 1)
    return low


def verified(lines: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each pair of places in ``lines`` has a Jaccard similarity of SIMILARITY or more. Sets that are that alike
    differ in at most (1 - s) / (1 + s) of their elements, and every bit in which two bitmaps differ is an element that the
    sets differ in: what a bitmap rules out needs no sets. Nor does a pair whose common beginning and end hold enough."""
    bits, most = sketches(lines)
    ok = np.zeros(len(a), bool)
    for at in range(0, len(a), 8192):
        x, y = a[at : at + 8192], b[at : at + 8192]
        ok[at : at + 8192] = np.bitwise_count(bits[x] ^ bits[y]).sum(1) * (1 + SIMILARITY) <= (1 - SIMILARITY) * (most[x] + most[y]) + 1e-6
    least = np.bitwise_count(bits).sum(1).tolist()  # a line has a shingle for each of its bits
    unsure = []
    for i in np.flatnonzero(ok).tolist():
        p, q = int(a[i]), int(b[i])
        x, y = lines[p], lines[q]
        front = _prefix(x, y)
        back = _prefix(x[front:][::-1], y[front:][::-1])
        shared = max(0, front - SHINGLE + 1) + max(0, back - SHINGLE + 1)
        m, n = len(x) - SHINGLE + 1, len(y) - SHINGLE + 1
        both = max(least[p] - (m - shared), least[q] - (n - shared))
        if both <= 0 or both * (1 + SIMILARITY) < SIMILARITY * (m + n):
            unsure.append(i)
    may = np.array(unsure, np.int64)
    last = np.full(len(lines), -1)
    last[a[may]] = may
    last[b[may]] = np.maximum(last[b[may]], may)
    sets: dict[int, set[str]] = {}
    for i in may.tolist():
        x, y = int(a[i]), int(b[i])
        for line in (x, y):
            if line not in sets:
                sets[line] = shingles(lines[line])
        ok[i] = similar(sets[x], sets[y])
        for line in (x, y):
            if last[line] == i:
                sets.pop(line, None)  # no later pair has it
    return ok


def crowd_links(lines: list[str]) -> list[tuple[int, int]]:
    """A spanning forest of the links among lines, by their places in the list; every line must have SHINGLE characters."""
    known: dict[str, int] = {}
    sets = [np.fromiter({known.setdefault(x, len(known)) for x in shingles(line)}, np.int64) for line in lines]
    sizes, flat = np.array([len(x) for x in sets]), np.concatenate(sets)
    held = np.bincount(flat, minlength=len(known))
    holders = np.repeat(np.arange(len(lines)), sizes)[np.argsort(flat, kind="stable")]
    ends = np.cumsum(held)
    rest, out = np.ones(len(lines), bool), []
    for first in range(len(lines)):
        if not rest[first]:
            continue
        queue, rest[first] = [first], False
        while queue and rest.any():
            i = queue.pop()
            mine = sets[i][held[sets[i]] > 1]  # a shingle of one line adds to no other's count
            if not len(mine):
                continue
            both = np.bincount(np.concatenate([holders[a:b] for a, b in zip(ends[mine] - held[mine], ends[mine])]), minlength=len(lines))
            near = np.flatnonzero(rest & (both > 0) & (both >= SIMILARITY * (sizes + sizes[i] - both)))
            rest[near] = False
            out += [(i, int(j)) for j in near]
            queue += near.tolist()
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def _lines_of(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All lines of a batch's texts, the row of each and its number in that row."""
    texts = byte_column(batch, "text")
    split = [t.split(b"\n") for t in texts]
    counts = np.array([len(x) for x in split])
    rows = np.repeat(np.arange(len(split)), counts)
    numbers = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    return [line for x in split for line in x], rows, numbers


def _candidate_pairs(docs: DataFrame) -> DataFrame:
    """``(a, b, crowd)``: distinct candidate pairs of line hashes; with ``crowd``, a large group's key and a line hash of it."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a line's records take about as many bytes as half its text: 8 MB of them to a partition
    parts = max(partitions(spark), size // (16 << 20))
    buckets = parts * 4

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 512 << 10):
            lines = [x for x in set(_lines_of(batch)[0]) if len(x) >= SHINGLE and not x.isspace()]
            lines = [x for x in lines if len(x) >= 4 * SHINGLE or len(x.decode("utf-8", "surrogatepass")) >= SHINGLE]
            if not lines:
                continue
            keys = band_keys(lines)
            records = np.empty(keys.size, _RECORD)
            records["key"] = keys.ravel()
            records["lid"] = np.repeat(np.fromiter(map(line_hash, lines), np.uint64, len(lines)), BANDS)
            yield packed(records["key"], records, buckets)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = unpacked(batches, _RECORD)
        for rows, crowd in zip(candidates(records["key"], records["lid"]), (False, True)):
            yield pa.RecordBatch.from_arrays([pa.array(_signed(rows[:, 0].copy())), pa.array(_signed(rows[:, 1].copy())), pa.array(np.full(len(rows), crowd))], names=["a", "b", "crowd"])

    dealt = docs.select("text").mapInArrow(sign, "bucket int, blob binary").repartition(parts, "bucket")
    return dealt.mapInArrow(pair, "a long, b long, crowd boolean").distinct()


def _bloom(lids: DataFrame) -> np.ndarray:
    """A fixed-size filter of line hashes: 64-bit words, built by a grouped bit-or; at most FILTER_BITS / 64 rows return."""
    spots = F.array(*[F.shiftrightunsigned("lid", s).bitwiseAND(F.lit(FILTER_BITS - 1).cast("long")) for s in (0, 29)])
    bits = lids.select(F.explode(spots).alias("spot"))
    words = bits.groupBy(F.shiftright("spot", 6).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(spot & 63 as int)))").alias("bits"))
    out = np.zeros(FILTER_BITS >> 6, np.uint64)
    got = words.toArrow()
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _passes(words: np.ndarray, lids: np.ndarray) -> np.ndarray:
    ok = np.ones(len(lids), bool)
    for s in (0, 29):
        spot = (lids >> np.uint64(s)) & np.uint64(FILTER_BITS - 1)
        ok &= (words[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1) == 1
    return ok


def _texts(docs: DataFrame, lids: DataFrame) -> DataFrame:
    """``(lid, text)``: the distinct lines whose hash is in ``lids`` (and a few more that the filter lets through)."""
    spark = docs.sparkSession
    filter_ = spark.sparkContext.broadcast(_bloom(lids))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            lines = list(set(_lines_of(batch)[0]))
            lids = np.fromiter(map(line_hash, lines), np.uint64, len(lines))
            at = np.flatnonzero(_passes(filter_.value, lids))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(_signed(lids[at])), pa.array([lines[i].decode("utf-8", "surrogatepass") for i in at], pa.string())], names=["lid", "text"])

    return docs.select("text").mapInArrow(fetch, "lid long, text string").distinct()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "x", 2 << 20):
        known: dict[str, int] = {}
        a, b = (np.fromiter((known.setdefault(t, len(known)) for t in batch.column(i).to_pylist()), np.int64, batch.num_rows) for i in (2, 3))
        yield batch.select([0, 1]).filter(pa.array(verified(list(known), a, b), pa.bool_()))


def _crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of cells, whose rows come one cell after the other."""

    def linked() -> pa.RecordBatch:
        found = crowd_links(texts)
        return pa.RecordBatch.from_arrays([pa.array([lids[i] for i, _ in found], pa.int64()), pa.array([lids[j] for _, j in found], pa.int64())], names=["a", "b"])

    at, lids, texts = None, [], []
    for batch in pieces(batches, "text", 2 << 20):
        for key, cell, lid, text in zip(*(batch.column(n).to_pylist() for n in ("key", "cell", "lid", "text"))):
            if at != (key, cell):
                if len(lids) > 1:
                    yield linked()
                at, lids, texts = (key, cell), [], []
            lids.append(lid)
            texts.append(text)
    if len(lids) > 1:
        yield linked()


def _crowd_links(crowd: DataFrame, n: int, texts: DataFrame) -> DataFrame:
    """``(a, b)``: links within the ``n`` rows of ``crowd(key, lid)``, each key's lines compared in all pairs."""
    spark = crowd.sparkSession
    sizes = crowd.join(texts.select("lid", F.octet_length("text").alias("bytes")), "lid").groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    sides = sizes.select("key", F.greatest(F.ceil(F.col("n") / CROWD), F.ceil(F.col("bytes") / CROWD_BYTES)).cast("int").alias("sides"))
    mine = F.pmod(F.xxhash64("lid"), "sides").cast("int").alias("mine")
    spread = crowd.join(sides, "key").select("key", "lid", "sides", mine, F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("other"))
    cells = spread.select("key", "lid", (F.least("mine", "other").cast("long") * F.col("sides") + F.greatest("mine", "other")).alias("cell"))
    dealt = cells.join(texts, "lid").repartition(max(partitions(spark), n // 20_000), "key", "cell").sortWithinPartitions("key", "cell")
    return dealt.select("key", "cell", "lid", "text").mapInArrow(_crowded, "a long, b long")


def line_groups(docs: DataFrame) -> DataFrame:
    """``(lid, check, root)`` of every line that is linked to a line of another text, with its component."""
    found = written(_candidate_pairs(docs), "line-pairs")
    pairs, crowd = found.where("not crowd").select("a", "b"), found.where("crowd").select(F.col("a").alias("key"), F.col("b").alias("lid"))
    texts = written(_texts(docs, pairs.select(F.col("a").alias("lid")).union(pairs.select("b")).union(crowd.select("lid"))), "line-texts")
    both = pairs.join(texts.select(F.col("lid").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("lid").alias("b"), F.col("text").alias("y")), "b")
    links = both.select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long")
    n = crowd.count()
    links = written(links.union(_crowd_links(crowd, n, texts)) if n else links, "line-links")
    roots = components(links)
    every = roots.union(roots.select(F.col("root").alias("node"), "root")).distinct()
    return texts.join(every, texts["lid"] == every["node"]).select("lid", F.xxhash64("text").alias("check"), "root")


def removals(docs: DataFrame) -> DataFrame:
    """``(doc_id, numbers, lids)``: of each document the numbers and hashes of the lines that go."""
    ship(docs.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            held, rows, numbers = _lines_of(batch)
            lids = np.fromiter(map(line_hash, held), np.uint64, len(held))
            checks = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in held), np.uint64, len(held))
            full = np.flatnonzero(np.fromiter((len(x) > 0 and not x.isspace() for x in held), bool, len(held)))
            ids = batch.column(0).take(pa.array(rows[full]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(numbers[full].astype(np.int32)), pa.array(_signed(lids[full])), pa.array(_signed(checks[full]))], names=["doc_id", "number", "lid", "check"])

    lines = written(docs.select("doc_id", "text").mapInArrow(hashed, "doc_id long, number int, lid long, check long"), "lines")
    grouped = lines.join(line_groups(docs), ["lid", "check"], "left")
    # a component has one key; a line without one is keyed by both its hashes
    keyed = grouped.select("doc_id", "number", "lid", F.coalesce("root", "lid").alias("g"), F.when(F.col("root").isNull(), F.col("check")).otherwise(0).alias("h"))
    # as a table of its own, so that the join's hot keys (one line in a third of all documents) can be split
    first = written(keyed.groupBy("g", "h").agg(F.min(F.struct("doc_id", "number")).alias("first"), F.count("*").alias("n")).where("n > 1"), "line-firsts")
    gone = keyed.join(first, ["g", "h"]).where(~F.struct("doc_id", "number").eqNullSafe(F.col("first")))
    return gone.groupBy("doc_id").agg(F.collect_list("number").alias("numbers"), F.collect_list("lid").alias("lids"))


def _kept(text: bytes, numbers: list[int] | None, lids: list[int] | None) -> tuple[bytes, int, int]:
    """The text without the lines that go, and how many lines there were and went."""
    lines = text.split(b"\n")
    if not numbers:
        return text, len(lines), 0
    gone = {(n, h & 0xFFFFFFFFFFFFFFFF) for n, h in zip(numbers, lids)}
    where = {n for n, _ in gone}
    kept = [x for i, x in enumerate(lines) if i not in where or (i, line_hash(x)) not in gone]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def _joined(docs: DataFrame) -> DataFrame:
    """``docs`` with two more columns at the end: the numbers and the hashes of the lines that go."""
    own, numbers, lids = unused(docs, "gone_id", "gone_numbers", "gone_lids")
    gone = removals(docs).toDF(own, numbers, lids)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone[own]), "left").drop(own)


def line_digest(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_lines, n_removed, kept_sha256`` (of the text that stays; null for a null text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 4 << 20):
            texts, numbers, lids = (batch.column(i).to_pylist() for i in (1, 2, 3))
            out = [_kept((t or "").encode(), n, h) for t, n, h in zip(texts, numbers, lids)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([0 if t is None else x[1] for t, x in zip(texts, out)], pa.int64()), pa.array([x[2] for x in out], pa.int64()),
                pa.array([None if t is None else hashlib.sha256(x[0]).hexdigest() for t, x in zip(texts, out)], pa.string()),
            ], names=["doc_id", "n_lines", "n_removed", "kept_sha256"])

    return _joined(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_lines long, n_removed long, kept_sha256 string")


def drop_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines that go taken out of ``text`` (and ``n_chars`` recounted if there is one)."""
    schema = docs.schema
    at = schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 4 << 20):
            columns, (numbers, lids) = batch.columns[: len(schema)], (x.to_pylist() for x in batch.columns[len(schema) :])
            texts = columns[at].to_pylist()
            out = [None if t is None else _kept(t.encode(), n, h)[0].decode() if n else t for t, n, h in zip(texts, numbers, lids)]
            columns[at] = pa.array(out, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    out = _joined(docs).mapInArrow(run, schema)
    return out.withColumn("n_chars", F.char_length("text").cast(schema["n_chars"].dataType)) if "n_chars" in schema.fieldNames() else out
