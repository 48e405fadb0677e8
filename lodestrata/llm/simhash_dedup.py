"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits and links allow ``MAX_BITS`` = 4 differing ones. Cut into three segments, one segment of any
linked pair differs in at most one bit. Each segment is therefore indexed under all its one-wildcard variants (the
segment with one bit masked out): two segments within one bit share such a variant. An equality join on the variant
finds every pair; the whole fingerprint then verifies it. Only distinct fingerprints enter the index.

Skew: copies share a fingerprint and enter once. A segment value that many fingerprints share (a large near-copy group)
is counted first; its variants are dealt over a triangular grid of cells, in which every two fingerprints still meet, and
a cell holds at most about twice ``CELL`` of them. Within a cell, a breadth-first sweep emits a spanning forest of the
links instead of all pairs, so output stays linear.

Cases: a null text counts as empty; a text without words has fingerprint zero and links like any other; a text of under
four words has one shingle, the whole sequence; repeated rows of a doc_id each return a row; a null doc_id returns its
row and never is the smallest; empty tables return no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import byte_column, components, dropped, packed, partitions, pieces, ship, unioned, unpacked, unused, written

SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: First bit and length of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
CELL = 16_384
#: Shingles that are counted at once.
STRETCH = 50_000
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTES = (np.arange(8, dtype=np.int64) * 256)[None, :]
_RECORD = np.dtype([("key", "<u8"), ("fp", "<u8")])


def fingerprint(text: bytes) -> int:
    """The majority of the shingles' XXH64 bits; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, total = xxhash.xxh64_intdigest, len(words) - SHINGLE + 1
    counts = np.zeros(64, np.int64)
    for start in range(0, total, STRETCH):  # a long text's shingles are counted a stretch at a time
        part = words[start : min(total, start + STRETCH) + SHINGLE - 1]
        joined = b" ".join(part)
        ends = list(accumulate(len(w) + 1 for w in part))
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[SHINGLE - 1 :])]
        raw = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += (np.bincount((raw + _BYTES).ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int.from_bytes(np.packbits(counts * 2 > total, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        fps = np.array([fingerprint(t) for t in byte_column(batch, "text")], dtype=np.uint64).view(np.int64)
        rest = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(fps)], names=[*rest, "fp"])


def _variants(fps: np.ndarray, hot: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all one-wildcard variants, and the fingerprint of each; hot variants once per cell of their grid."""
    keys, owners = [], []
    for s, (first, length) in enumerate(SEGMENTS):
        value = (fps >> np.uint64(first)) & np.uint64((1 << length) - 1)
        counts = np.array([hot.get((s, int(v)), 0) for v in value]) if hot else None
        for bit in range(length):
            masked = value & ~np.uint64(1 << bit)
            key = masked | np.uint64((s * 32 + bit) << 32)
            if hot:
                other = np.array([hot.get((s, int(v)), 0) for v in value ^ np.uint64(1 << bit)])
                sides = np.maximum(1, -(-(counts + other) // CELL))
                for n in np.unique(sides[sides > 1]):
                    at = np.flatnonzero(sides == n)
                    mine = ((fps[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % n
                    for j in range(n):
                        cell = np.minimum(mine, j) * n + np.maximum(mine, j) + 1
                        keys.append(key[at] | (cell.astype(np.uint64) << np.uint64(40)))
                        owners.append(fps[at])
                keys.append(key[sides == 1])
                owners.append(fps[sides == 1])
            else:
                keys.append(key)
                owners.append(fps)
    return np.concatenate(keys), np.concatenate(owners)


def _sweep(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints, breadth first."""
    rest, a, b = fps, [], []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= MAX_BITS
            if near.any():
                found = rest[near]
                a.append(np.full(len(found), x))
                b.append(found)
                queue.extend(found)
                rest = rest[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.uint64),) * 2


def links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links between fingerprints that share a key."""
    order = np.lexsort((fps, keys))
    keys, fps = keys[order], fps[order]
    new = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.empty(0, bool)
    starts = np.flatnonzero(new)
    sizes = np.diff(np.r_[starts, len(keys)])
    out_a, out_b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    group_size = np.repeat(sizes, sizes)
    small = np.flatnonzero((group_size > 1) & (group_size <= 16))
    k, f = keys[small], fps[small]
    for step in range(1, 16):
        if len(k) <= step:
            break
        hit = np.flatnonzero(k[step:] == k[:-step])
        if not len(hit):
            break
        x, y = f[hit], f[hit + step]
        near = np.bitwise_count(x ^ y) <= MAX_BITS
        out_a.append(x[near])
        out_b.append(y[near])
    for i in np.flatnonzero(sizes > 16):
        x, y = _sweep(fps[starts[i] : starts[i] + sizes[i]])
        out_a.append(x)
        out_b.append(y)
    return np.concatenate(out_a), np.concatenate(out_b)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` of every row, fp as a signed long."""
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def rooted(prints: DataFrame) -> DataFrame:
    """``(fp, first, root)`` of every distinct fingerprint of ``prints(doc_id, fp)``: its smallest doc_id and the smallest
    fingerprint of its component."""
    spark = prints.sparkSession
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    shifted = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << n) - 1).cast("long")) for a, n in SEGMENTS]
    counted = distinct.select(F.posexplode(F.array(*shifted)).alias("s", "v")).groupBy("s", "v").count()
    # at most 6 N / CELL rows, as each stands for over CELL / 2 fingerprints of its segment: 1 MB for some 10 million of them
    hot = {(r.s, r.v): r["count"] for r in counted.where(F.col("count") > CELL // 2).toLocalIterator()}
    known = spark.sparkContext.broadcast(hot)
    total = distinct.count()
    buckets = max(partitions(spark), 64 * total // 1_000_000) * 4

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(fps), 16_384):
                keys, owners = _variants(fps[i : i + 16_384], known.value)
                records = np.empty(len(keys), _RECORD)
                records["key"], records["fp"] = keys, owners
                yield packed(keys, records, buckets)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = unpacked(batches, _RECORD)
        a, b = links(records["key"], records["fp"])
        a, b = unioned(a.view(np.int64), b.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = distinct.select("fp").mapInArrow(spread, "bucket int, blob binary").repartition(buckets // 4, "bucket")
    # as a table of its own: a task of two Python steps takes two workers, and later tasks then take turns with twice as many
    near = written(dealt.mapInArrow(verify, "a long, b long"), "near-prints")
    roots = components(near)
    dropped(near)
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def groups(prints: DataFrame) -> DataFrame:
    """``(fp, component_id)`` of every distinct fingerprint of ``prints(doc_id, fp)``."""
    found = rooted(prints)
    smallest = found.groupBy("root").agg(F.min("first").alias("component_id"))
    return found.join(smallest, "root").select("fp", "component_id")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row."""
    prints = written(fingerprints(docs), "fingerprints")
    found = groups(prints).withColumnRenamed("fp", "g")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(found, F.col("fp") == F.col("g")).select("doc_id", hexed, "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the first in doc_id order (rows without doc_id come last), of several
    rows of that doc_id the one of the smallest hash over all columns. A row goes only if another of its own group stays:
    texts of one doc_id, or without any, that are of different groups all stay. Null and wordless texts are one group. An
    empty table returns no rows; columns stay as they are, whatever their names."""
    ship(docs.sparkSession)
    row, id_, kept, first = unused(docs, "row", "id", "kept", "first")
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]  # maps have no hash
    marked = docs.withColumn(row, F.xxhash64(*hashed)).withColumn(id_, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id")))
    rows = marked.select("doc_id", "text", F.col(row).alias("row"))
    prints = written(rows.mapInArrow(_fingerprints, "doc_id long, row long, fp long"), "fingerprints")
    found = rooted(prints.select("doc_id", "fp")).select(F.col("fp").alias("g"), "root")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    stays = prints.join(found, F.col("fp") == F.col("g")).groupBy("root").agg(F.min(order).alias("first"))
    stays = stays.select(F.struct("first.none", "first.doc_id").alias(kept), F.col("first.row").alias(first))
    # equal rows of one doc_id share their hash: the last step leaves one of them
    return marked.join(stays, (marked[id_] == stays[kept]) & (marked[row] == stays[first]), "left_semi").dropDuplicates([id_, row]).drop(id_, row)
