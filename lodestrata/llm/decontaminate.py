"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are the benchmark's windows of ``WINDOW`` = 10 consecutive words (an item of fewer words is one window). For
each pattern length m a shift table maps every block of three words (fewer for short patterns) to the distance from its
last place in any pattern to the pattern's end. The search looks at the block that ends at the current word: a block that
no pattern holds skips m - B + 1 words at once; a block that ends a pattern selects the bucket of its suffix, and direct
comparison of all the words confirms.

The patterns are broadcast in parts of at most ``PART_WINDOWS`` windows, whatever the size of the benchmark (a longer item
is cut into overlapping pieces); a worker builds a part's tables once. The documents are read once for each part and the
parts' hits are merged per row.

Cases: null and wordless texts have no words and no hits; an item without words matches nothing; items with equal windows
all count; an item without item_id is searched and hit, but isn't counted or listed; repeated rows of documents return a row
each, rows of one doc_id with different texts have their own hits, and repeated item_ids count once; an empty benchmark marks
nothing; an empty documents table returns no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import byte_column, held, pieces, ship

WINDOW, BLOCK = 10, 3
#: A window's tables take about 1 KB of a worker.
PART_WINDOWS = 200_000
#: a-z, 0-9 and every byte of a non-ASCII character make words; A-Z count as a-z.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Patterns:
    """Shift tables and suffix buckets of one part of the benchmark, by pattern length."""

    def __init__(self, items: list[tuple[int | None, bytes]]) -> None:
        owners: dict[int, dict[tuple[bytes, ...], set[int | None]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            words = words_of(text)
            m = min(len(words), WINDOW)
            for i in range(len(words) - m + 1) if m else ():
                owners[m][tuple(words[i : i + m])].add(item)
        self.tables = []
        for m, patterns in sorted(owners.items()):
            b = min(BLOCK, m)
            shift: dict[bytes, int] = {}
            buckets: dict[bytes, dict[tuple[bytes, ...], frozenset[int]]] = defaultdict(dict)
            for words, ids in patterns.items():
                for j in range(b, m + 1):
                    block = b" ".join(words[j - b : j])
                    shift[block] = min(shift.get(block, m), m - j)
                buckets[b" ".join(words[m - b :])][words] = frozenset(ids - {None})
            self.tables.append((m, b, shift, dict(buckets)))

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """The [start, end) of every occurrence, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        n = len(words)
        for m, b, shift, buckets in self.tables:
            i, skip, get = m, m - b + 1, shift.get
            while i <= n:
                block = b" ".join(words[i - b : i])
                step = get(block, skip)
                if step:
                    i += step
                    continue
                found = buckets[block].get(tuple(words[i - m : i]))
                if found is not None:
                    spans.append((i - m, i))
                    items |= found
                i += 1
        return spans, items


def _covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _parts(benchmark: DataFrame) -> Iterator[list[tuple[int | None, bytes]]]:
    """Items, or pieces of long ones, in parts of bounded size, one part at a time; at least one."""
    part: list[tuple[int | None, bytes]] = []
    size, some = 0, False
    for row in benchmark.select("item_id", F.encode("text", "UTF-8").alias("text")).where("text is not null").toLocalIterator():
        words = words_of(bytes(row.text))
        for start in range(0, max(1, len(words) - WINDOW + 1), PART_WINDOWS):
            piece = words[start : start + PART_WINDOWS + WINDOW - 1]
            if part and size + len(piece) > PART_WINDOWS:
                yield part
                part, size, some = [], 0, True
            part.append((row.item_id, b" ".join(piece)))
            size += len(piece)
    if part or not some:
        yield part


def _shared(docs: DataFrame, part: list[tuple[int | None, bytes]]):
    """The part's patterns, for workers: built once in each, and kept while its tasks need no other operator's tables."""
    ship(docs.sparkSession)
    name = f"patterns {uuid.uuid4().hex}"
    items = docs.sparkSession.sparkContext.broadcast(part)
    return name, lambda: held(name, lambda: Patterns(items.value))


def _searched(docs: DataFrame, part: list[tuple[int | None, bytes]]) -> DataFrame:
    name, tables = _shared(docs, part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", keep=name):
            patterns = tables()
            counts, flat, found = [], [], []
            for raw in byte_column(batch, "text"):
                words = words_of(raw)
                spans, ids = patterns.search(words)
                counts.append(len(words))
                flat.append([x for span in _covered(spans) for x in span])
                found.append(sorted(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(flat, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.int64())), batch.column(2)], names=["doc_id", "n_words", "spans", "items", "row"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("row")).mapInArrow(run, "doc_id long, n_words long, spans array<int>, items array<long>, row long")


def _merged(parts: list[DataFrame]) -> DataFrame:
    """Hits of several parts put together; rows of one doc_id are told apart by the hash of their text and spans are
    united per doc_id and text."""
    whole = parts[0].groupBy("doc_id", "n_words", "row").agg(F.count("*").alias("copies"))
    hits = parts[0].where("size(spans) > 0")
    for other in parts[1:]:
        hits = hits.union(other.where("size(spans) > 0"))
    # a group has a row per part with hits, and repeated rows of one document hold the same spans
    met = hits.distinct().groupBy("doc_id", "n_words", "row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    joined = whole.join(met, whole["doc_id"].eqNullSafe(met["doc_id"]) & (whole["row"] == met["row"]), "left").select(whole["doc_id"], whole["n_words"], F.coalesce("spans", F.array().cast("array<int>")).alias("spans"), F.coalesce("items", F.array().cast("array<long>")).alias("items"), "copies")
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc_id", "n_words", "spans", "items")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit, n_items, digests = [], [], []
        for spans, items in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            hit.append(sum(b - a for a, b in _covered(list(zip(spans[::2], spans[1::2])))))
            n_items.append(len(items))
            digests.append(hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest())
        hits = np.array(hit, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits), pa.array(n_items, pa.int64()), pa.array(digests, pa.string()), pa.array(hits > 0)], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    found = [_searched(docs, part) for part in _parts(benchmark)]
    whole = found[0] if len(found) == 1 else _merged(found)
    return whole.mapInArrow(_digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark window. Row by row, so nothing is shuffled: rows of one doc_id, or
    without any, are each judged by their own text; null and wordless texts stay; columns stay as they are, whatever their
    names; an empty benchmark drops nothing and an empty table returns no rows."""
    for part in _parts(benchmark):
        docs = _without(docs, part)
    return docs


def _without(docs: DataFrame, part: list[tuple[int | None, bytes]]) -> DataFrame:
    name, tables = _shared(docs, part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", keep=name):
            patterns = tables()
            kept = batch.filter(pa.array([not patterns.search(words_of(raw))[0] for raw in byte_column(batch, "text")], pa.bool_()))
            if kept.num_rows:
                yield kept

    return docs.mapInArrow(run, docs.schema)


_WORDS_SQL = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{80}-\\x{10FFFF}]+')"
#: The same rows by brute force, for DuckDB: all windows of either side, joined.
ORACLE_SQL = f"""
with d as (select doc_id, coalesce({_WORDS_SQL}, []) as w from documents),
b as (select item_id, {_WORDS_SQL} as w from benchmark where text is not null),
p as (select distinct item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') as g from (select item_id, w, least(len(w), {WINDOW}) as m, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) as i from b where len(w) > 0)),
x as (select doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') as g from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i from d, (select distinct m from p) where len(w) >= m)),
met as (select doc_id, item_id, m, i from x join p using (m, g)),
hit as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + m)) as j from met) group by all),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as listed from (select distinct doc_id, cast(item_id as varchar) as item from met where item_id is not null) group by all)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from d left join hit using (doc_id) left join items using (doc_id)
"""
