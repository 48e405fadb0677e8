"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's symbols stand in a doubly linked list. Each adjacent pair that is itself a token waits in the bucket of its
merge rank, by position. Two levels of 256-bit words say which buckets are filled; find-first-set on each level gives the
lowest rank in constant time, and a bucket gives its leftmost position first. Entries whose symbols have changed since
are stale and are skipped when met. A pre-token of n bytes takes O(n log n) at worst, so a text that is one long run of
letters is no special case. Pre-tokens recur, so results of short ones are kept in a bounded table per worker.

Cases: a null text is the empty text; an empty text has no tokens and the digests of the empty string; special-token
strings are ordinary text; repeated rows return a row each; an empty table returns no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lodestrata.llm.common import byte_column, held, pieces, ship

#: Pre-tokens longer than this are encoded afresh; the table holds at most CACHE_ROWS shorter ones (about 130 MB).
CACHE_BYTES, CACHE_ROWS = 64, 600_000


_BIT = tuple(1 << i for i in range(256))


class RankQueue:
    """Bitmap of filled buckets in two levels of 256-bit words (a vocabulary of up to 65,536 ranks; larger ones widen the
    top word). An emptied queue can be used again, so the words are allocated once per vocabulary."""

    def __init__(self, ranks: int) -> None:
        self.leaf = [0] * ((ranks >> 8) + 1)
        self.top_bit = tuple(1 << i for i in range(len(self.leaf)))


class _Pieces(dict):
    """Ids of pre-tokens; a missing one is encoded, and kept if it is short. Half the rows are the latest; when that half is
    full it becomes the older one, from which what is met again comes back."""

    def __init__(self, codec: Codec) -> None:
        self.codec = codec
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            raw = piece.encode("utf-8")
            ids = self.codec.merge(raw)
            if len(raw) > CACHE_BYTES:
                return ids
        if len(self) >= CACHE_ROWS // 2:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder of one vocabulary: token bytes to rank, and the pattern that cuts pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.size = max(ranks.values(), default=0) + 1
        self.tokens: list[bytes | None] = [None] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.pairs = [ranks.get(bytes((a, b))) for a in range(256) for b in range(256)]
        self.queue, self.pieces = RankQueue(self.size), _Pieces(self)

    @staticmethod
    def _join(buckets: dict[int, int | list[int]], rank: int, position: int) -> None:
        held = buckets[rank]
        if type(held) is int:
            buckets[rank] = [held, position] if held < position else [position, held]
        else:
            heappush(held, position)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token: merges by lowest rank, leftmost first."""
        get = self.ranks.get
        whole = get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        ends = list(range(1, n + 1))  # a symbol's end
        before = list(range(-1, n))
        leaf, bit, top_bit, top = self.queue.leaf, _BIT, self.queue.top_bit, 0
        buckets: dict[int, int | list[int]] = {}  # one position, or several as a heap
        pairs = self.pairs
        at_rank = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:])]  # the rank of the pair that starts here
        at_rank.append(None)
        for i, rank in enumerate(at_rank):
            if rank is not None:
                if rank in buckets:
                    held = buckets[rank]
                    if type(held) is int:
                        buckets[rank] = [held, i]
                    else:
                        held.append(i)
                else:
                    buckets[rank] = i
                    leaf[rank >> 8] |= bit[rank & 255]
                    top |= top_bit[rank >> 8]
        while top:
            # find-first-set on either level: the lowest rank, then its leftmost position
            high = (top & -top).bit_length() - 1
            word = leaf[high]
            low = word & -word
            rank = high << 8 | low.bit_length() - 1
            i = buckets[rank]
            if type(i) is int:
                del buckets[rank]
                leaf[high] = word = word ^ low
                if not word:
                    top &= top - 1
            else:
                held = i
                i = heappop(held)
                if len(held) == 1:
                    buckets[rank] = held[0]
            if at_rank[i] != rank:
                continue  # stale: a symbol has been merged away or has grown
            at = ends[i]
            ends[i] = end = ends[at]
            at_rank[at] = None
            left = before[i]
            if end < n:
                before[end] = i
                at_rank[i] = rank = get(piece[i : ends[end]])
                if rank is not None:
                    if rank in buckets:
                        self._join(buckets, rank, i)
                    else:
                        buckets[rank] = i
                        leaf[rank >> 8] |= bit[rank & 255]
                        top |= top_bit[rank >> 8]
            else:
                at_rank[i] = None
            if left >= 0:
                at_rank[left] = rank = get(piece[left:end])
                if rank is not None:
                    if rank in buckets:
                        self._join(buckets, rank, left)
                    else:
                        buckets[rank] = left
                        leaf[rank >> 8] |= bit[rank & 255]
                        top |= top_bit[rank >> 8]
        out, i = [], 0
        while i < n:
            at = ends[i]
            out.append(get(piece[i:at]))
            i = at
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.find(text))))

    def decode(self, ids: list[int]) -> bytes:
        if ids and min(ids) < 0:
            raise ValueError(f"unknown token id {min(ids)}")
        return b"".join(map(self.tokens.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line. Read on the driver; vocabularies have a fixed size."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _codec(shared: dict) -> Codec:
    """The worker's codec of this broadcast vocabulary, kept while its tasks need no other operator's tables."""
    return held(shared["id"], lambda: Codec(shared["ranks"], shared["pattern"]))


def encoded(docs: DataFrame, path: str, pattern: str, *, with_ids: bool = False) -> DataFrame:
    """Per row: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids``."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast({"id": f"{path}\n{pattern}", "ranks": read_ranks(path), "pattern": pattern})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        names = [str(i) for i in range(codec.size)]
        for batch in pieces(batches, "text", 4 << 20, shared.value["id"]):
            counts, digests, backs, kept = [], [], [], []
            for raw in byte_column(batch, "text"):
                ids = codec.encode(raw.decode("utf-8"))
                counts.append(len(ids))
                digests.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                backs.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(ids)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(backs, pa.string())]
            columns += [pa.array(kept, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """``(doc_id, bytes)`` of ``tokens(doc_id, ids)``; null ids give no bytes, an unknown id is an error."""
    spark = tokens.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast({"id": path, "ranks": read_ranks(path), "pattern": ""})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            out = [codec.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")
