"""Exact substring dedup over sorted suffixes, with deep-shallow sorting.

Every byte covered by a ``LENGTH`` = 100-byte string that also starts earlier (smaller doc_id, or the same document and an
earlier start) is removed; strings are judged on the input.

Sorting every suffix of the corpus in one array doesn't spread over machines, so suffixes are dealt by content. Of the
``GRAM``-byte strings that start in a 100-byte window, those of the least hash are its anchors: equal windows have equal
anchors at equal offsets, so only suffixes at anchors (about one byte in forty) need to meet. An anchor's context is all
that any window around it can hold: ``LEFT`` bytes before it and 100 from it on.

1. A task sorts the suffixes at its own anchors: of anchors whose whole contexts are equal (neighbours in that order with
   equal bytes on the left) all but the first are covered, and the first alone goes on, so a passage held by a third of all
   documents sends one record per slice of a batch. What goes on is dealt by the hash of its gram, which only says who meets.
2. Where a gram has several anchors, each sends its context's bytes. Their suffixes are sorted: multikey quicksort down to the
   shallow depth of ``GRAM`` bytes, then blind tries for the groups that are still equal there. Common prefixes come from
   neighbours in that order, common left contexts by comparison; an earlier member with which L bytes on the left and R on
   the right agree, L + R >= 100, covers [p - L, p + R). In groups of over ``PAIRS`` members each window offset is settled
   on its own: members whose windows are equal form a run of the sorted suffixes, and all but its first are covered. A gram
   of over ``HOT`` anchors is dealt anew by ``CUTS``: a window that starts o bytes before its anchor holds the bytes of one of
   four stretches around it, so its equals meet under that stretch's hash, and no task gets all contexts of a common gram.
3. Intervals meet per document, are united, and cut the text.

Cases: a null text is the empty text; texts under 100 bytes lose nothing; matches never cross documents; rows that repeat a
doc_id are one document (none of them is earlier) and each returns a row; a null doc_id sorts first; an empty table
returns no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import byte_column, mix64, partitions, pieces, ship, written

LENGTH, GRAM = 100, 24
LEFT = LENGTH - GRAM
SPAN = LEFT + LENGTH
PAIRS = 48
#: Anchors that are sorted at once, and bytes of a text in which anchors are looked for at once.
SLICE, REACH = 100_000, 2 << 20
#: A gram with more anchors than HOT is dealt by these (bytes on the left, bytes on the right) of its contexts.
HOT = 50_000
CUTS = tuple((o, LENGTH - min(LEFT, o + LEFT // 4)) for o in range(0, LEFT, LEFT // 4))
NO_ID = -(2**63)
_MULTIPLY = mix64(np.arange(1, SPAN // 8 + 6, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_ANCHOR = [("key", "<u8"), ("doc", "<i8"), ("pos", "<u4")]
_PLACE = [("doc", "<i8"), ("at", "<u8")]
_CONTEXT = [("key", "<u8"), ("doc", "<i8"), ("pos", "<u4"), ("right", "u1"), ("bytes", f"V{SPAN}")]
_INTERVAL = [("doc", "<i8"), ("start", "<u4"), ("end", "<u4")]


def _blob(fields: list[np.ndarray]) -> bytes:
    raw = b"".join(np.ascontiguousarray(f).tobytes() for f in fields)
    return len(fields[0]).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(raw)


def _dealt(kind: int, keys: np.ndarray, fields: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Records by the bucket of their key: one compressed blob of whole columns for each."""
    bucket = (mix64(keys) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, fields = bucket[order], [f[order] for f in fields]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, int)
    ends = np.r_[starts[1:], len(bucket)].astype(int)[: len(starts)]
    blobs = [_blob([f[a:b] for f in fields]) for a, b in zip(starts, ends)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), kind, np.int32)), pa.array(bucket[starts], pa.int32()), pa.array(blobs, pa.binary())], names=["kind", "bucket", "blob"])


_PACKED = "kind int, bucket int, blob binary"


def _gathered(blobs: Iterable[bytes], kind: list) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[np.empty(0, np.dtype(t))] for _, t in kind]
    opener = zstandard.ZstdDecompressor()
    for blob in blobs:
        n, raw, at = int.from_bytes(blob[:4], "little"), opener.decompress(blob[4:]), 0
        for part, (_, t) in zip(parts, kind):
            part.append(np.frombuffer(raw, np.dtype(t), n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(p) for p in parts]


def gram_hashes(text: bytes, at: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at every start, or at the given ones."""
    words = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,))
    n = len(text) - GRAM + 1
    parts = [words[i : i + n] if at is None else words[at + i] for i in (0, 8, 16)]
    h = parts[0] * _MULTIPLY[0] + parts[1] * _MULTIPLY[1] + parts[2] * _MULTIPLY[2]
    h ^= h >> np.uint64(32)
    h *= _MULTIPLY[3]
    h ^= h >> np.uint64(29)
    return h


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and gram hashes of a text's anchors."""
    if len(text) < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    hashes = gram_hashes(text)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    width = LEFT + 1
    low = _sliding(short, width, np.minimum)
    pad = np.zeros(width - 1, np.uint32)
    at = np.flatnonzero(_sliding(np.concatenate([pad, low, pad]), width, np.maximum) == short)
    return at, hashes[at]


def anchor_slices(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``anchors`` of a text of any length, SLICE at a time; a stretch of REACH bytes is read with all that can decide on it."""
    around = LENGTH
    for start in range(0, max(1, len(text) - GRAM + 1), REACH):
        low = max(0, start - around)
        at, hashes = anchors(text[low : start + REACH + around]) if len(text) > REACH else anchors(text)
        own = np.flatnonzero((at + low >= start) & (at + low < start + REACH))
        for i in range(0, len(own), SLICE):
            yield at[own[i : i + SLICE]] + low, hashes[own[i : i + SLICE]]


def contexts(text: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchors, SPAN) bytes around each anchor (in ascending order), zero beyond the text, and how many of the right ones are
    text."""
    low = max(0, int(at[0]) - LEFT)
    padded = np.frombuffer(bytes(max(0, LEFT - int(at[0]))) + text[low : int(at[-1]) + LENGTH] + bytes(LENGTH), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, SPAN)[at - at[0]], np.minimum(LENGTH, len(text) - at).astype(np.uint8)


def cut_hashes(rows: np.ndarray, cut: tuple[int, int]) -> np.ndarray:
    """A hash of the bytes from ``cut[0]`` before to ``cut[1]`` after the anchors of contexts."""
    part = np.zeros((len(rows), SPAN), np.uint8)
    part[:, : sum(cut)] = rows[:, LEFT - cut[0] : LEFT + cut[1]]
    words = part.view("<u8")
    h = np.full(len(rows), cut[0], np.uint64)
    for i in range(-(-sum(cut) // 8)):
        h = mix64(h ^ (words[:, i] * _MULTIPLY[i]))
    return h


def _first_of(groups: tuple[np.ndarray, ...], doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by group, doc and position, and whether each (in that order) isn't the group's first. Rows at the
    first's own doc and position (repeated rows) count as first."""
    order = np.lexsort((pos, doc, *reversed(groups)))
    same = np.ones(max(0, len(order) - 1), bool)
    for g in groups:
        same &= g[order][1:] == g[order][:-1]
    starts = np.flatnonzero(np.r_[True, ~same]) if len(order) else np.empty(0, int)
    lead = np.repeat(order[starts], np.diff(np.r_[starts, len(order)]).astype(int)) if len(order) else order
    return order, (doc[order] != doc[lead]) | (pos[order] != pos[lead])


def _covered(pos: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = pos.astype(np.int64)
    return (p - np.minimum(p, LEFT)).astype(np.uint32), (p + right).astype(np.uint32)


def lcp(a: bytes, b: bytes) -> int:
    if a == b:
        return len(a)
    return len(a) - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() // 8 - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() % 8 > 0)


class BlindTrie:
    """Orders strings of one length by their branching bytes: a string goes down blindly, is compared with the one leaf it
    reaches, and branches off where they first differ."""

    def __init__(self, strings: list[bytes], members: list[int]) -> None:
        self.strings = strings
        self.root: list | None = None  # a leaf is [None, members]; a node is [depth, {byte: child}]
        for m in members:
            self._insert(m)

    def _insert(self, m: int) -> None:
        s = self.strings[m]
        if self.root is None:
            self.root = [None, [m]]
            return
        node = self.root
        while node[0] is not None:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = self.strings[node[1][0]]
        depth = lcp(s, other)
        if depth == len(s):
            node[1].append(m)
            return
        parent, node = None, self.root
        while node[0] is not None and node[0] < depth:
            parent, node = node, node[1][s[node[0]]]
        if node[0] == depth:
            node[1][s[depth]] = [None, [m]]
            return
        fork = [depth, {other[depth]: node, s[depth]: [None, [m]]}]
        if parent is None:
            self.root = fork
        else:
            parent[1][s[parent[0]]] = fork

    def ordered(self) -> tuple[list[int], list[int]]:
        """Members in order, and each one's common prefix with the one before (0 for the first)."""
        out: list[int] = []
        common: list[int] = []
        stack: list[tuple[list, int]] = [(self.root, 0)] if self.root else []
        while stack:
            node, before = stack.pop()
            if node[0] is None:
                for i, m in enumerate(node[1]):
                    out.append(m)
                    common.append(before if i == 0 else len(self.strings[m]))
                continue
            for i, byte in reversed(list(enumerate(sorted(node[1])))):
                stack.append((node[1][byte], before if i == 0 else node[0]))
        return out, common


def deep_shallow(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the (n, LENGTH) byte strings and each one's common prefix with its predecessor. Multikey quicksort over
    eight-byte characters to GRAM bytes; blind tries below. Prefixes under GRAM bytes are given as 0."""
    n = len(rows)
    words = np.ascontiguousarray(rows[:, :GRAM]).view(">u8").astype(np.uint64)
    order = np.arange(n)
    runs: list[tuple[int, int]] = []
    stack = [(0, n, 0)]
    while stack:
        a, b, d = stack.pop()
        if b - a <= 1 or d == GRAM // 8:
            if b > a:
                runs.append((a, b))
            continue
        part = order[a:b]
        key = words[part, d]
        if b - a <= 64:  # the base case
            by = np.lexsort(words[part, d:].T[::-1])
            order[a:b] = part[by]
            w = words[order[a:b]]
            cut = np.flatnonzero((w[1:] != w[:-1]).any(1)) + 1
            runs += [(a + int(x), a + int(y)) for x, y in zip(np.r_[0, cut], np.r_[cut, b - a])]
            continue
        pivot = np.partition(key[:: max(1, len(key) // 9)], len(key[:: max(1, len(key) // 9)]) // 2)[len(key[:: max(1, len(key) // 9)]) // 2]
        less, more = key < pivot, key > pivot
        equal = ~(less | more)
        order[a:b] = np.concatenate([part[less], part[equal], part[more]])
        x, y = a + int(less.sum()), b - int(more.sum())
        stack += [(a, x, d), (x, y, d + 1), (y, b, d)]
    common = np.zeros(n, np.int64)
    strings = [r.tobytes() for r in rows]
    for a, b in runs:
        if b - a == 1:
            continue
        if b - a == 2:
            i, j = order[a], order[a + 1]
            if strings[i] > strings[j]:
                order[a], order[a + 1] = j, i
            common[a + 1] = lcp(strings[i], strings[j])
            continue
        placed, prefix = BlindTrie(strings, order[a:b].tolist()).ordered()
        order[a:b] = placed
        common[a + 1 : b] = prefix[1:]
    starts = sorted(a for a, _ in runs)
    common[starts] = 0
    return order, common


def matches(doc: np.ndarray, pos: np.ndarray, right: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals (doc, start, end) that earlier members of the same gram's group cover."""
    order, common = deep_shallow(rows[:, LEFT:])
    doc, pos, right, rows = doc[order], pos[order].astype(np.int64), right[order].astype(np.int64), rows[order]
    left_len = np.minimum(pos, LEFT)
    n = len(doc)
    starts = np.flatnonzero(common == 0)
    sizes = np.diff(np.r_[starts, n])
    size = np.repeat(sizes, sizes)
    run = np.repeat(np.arange(len(starts)), sizes)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    small = np.flatnonzero((size > 1) & (size <= PAIRS))
    s_run, s_doc, s_pos, s_right, s_left = run[small], doc[small], pos[small], right[small], left_len[small]
    bytes_left, reach = rows[small, :LEFT][:, ::-1], np.full(len(small), LENGTH)
    for step in range(1, PAIRS):
        if len(small) <= step:
            break
        reach = np.minimum(reach[:-1], common[small][step:]) if step > 1 else common[small][1:].copy()
        hit = np.flatnonzero(s_run[step:] == s_run[:-step])
        if not len(hit):
            break
        i, j = hit, hit + step
        r = np.minimum(reach[hit], np.minimum(s_right[i], s_right[j]))
        may = np.flatnonzero(r + np.minimum(s_left[i], s_left[j]) >= LENGTH)
        i, j, r = i[may], j[may], r[may]
        for a in range(0, len(i), 50_000):
            x, y, z = i[a : a + 50_000], j[a : a + 50_000], r[a : a + 50_000]
            differ = bytes_left[x] != bytes_left[y]
            same = np.where(differ.any(1), differ.argmax(1), LEFT)
            same = np.minimum(same, np.minimum(s_left[x], s_left[y]))
            ok = np.flatnonzero(same + z >= LENGTH)
            x, y, same, z = x[ok], y[ok], same[ok], z[ok]
            later = np.where((s_doc[x] > s_doc[y]) | ((s_doc[x] == s_doc[y]) & (s_pos[x] > s_pos[y])), x, y)
            apart = (s_doc[x] != s_doc[y]) | (s_pos[x] != s_pos[y])
            out.append((s_doc[later][apart], (s_pos[later] - same)[apart], (s_pos[later] + z)[apart]))
    for k in np.flatnonzero(sizes > PAIRS):
        at = np.arange(starts[k], starts[k] + sizes[k])
        prefix = np.full(len(at), 1469598103934665603, np.uint64)
        back = rows[at, :LEFT][:, ::-1].astype(np.uint64)
        for o in range(LEFT + 1):  # windows that start o bytes before the anchor
            if o:
                prefix = mix64(prefix * np.uint64(1099511628211) ^ back[:, o - 1])
            has = np.flatnonzero((left_len[at] >= o) & (right[at] >= LENGTH - o))
            same_run = np.cumsum(common[at] < LENGTH - o)
            by, after = _first_of((same_run[has], prefix[has]), doc[at[has]], pos[at[has]])
            gone = at[has[by[after]]]
            out.append((doc[gone], pos[gone] - o, pos[gone] - o + LENGTH))
    none = np.empty(0, np.int64)
    return tuple(np.concatenate([none, *(x[i] for x in out)]) for i in range(3))


def repeated(key: np.ndarray, doc: np.ndarray, pos: np.ndarray, right: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether each anchor's whole context equals that of an earlier one of the same gram: found where the sorted suffixes stand
    next to each other."""
    out = np.zeros(len(key), bool)
    by = np.argsort(key, kind="stable")
    same = key[by][1:] == key[by][:-1]
    some = by[np.r_[False, same] | np.r_[same, False]]  # a gram that stands alone has no equal
    if not len(some):
        return out
    order, common = deep_shallow(rows[some, LEFT:])
    at = some[order]
    run = np.cumsum(common < LENGTH)
    left = np.zeros((len(at), -(-LEFT // 8) * 8), np.uint8)
    left[:, :LEFT] = rows[at, :LEFT]
    words = left.view("<u8")
    groups = (run, *(words[:, i] for i in range(words.shape[1])), np.minimum(pos[at], LEFT), right[at])
    place, after = _first_of(groups, doc[at], pos[at])
    out[at[place[after]]] = True
    return out


def united(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Sorted, touching intervals joined."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order].astype(np.int64), np.maximum.accumulate(end[order].astype(np.int64)) if len(end) else end
    new = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]]) if len(start) else np.empty(0, int)
    return [(int(start[i]), int(reach[j])) for i, j in zip(new, np.r_[new[1:] - 1, len(start) - 1] if len(new) else new)]


def removed_spans(docs: DataFrame) -> DataFrame:
    """``(doc_id, starts, ends)``: the maximal removed byte runs of each document that loses any (null doc_id as the
    smallest long)."""
    spark = docs.sparkSession
    ship(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(partitions(spark), size // (24 << 20))
    buckets = parts * 4
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")

    def settled(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, doc, pos, right, rows = (np.concatenate(x) for x in zip(*held))
        gone = repeated(key, doc, pos, right, rows)
        sent = np.flatnonzero(~gone)
        yield _dealt(0, key[sent], [x[sent] for x in (key, doc, pos)], buckets)
        start, end = _covered(pos[gone], right[gone])
        yield _dealt(1, doc[gone].view(np.uint64), [doc[gone], start, end], buckets)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 8 << 20):
            held: list[list[np.ndarray]] = []
            n = 0
            for doc, text in zip(batch.column(0).to_pylist(), byte_column(batch, "text")):
                for at, keys in anchor_slices(text):
                    around, right = contexts(text, at)
                    held.append([keys, np.full(len(at), doc, np.int64), at.astype(np.uint32), right, around])
                    n += len(at)
                    if n >= SLICE:
                        yield from settled(held)
                        held, n = [], 0
            if held:
                yield from settled(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            local = batch.filter(pc.equal(batch.column(0), 1))
            if local.num_rows:
                yield local  # what a task has settled goes on as it is
            found += batch.filter(pc.equal(batch.column(0), 0)).column(2).to_pylist()
        key, doc, pos = _gathered(found, _ANCHOR)
        order = np.argsort(key, kind="stable")
        k = key[order]
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, int)
        sizes = np.diff(np.r_[starts, len(k)]).astype(int)
        size = np.repeat(sizes, sizes)
        need = order[size > 1]
        hot = (size[size > 1] > HOT).astype(np.uint64)
        yield _dealt(2, doc[need].view(np.uint64), [doc[need], pos[need].astype(np.uint64) << np.uint64(1) | hot], buckets)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, at = _gathered((x for b in batches for x in b.column(2).to_pylist()), _PLACE)
        order = np.lexsort((at, doc))
        doc, at = doc[order], at[order]
        starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.empty(0, int)
        for a in range(0, len(starts), 5000):
            s = starts[a : a + 5000]
            e = np.r_[starts[a + 1 : a + 5001], len(doc)][: len(s)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[s]), pa.array([at[x:y].tobytes() for x, y in zip(s, e)], pa.binary())], names=["d", "at"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> pa.RecordBatch:
            key, hot, doc, pos, right, rows = (np.concatenate(x) for x in zip(*held))
            cold, warm = np.flatnonzero(~hot), np.flatnonzero(hot)
            keys = np.concatenate([key[cold], *(mix64(key[warm] ^ cut_hashes(rows[warm], cut)) for cut in CUTS)])
            at = np.concatenate([cold, *[warm] * len(CUTS)])
            return _dealt(0, keys, [keys, doc[at], pos[at], right[at], np.ascontiguousarray(rows[at]).view(f"V{SPAN}").ravel()], buckets)

        for batch in pieces(batches, "text", 4 << 20):
            held, n = [], 0
            for doc, text, raw in zip(batch.column(0).to_pylist(), byte_column(batch, "text"), batch.column(2).to_pylist()):
                places_ = np.frombuffer(raw, "<u8")
                at, hot = (places_ >> np.uint64(1)).astype(np.int64), (places_ & np.uint64(1)).astype(bool)
                inside = (at + GRAM <= len(text)) & np.r_[True, places_[1:] != places_[:-1]]  # a place of another row of this doc_id may lie beyond
                at, hot = at[inside], hot[inside]
                if len(text) < LENGTH:
                    continue
                for i in range(0, len(at), SLICE):
                    part = at[i : i + SLICE]
                    around, right = contexts(text, part)
                    held.append([gram_hashes(text, part), hot[i : i + SLICE], np.full(len(part), doc, np.int64), part.astype(np.uint32), right, around])
                    n += len(part)
                    if n >= SLICE:
                        yield sent()
                        held, n = [], 0
            if held:
                yield sent()

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, doc, pos, right, raw = _gathered((x for b in batches for x in b.column(2).to_pylist()), _CONTEXT)
        order = np.argsort(key, kind="stable")
        cuts = [0]
        while cuts[-1] < len(order):  # whole groups, about 100,000 contexts at once
            end = min(len(order), cuts[-1] + 100_000)
            cuts.append(int(np.searchsorted(key[order], key[order[end - 1]], "right")))
        for a, b in zip(cuts, cuts[1:]):
            at = order[a:b]
            d, s, e = matches(doc[at], pos[at], right[at], np.frombuffer(raw[at].tobytes(), np.uint8).reshape(-1, SPAN))
            yield _dealt(1, d.view(np.uint64), [d, s.astype(np.uint32), e.astype(np.uint32)], buckets)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, start, end = _gathered((x for b in batches for x in b.column(2).to_pylist()), _INTERVAL)
        order = np.lexsort((start, doc))
        doc, start, end = doc[order], start[order], end[order]
        bounds = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.empty(0, int)
        for a in range(0, len(bounds), 5000):
            s = bounds[a : a + 5000]
            e = np.r_[bounds[a + 1 : a + 5001], len(doc)][: len(s)]
            spans = [united(start[x:y], end[x:y]) for x, y in zip(s, e)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[s]), pa.array([[x for x, _ in p] for p in spans], pa.list_(pa.int32())), pa.array([[y for _, y in p] for p in spans], pa.list_(pa.int32()))], names=["doc_id", "starts", "ends"])

    first = written(rows.mapInArrow(sign, _PACKED).repartition(parts, "bucket").mapInArrow(meet, _PACKED), "settled")
    wanted = first.where("kind = 2").repartition(parts, "bucket").mapInArrow(places, "d long, at binary")
    held = rows.join(wanted, F.col("doc_id") == F.col("d")).select("doc_id", "text", "at").mapInArrow(fetch, _PACKED)
    resolved = written(held.repartition(parts, "bucket").mapInArrow(resolve, _PACKED), "resolved")
    return first.where("kind = 1").union(resolved).repartition(parts, "bucket").mapInArrow(unite, "doc_id long, starts array<int>, ends array<int>")


def deduplicated(docs: DataFrame, *, with_text: bool = False) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, the ``kept`` bytes."""
    spans = written(removed_spans(docs), "spans").withColumnRenamed("doc_id", "d")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 4 << 20):
            sizes, gone, counts, digests, kept = [], [], [], [], []
            for text, starts, ends in zip(byte_column(batch, "text"), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                runs = [(a, min(b, len(text))) for a, b in zip(starts or (), ends or ()) if a < len(text)]
                left, at = [], 0
                for a, b in runs:
                    left.append(text[at:a])
                    at = b
                rest = b"".join([*left, text[at:]])
                sizes.append(len(text))
                gone.append(len(text) - len(rest))
                counts.append(len(runs))
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if with_text else b"")
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string())] + ([pa.array(kept, pa.binary())] if with_text else [])
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(columns)])

    joined = docs.select("doc_id", "text").join(spans, F.coalesce("doc_id", F.lit(NO_ID)) == F.col("d"), "left").select("doc_id", "text", "starts", "ends")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


#: The same rows by brute force, for DuckDB: all strings of LENGTH bytes, as hexadecimal digits.
ORACLE_SQL = f"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
w as (select doc_id, s, md5(substr(h, 2 * s + 1, {2 * LENGTH})) as g from (select doc_id, h, unnest(range(0, n - {LENGTH - 1})) as s from d where n >= {LENGTH})),
f as (select doc_id, s, row_number() over (partition by g order by doc_id, s) as r from w),
c as (select doc_id, s, case when s > lag(s) over (partition by doc_id order by s) + {LENGTH} then 1 else 0 end as opens from f where r > 1),
i as (select doc_id, s, sum(opens) over (partition by doc_id order by s) as k from c),
spans as (select doc_id, k, min(s) as a, max(s) + {LENGTH} as b from i group by all),
edges as (select doc_id, a, b, lag(b, 1, 0) over (partition by doc_id order by a) as before from spans),
cut as (select doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) as kept, sum(b - a) as gone, count(*) as runs from edges join d using (doc_id) group by doc_id)
select doc_id, n as n_bytes, cast(coalesce(gone, 0) as bigint) as n_removed, coalesce(runs, 0) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256 from d left join cut using (doc_id)
"""
