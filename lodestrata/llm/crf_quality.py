"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is labelled good or bad. Its evidence is ``FEATURES`` of the line itself and of the lines before and after it;
a 2 x 2 table scores neighbouring labels. Forward-backward gives each line's probability to be good, and the mean of
those, weighted by line length, is the document's raw quality. A logistic curve over it, fitted on the same training
rows, gives the score. Lines are worked on in blocks, so a text of millions of lines takes some 100 bytes a line.

Training rows are labelled documents only, at most ``TRAIN_DOCS``, the first in the order of a hash of doc_id, of at most
``TRAIN_LINES`` lines each. Lines inherit the label of their document.

Cases: a null text is the empty text, which is one line without length; repeated rows return a row each; a document with
several labels counts as good if any is; rows of labels without a label or a document are ignored; without usable labels
of both kinds the prior stands in (every line 0.5); an empty documents table returns no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import byte_column, pieces, ship

TRAIN_DOCS, TRAIN_LINES, THRESHOLD = 4000, 400, 0.3
#: Lines whose features are held at once, and how many make a text a long one.
LINES, LONG_TEXT = 50_000, 1024
#: Byte classes: 0 lower case, 1 upper case, 2 digits, 3 white space, 4 sentence marks, 5 bars, 6 exclamation marks,
#: 7 symbols, 8 other ASCII, 9 first bytes and 10 following bytes of other characters.
_CLASSES = 11


def _byte_classes() -> np.ndarray:
    kind = np.full(256, 8, np.uint8)
    kind[list(b"abcdefghijklmnopqrstuvwxyz")] = 0
    kind[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
    kind[list(b"0123456789")] = 2
    kind[list(b" \t\r\x0b\x0c\n")] = 3
    kind[list(b".,;:?'\"-()")] = 4
    kind[ord("|")] = 5
    kind[ord("!")] = 6
    kind[list(b"#$%&*@^~<>{}[]=_+/\\")] = 7
    kind[128:192] = 10
    kind[192:] = 9
    return kind


_KIND = _byte_classes()
FEATURES = (
    "one", "log_length", "lower", "upper", "digits", "spaces", "marks", "bars", "shouts", "symbols", "wide",
    "log_words", "mean_word", "distinct", "repeats", "common_word", "empty", "any_bar", "any_shout", "any_symbol",
)
_OWN = len(FEATURES)


def own_features(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the lines themselves, and their byte lengths."""
    n = len(lines)
    length = np.fromiter(map(len, lines), np.int64, n)
    counts = np.zeros((n, _CLASSES))
    ends = np.cumsum(length)
    start = 0
    while start < n:  # pieces of a few MB, to keep the index small
        end = min(n, max(start + 1, int(np.searchsorted(ends, ends[start] - length[start] + (2 << 20)))))
        raw = np.frombuffer(b"".join(lines[start:end]), np.uint8)
        owner = np.repeat(np.arange(end - start) * _CLASSES, length[start:end])
        counts[start:end] = np.bincount(owner + _KIND[raw], minlength=(end - start) * _CLASSES).reshape(-1, _CLASSES)
        start = end
    words, distinct, repeats, top = (np.zeros(n) for _ in range(4))
    for i, line in enumerate(lines):
        w = line.split()
        words[i] = len(w)
        if w:
            seen = set(w)
            distinct[i] = len(seen)
            repeats[i] = sum(map(eq, w, islice(w, 1, None)))
            top[i] = w.count(w[len(w) // 2])
    size, many = np.maximum(length, 1), np.maximum(words, 1)
    share = counts / size[:, None]
    own = np.column_stack([
        np.ones(n), np.log1p(length) / 5, share[:, 0], share[:, 1], share[:, 2], share[:, 3], share[:, 4],
        np.minimum(1, share[:, 5] * 10), np.minimum(1, share[:, 6] * 10), np.minimum(1, share[:, 7] * 10), share[:, 9] + share[:, 10],
        np.log1p(words) / 4, np.minimum(3, length / many / 8), distinct / many, repeats / many, np.where(words > 3, top / many, 0),
        length == 0, counts[:, 5] > 0, counts[:, 6] > 0, counts[:, 7] > 1,
    ])
    return own, length


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of the texts: features (own, before, after), byte lengths, and how many lines each text has."""
    per_text = np.array([text.count(b"\n") + 1 for text in texts], dtype=np.int64)
    own, length = own_features([line for text in texts for line in text.split(b"\n")])
    ends = np.cumsum(per_text)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[ends - per_text] = 0
    after[ends - 1] = 0
    return np.hstack([own, before[:, 1:], after[:, 1:]]), length, per_text


def _lines(text: bytes) -> Iterator[bytes]:
    """A text's lines, one at a time."""
    at = 0
    while (end := text.find(b"\n", at)) >= 0:
        yield text[at:end]
        at = end + 1
    yield text[at:]


def line_scores(texts: list[bytes], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of the texts: the score for good, byte lengths, and how many lines each text has. Features are made for
    ``LINES`` lines at a time, and what a line's neighbours add is shifted into place, so memory is a few numbers a line."""
    per_text = np.array([text.count(b"\n") + 1 for text in texts], dtype=np.int64)
    parts = [weights[:_OWN], np.r_[0, weights[_OWN : 2 * _OWN - 1]], np.r_[0, weights[2 * _OWN - 1 :]]]
    total = int(per_text.sum())
    mine, before, after, length = np.empty(total), np.empty(total), np.empty(total), np.empty(total, np.int64)
    every, at = chain.from_iterable(map(_lines, texts)), 0
    while lines := list(islice(every, LINES)):
        own, length[at : at + len(lines)] = own_features(lines)
        for out, part in zip((mine, before, after), parts):
            out[at : at + len(lines)] = own @ part
        at += len(lines)
    ends = np.cumsum(per_text)
    inner = np.ones(total, bool)
    inner[ends - per_text] = False
    mine[1:] += np.where(inner[1:], before[:-1], 0)
    mine[:-1] += np.where(inner[1:], after[1:], 0)
    return mine, length, per_text


def _padded(per_text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts of like line counts together: their line indexes, -1 where a text has ended."""
    starts = np.cumsum(per_text) - per_text
    order = np.argsort(per_text, kind="stable")
    at = 0
    while at < len(order):
        end, most = at, per_text[order[at]]
        while end < len(order) and per_text[order[end]] <= max(8, 2 * most) and (end - at) * int(per_text[order[end]]) < 500_000:
            end += 1
        end = max(end, at + 1)
        group = order[at:end]
        steps = np.arange(int(per_text[group].max()))
        grid = starts[group, None] + steps[None, :]
        yield group, np.where(steps[None, :] < per_text[group, None], grid, -1)
        at = end


def forward_backward(node: np.ndarray, trans: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of every line, the expected transitions, and the log partition sum. ``node``: the lines' score for good
    (bad scores 0); ``trans[a, b]``: of label a before label b."""
    good = np.empty(len(node))
    pairs, total = np.zeros((2, 2)), 0.0
    kernel = np.exp(trans)
    for _, grid in _padded(per_text):
        there = grid >= 0
        score = np.where(there, node[grid], 0.0)
        # scaled potentials: the larger of the two labels is 1
        emit = np.stack([np.exp(-np.maximum(score, 0)), np.exp(np.minimum(score, 0))], -1)
        logs = np.maximum(score, 0).sum()
        rows, steps = grid.shape
        alpha = np.empty((rows, steps, 2))
        now = emit[:, 0]
        for t in range(steps):
            if t:
                now = np.where(there[:, t, None], (alpha[:, t - 1] @ kernel) * emit[:, t], alpha[:, t - 1])
            scale = now.sum(1, keepdims=True)
            logs += np.log(scale).sum()
            alpha[:, t] = now / scale
        beta = np.ones((rows, 2))
        for t in range(steps - 1, -1, -1):
            both = alpha[:, t] * beta
            p = both / both.sum(1, keepdims=True)
            good[grid[there[:, t], t]] = p[there[:, t], 1]
            if t:
                right = beta * emit[:, t]
                joint = alpha[:, t - 1, :, None] * kernel[None] * right[:, None, :]
                joint /= joint.sum((1, 2), keepdims=True)
                pairs += joint[there[:, t]].sum(0)
                back = right @ kernel.T
                beta = np.where(there[:, t, None], back / back.sum(1, keepdims=True), beta)
        total += logs
    return good, pairs, total


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices, scaled to a sum of one."""
    out = a @ b
    return out / out.sum((-2, -1), keepdims=True)


def long_marginals(node: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(good) of every line of one long text: the lines are cut into about as many blocks as a block has lines; blocks' products
    of transfer matrices give each block's borders, and all blocks then go forward and backward side by side."""
    n = len(node)
    steps = int(np.ceil(np.sqrt(n)))
    blocks = -(-n // steps)
    emit = np.ones((blocks * steps, 2))
    emit[:n] = np.stack([np.exp(-np.maximum(node, 0)), np.exp(np.minimum(node, 0))], -1)
    kernel = np.exp(trans)
    # the matrix of a line leads from the line before it; the first line's has nothing before it, and padding leads nowhere
    move = kernel[None] * emit[:, None, :]
    move[0] = np.array([[emit[0, 0], 0], [0, emit[0, 1]]])
    move[n:] = np.eye(2)
    move = move.reshape(blocks, steps, 2, 2)
    whole = np.broadcast_to(np.eye(2), (blocks, 2, 2))
    for t in range(steps):
        whole = _times(whole, move[:, t])
    first, last = np.empty((blocks, 2)), np.empty((blocks, 2))
    now = np.full(2, 0.5)
    for k in range(blocks):
        first[k] = now
        now = now @ whole[k]
        now = now / now.sum()
    now = np.full(2, 0.5)
    for k in range(blocks - 1, -1, -1):
        last[k] = now
        now = whole[k] @ now
        now = now / now.sum()
    alpha = np.empty((blocks, steps, 2))
    now = first
    for t in range(steps):
        now = np.einsum("bi,bij->bj", now, move[:, t])
        now = now / now.sum(1, keepdims=True)
        alpha[:, t] = now
    out, beta = np.empty((blocks, steps)), last
    for t in range(steps - 1, -1, -1):
        both = alpha[:, t] * beta
        out[:, t] = both[:, 1] / both.sum(1)
        beta = np.einsum("bij,bj->bi", move[:, t], beta)
        beta = beta / beta.sum(1, keepdims=True)
    return out.ravel()[:n]


def marginals(node: np.ndarray, trans: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """P(good) of every line; texts of many lines are worked on in blocks."""
    out = np.empty(len(node))
    long = per_text > LONG_TEXT
    owner = np.repeat(long, per_text)
    if not long.all():
        out[~owner] = forward_backward(node[~owner], trans, per_text[~long])[0]
    ends = np.cumsum(per_text)
    for k in np.flatnonzero(long):
        out[ends[k] - per_text[k] : ends[k]] = long_marginals(node[ends[k] - per_text[k] : ends[k]], trans)
    return out


def fit(x: np.ndarray, labels: np.ndarray, per_text: np.ndarray, rounds: int = 80, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features and transitions that maximise the labels' conditional likelihood (Adam, full batch)."""
    weights, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    inside = np.ones(len(labels), bool)
    inside[np.cumsum(per_text)[:-1]] = False
    inside[0] = False
    at = np.flatnonzero(inside)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[at - 1].astype(int), labels[at].astype(int)), 1)
    m1 = v1 = np.zeros(x.shape[1])
    m2 = v2 = np.zeros((2, 2))
    n = len(labels)
    for step in range(1, rounds + 1):
        good, pairs, _ = forward_backward(x @ weights, trans, per_text)
        g1 = x.T @ (labels - good) / n - l2 * weights
        g2 = (seen - pairs) / n - l2 * trans
        m1, v1 = 0.9 * m1 + 0.1 * g1, 0.99 * v1 + 0.01 * g1**2
        m2, v2 = 0.9 * m2 + 0.1 * g2, 0.99 * v2 + 0.01 * g2**2
        a, b = 1 - 0.9**step, 1 - 0.99**step
        weights = weights + 0.15 * (m1 / a) / (np.sqrt(v1 / b) + 1e-8)
        trans = trans + 0.05 * (m2 / a) / (np.sqrt(v2 / b) + 1e-8)
    return weights, trans


def evidence(node: np.ndarray, length: np.ndarray, per_text: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Per text the logit of the mean marginal, weighted by length (+1, so that empty lines count a little), and one."""
    good = marginals(node, trans, per_text)
    starts = np.cumsum(per_text) - per_text
    weight = length + 1.0
    mean = np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)
    return np.column_stack([_logit(mean), np.ones(len(mean))])


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


class Model:
    """Weights, transitions and the logistic curve over a document's evidence."""

    def __init__(self) -> None:
        self.weights, self.trans, self.curve = np.zeros(3 * _OWN - 2), np.zeros((2, 2)), np.array([1.0, 0.0])

    def train(self, x: np.ndarray, length: np.ndarray, per_text: np.ndarray, quality: np.ndarray) -> Model:
        if len(np.unique(quality)) < 2:
            return self
        labels = np.repeat(quality.astype(float), per_text)
        self.weights, self.trans = fit(x, labels, per_text)
        z = evidence(x @ self.weights, length, per_text, self.trans)
        w = self.curve
        for _ in range(50):  # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), z.T @ (quality - p) - 1e-2 * w)
        self.curve = w
        return self

    def score(self, texts: list[bytes]) -> np.ndarray:
        z = evidence(*line_scores(texts, self.weights), self.trans)
        return 1 / (1 + np.exp(-np.clip(z @ self.curve, -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = byte_column(batch, "text")
        x, length, per_text = line_features(texts)
        ends = np.cumsum(per_text)
        blobs = [x[b - n : b].astype("<f4").tobytes() for n, b in zip(per_text, ends)]
        sizes = [length[b - n : b].astype("<i8").tobytes() for n, b in zip(per_text, ends)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary()), pa.array(sizes, pa.binary())], names=["doc_id", "quality", "x", "length"])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits the model on the bounded sample of labelled rows that aren't held out."""
    ship(docs.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    short = docs.select("doc_id", F.col("text")).where(F.col("text").isNotNull())
    rows = short.join(F.broadcast(chosen), "doc_id").where(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) < TRAIN_LINES)
    found = rows.select("doc_id", "quality", "text").mapInArrow(_featured, "doc_id long, quality int, x binary, length binary").collect()
    model = Model()
    if not found:
        return model
    found.sort(key=lambda r: (r.doc_id, bytes(r.x)))
    width = 3 * _OWN - 2
    x = np.concatenate([np.frombuffer(r.x, "<f4").reshape(-1, width) for r in found]).astype(float)
    length = np.concatenate([np.frombuffer(r.length, "<i8") for r in found])
    per_text = np.array([len(r.length) // 8 for r in found])
    return model.train(x, length, per_text, np.array([r.quality for r in found], dtype=float))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 4 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(byte_column(batch, "text")))], names=["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that the model rejects; row by row, so nothing is shuffled. Repeated rows and ids are each judged
    by their own text; a null text is judged as the empty one; columns stay as they are, whatever their names; an empty table
    returns no rows."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 4 << 20):
            kept = batch.filter(pa.array(shared.value.score(byte_column(batch, "text")) >= THRESHOLD))
            if kept.num_rows:
                yield kept

    return docs.mapInArrow(run, docs.schema)
