"""Exact top-k inner products over norm-sorted blocks with SVD-rotated partial sums.

Components become integers, floor(64 x), and scores are exact integers. Vectors are dealt by descending length (ties by
vec_id) into blocks of about ``BLOCK``; queries, the vectors with vec_id divisible by ``EVERY``, into blocks of their own.
The longest vectors' block comes first and gives every query a lower bound on its k-th score. Blocks stand by descending
length, so those in which any vector times the longest query could reach the lowest bound of a query block are the first
ones: only these are sent to meet it. There, a vector whose length times the query's can't reach the bound is skipped, and so
are all shorter ones; for the rest the first ``HEAD`` coordinates, in the basis of the corpus's singular vectors, give a partial sum, and
Cauchy-Schwarz on the remaining coordinates bounds what they can add. Pairs that may still reach the bound are scored in
integers. Ties at the bound are kept, so equal scores are settled by vec_id.

The rotation comes from the d x d Gram matrix, summed over all rows. A pair of blocks is a task's unit of work and of
memory; what is replicated is each block, once for every block of the other side that it may serve.

Cases: vectors that are null or hold a null or non-finite component take no part, nor do rows without vec_id; shorter
vectors count as padded with zeros; rows of one vec_id count once (the smallest vector in byte order); fewer than k others
give all; sums beyond 64 bits are held at its limits; empty tables return no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import ship, written

K, EVERY, SCALE = 20, 20, 64
BLOCK, QUERIES, HEAD = 4096, 4096, 16
#: Queries that are scored at once, and block borders at most that say where a query block's candidates end.
AT_ONCE, BORDERS = 512, 4096


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    limit = float(2**62)
    for batch in batches:
        batch = batch.filter(pc.and_(pc.is_valid(batch.column(0)), pc.is_valid(batch.column(1))))
        if not batch.num_rows:
            continue
        sizes = pc.list_value_length(batch.column(1)).to_numpy()
        flat = batch.column(1).flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(float)  # nulls become NaN
        bad = np.zeros(len(sizes) + 1, np.int64)
        ends = np.cumsum(sizes)
        bad[1:] = np.cumsum(~np.isfinite(x))[ends - 1] * (ends > 0) if len(x) else 0
        good = np.flatnonzero(bad[1:] == bad[:-1])
        whole = np.clip(np.floor(SCALE * np.where(np.isfinite(x), x, 0)), -limit, limit)
        out = whole.astype("<i8")
        starts = ends - sizes
        norms = [float(np.sqrt(np.dot(v, v))) for v in (whole[starts[i] : ends[i]] for i in good)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), pa.array(norms, pa.float64()), pa.array([out[starts[i] : ends[i]].tobytes() for i in good], pa.binary())], names=["vec_id", "norm", "vector"])


def _matrix(blobs: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(blobs), width), np.int64)
    for i, blob in enumerate(blobs):
        x = np.frombuffer(blob, "<i8")
        out[i, : len(x)] = x
    return out


def _gram(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column(0).to_pylist(), width).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width, dtype=np.int32)), pa.array(total.ravel())], names=["at", "value"])

    return run


def _blocked(width: int, most: int):
    """One row per partition (longest vectors first) of at most ``most`` vectors: its number, ids and integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, norms, blobs = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            norms += batch.column(1).to_pylist()
            blobs += batch.column(2).to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (-norms[i], ids[i]))
        block = TaskContext.get().partitionId()
        for part, start in enumerate(range(0, len(order), most)):
            chosen = order[start : start + most]
            x = _matrix([blobs[i] for i in chosen], width)
            yield pa.RecordBatch.from_arrays([
                pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([norms[chosen[0]]], pa.float64()), pa.array([np.array([ids[i] for i in chosen], "<i8").tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()),
            ], names=["block", "part", "top", "ids", "vectors"])

    return run


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products, held within 64 bits."""
    reach = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if reach < 2**53:
        return (q.astype(float) @ c.T.astype(float)).astype(np.int64)
    if reach < 2**63:
        return q @ c.T
    return np.clip(q.astype(object) @ c.T.astype(object), -(2**63), 2**63 - 1).astype(np.int64)


def best(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, floor_: np.ndarray, rotation: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the query, vec_id, score) of each query's k best in this block that reach its floor."""
    head = min(HEAD, q.shape[1])
    qr, cr = q.astype(float) @ rotation, c.astype(float) @ rotation
    q_norm, c_norm = np.linalg.norm(qr, axis=1), np.linalg.norm(cr, axis=1)
    slack = 1e-9 * (1 + q_norm.max(initial=0) * c_norm.max(initial=0))
    live = np.flatnonzero(q_norm * c_norm.max(initial=0) + slack >= floor_)
    none = np.empty(0, np.int64)
    if not len(live) or not len(c):
        return none, none, none
    # candidates stand by descending length: those after the last that any live query can use are skipped together
    useful = (q_norm[live].max() * c_norm + slack >= floor_[live].min()).nonzero()[0]
    reach = int(useful[-1]) + 1 if len(useful) else 0
    c, cr, c_norm, ids = c[:reach], cr[:reach], c_norm[:reach], ids[:reach]
    bound = qr[live, :head] @ cr[:, :head].T
    bound += np.linalg.norm(qr[live, head:], axis=1)[:, None] * np.linalg.norm(cr[:, head:], axis=1)[None, :]
    keep = (bound + slack >= floor_[live, None]) & (query_ids[live, None] != ids[None, :])
    rows, cols = np.nonzero(keep)
    if not len(rows):
        return none, none, none
    if len(rows) * 8 > keep.size:
        exact = scores(q[live], c)[rows, cols]
    else:
        exact = np.empty(len(rows), np.int64)
        for a in range(0, len(rows), 65_536):
            x, y = q[live[rows[a : a + 65_536]]], c[cols[a : a + 65_536]]
            wide = float(np.abs(x).max()) * float(np.abs(y).max()) * x.shape[1] >= 2**63
            exact[a : a + 65_536] = np.clip((x.astype(object) * y.astype(object)).sum(1), -(2**63), 2**63 - 1).astype(np.int64) if wide else (x * y).sum(1)
    ok = exact >= floor_[live[rows]]
    rows, cols, exact = rows[ok], cols[ok], exact[ok]
    order = np.lexsort((ids[cols], -exact.astype(float), rows)) if np.abs(exact).max(initial=0) < 2**53 else np.array(sorted(range(len(rows)), key=lambda i: (rows[i], -int(exact[i]), ids[cols[i]])), dtype=int)
    rows, cols, exact = rows[order], cols[order], exact[order]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else none
    rank = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
    top = rank < k
    return live[rows[top]], ids[cols[top]], exact[top]


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, *, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of each query's k highest scores."""
    spark = vectors.sparkSession
    ship(spark)
    raw = vectors.select(F.col(id_column).alias("vec_id"), F.col(column).alias("v")).mapInArrow(_integers, "vec_id long, norm double, vector binary")
    rows = written(raw.groupBy("vec_id").agg(F.min(F.struct("vector", "norm")).alias("x")).select("vec_id", "x.norm", "x.vector"), "vectors")
    count, queries, width = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.max(F.octet_length("vector"))).first()
    width = (width or 8) // 8
    sums = rows.select("vector").mapInArrow(_gram(width), "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()  # d x d rows
    gram = np.zeros(width * width)
    for r in sums:
        gram[r["at"]] = r["value"]
    _, basis = np.linalg.eigh(gram.reshape(width, width))
    shared = spark.sparkContext.broadcast(np.ascontiguousarray(basis[:, ::-1]))

    def blocks(df: DataFrame, most: int, n: int) -> DataFrame:
        # hot lengths are split by vec_id; what a partition holds beyond ``most`` becomes further parts
        dealt = df.repartitionByRange(max(1, -(-n // most)), F.desc("norm"), "vec_id")
        return written(dealt.mapInArrow(_blocked(width, 2 * most), "block int, part int, top double, ids binary, vectors binary"), "blocks")

    candidates = blocks(rows, BLOCK, count)
    asked = blocks(rows.where(F.col("vec_id") % every == 0), QUERIES, queries).select(F.col("block").alias("q"), F.col("part").alias("qp"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))

    last_c = candidates.agg(F.max("block")).first()[0] or 0
    step = last_c // BORDERS + 1
    # the greatest length in every step-th block: whoever needs more than that has no candidates there or beyond
    borders = [(r["block"], r["top"]) for r in candidates.where((F.col("part") == 0) & (F.col("block") % step == 0)).select("block", "top").orderBy("block").collect()]

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, qp, q_ids, q_vectors, ids, vectors in zip(*(x.to_pylist() for x in batch.columns)):
                qi, x = np.frombuffer(q_ids, "<i8"), np.frombuffer(q_vectors, "<i8").reshape(-1, width)
                ci, c = np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<i8").reshape(-1, width)
                out = np.full(len(qi), -np.inf)
                for a in range(0, len(qi) if len(ci) > k else 0, AT_ONCE):
                    s = np.where(qi[a : a + AT_ONCE, None] == ci[None, :], -np.inf, scores(x[a : a + AT_ONCE], c).astype(float))
                    low = np.partition(s, -k, axis=1)[:, -k]
                    out[a : a + AT_ONCE] = np.where(np.abs(low) < 2**53, low, np.nextafter(low, -np.inf))
                need = (out.min() / max(1e-300, float(np.linalg.norm(x.astype(float), axis=1).max()))) * (1 - 1e-6) if out.min() > 0 else -np.inf
                end = next((block for block, top in borders if top < need), last_c + 1)
                yield pa.RecordBatch.from_arrays([pa.array([q], pa.int32()), pa.array([qp], pa.int32()), pa.array([q_ids], pa.binary()), pa.array([q_vectors], pa.binary()), pa.array([out.tobytes()], pa.binary()), pa.array([end], pa.int32())], names=["q", "qp", "q_ids", "q_vectors", "floors", "end"])

    longest = candidates.where("part = 0").orderBy("block").limit(1).select("ids", "vectors")  # one block
    bounded = written(asked.join(F.broadcast(longest)).mapInArrow(floors, "q int, qp int, q_ids binary, q_vectors binary, floors binary, end int"), "floors")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q_vectors, low, ids, vectors in zip(*(x.to_pylist() for x in batch.columns)):
                qi = np.frombuffer(q_ids, "<i8")
                x, floor = np.frombuffer(q_vectors, "<i8").reshape(-1, width), np.frombuffer(low)
                ci, c = np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<i8").reshape(-1, width)
                for a in range(0, len(qi), AT_ONCE):
                    at = slice(a, a + AT_ONCE)
                    row, found, score = best(qi[at], x[at], ci, c, floor[at], shared.value, k)
                    yield pa.RecordBatch.from_arrays([pa.array(qi[at][row]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    left = bounded.where("end > 0").withColumn("c", F.explode(F.sequence(F.lit(0), F.col("end") - 1))).drop("end")
    useful = bounded.groupBy("q").agg(F.max("end").alias("end")).where("end > 0").select("q", F.explode(F.sequence(F.lit(0), F.col("end") - 1)).alias("c"))
    right = candidates.withColumnRenamed("block", "c").join(useful, "c")
    met = left.join(right.hint("shuffle_hash"), ["q", "c"]).select("q_ids", "q_vectors", "floors", "ids", "vectors")
    found = met.mapInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same rows by brute force, for DuckDB.
ORACLE_SQL = f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % {EVERY} = 0
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= {K}
"""
