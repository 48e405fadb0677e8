"""Shared plumbing of the training-data operators: the cluster's shared folder, shipped code, packed shuffles."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = Path(__file__).resolve().parents[2]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a one-machine session may do without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = getattr(shared_dir, "own", None)
    if folder is None:
        folder = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def removed(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone; the folder is then the cluster's to clear
        return


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back: lineage ends here, so a lost executor
    costs the reread of a file. Folders go when the driver exits."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestrata-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(removed, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def dropped(table: DataFrame) -> None:
    """Removes the folder of a table that ``written`` made and that nothing reads any more."""
    removed(table.sparkSession, table.folder)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package: when its folder isn't on PYTHONPATH, Spark's file server sends a zip. Also
    bounds Arrow batches at 8 MB where the session has Spark's default of 64 MB, as two workers share an executor."""
    if spark.conf.get(_BATCH).rstrip("b") == str(64 << 20):
        spark.conf.set(_BATCH, str(8 << 20))
    if str(_ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    context = spark.sparkContext
    if getattr(ship, "sent", None) == context.applicationId:
        return
    archive = Path(tempfile.mkdtemp(prefix="lodestrata-code-")) / "lodestrata_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in (_ROOT / "lodestrata").rglob("*.py"):
            out.write(file, file.relative_to(_ROOT))
    context.addPyFile(str(archive))
    ship.sent = context.applicationId


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def byte_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string or binary column as UTF-8 bytes; null becomes empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.binary() if column.type == pa.string() else column.type).to_pylist()]


#: What a Python worker keeps from task to task: one operator's tables at a time.
_HELD: dict[str, object] = {}


def held(name: str, build: Callable[[], object]) -> object:
    """The worker's table of this name; another one's goes first, so that workers that serve many operators stay small."""
    if name not in _HELD:
        _let_go()
        _HELD[name] = build()
    return _HELD[name]


def _let_go() -> None:
    """Gives what the worker holds, and memory that it no longer uses, back to the system."""
    _HELD.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def lean(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The step, after which the worker gives back what it took: an executor may keep more workers than it has cores, which
    take turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        _let_go()

    return run


def pieces(batches: Iterable[pa.RecordBatch], name: str, most: int = 8 << 20, keep: str = "") -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the named column has about ``most`` bytes in each; a longer row stands alone. Drops what the
    worker holds for others than ``keep``."""
    if _HELD and keep not in _HELD:
        _let_go()
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(name))
        sizes = np.array(pc.fill_null(pc.binary_length(column), 0))
        start, total = 0, 0
        for i, size in enumerate(sizes):
            if total and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(size)
        yield batch.slice(start)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that keys made of plain bit fields spread over buckets."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def packed(keys: np.ndarray, records: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Records dealt by the hash of their key into one binary row per bucket: a shuffle of few rows and no padding."""
    bucket = (mix64(keys) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, records = bucket[order], records[order]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.array([], int)
    ends = np.r_[starts[1:], len(bucket)] if len(bucket) else starts
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[starts], pa.int32()), pa.array([records[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())],
        names=["bucket", "blob"],
    )


def unpacked(batches: Iterable[pa.RecordBatch], kind: np.dtype) -> np.ndarray:
    """All records of one partition of packed rows."""
    blobs = [x for b in batches for x in b.column(1).to_pylist()]
    return np.frombuffer(b"".join(blobs), dtype=kind) if blobs else np.empty(0, kind)


def unioned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (a[i], b[i]): each node that isn't the smallest of its tree, and that smallest."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while len(left):
        low, high = np.minimum(root[left], root[right]), np.maximum(root[left], root[right])
        open_ = low != high
        if not open_.any():
            break
        left, right, low, high = left[open_], right[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while True:
            after = root[root]
            if np.array_equal(after, root):
                break
            root = after
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        rows += batch.num_rows
        if rows > 2_000_000:  # what a worker holds at once
            a, b = unioned(*(np.concatenate(x) for x in zip(*held)))
            held, rows = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
    if held:
        a, b = unioned(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: ``(node, root)`` for every linked node but the roots
    themselves, root being the smallest node. Union-find inside partitions, then large-star and small-star rounds: each
    is two grouped minima and joins, so no component is ever gathered, and every round is a written table."""
    ship(edges.sparkSession)
    live = written(edges.where("a <> b").select("a", "b").mapInArrow(_forest, "a long, b long"), "links")
    before = None
    while True:
        # minima are tables of their own, so that a join's hot key (the hub of a large group) can be split
        both = live.select(F.col("a").alias("u"), F.col("b").alias("v")).union(live.select("b", "a"))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "star")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        pairs = written(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "star")
        least = written(pairs.groupBy("u").agg(F.min("v").alias("m")), "star")
        small = pairs.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        old, live = live, written(small.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "star")
        for table in (old, low, pairs, least):
            dropped(table)
        now = tuple(live.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
