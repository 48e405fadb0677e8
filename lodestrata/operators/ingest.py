"""Ingest: validation, content addressing, exact dedup, parsing into blocks, noise removal, parse quality."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata import config as C
from lodestrata.functions import text as T


def upload_status(name: Column, mode: Column, size: Column, limit_mb: int = C.UPLOAD_MB) -> Column:
    """202 for an upload that is taken; 415, 422 or 413 for its suffix, parse mode or size."""
    suffix = F.lower(F.regexp_extract(name, "\\.([^./]+)$", 1))
    return F.when(~suffix.isin(*C.SUFFIXES), 415).when(~mode.isin(*C.PARSE_MODES), 422).when(size > limit_mb * 1024 * 1024, 413).otherwise(202)


def raw_path(content: Column, name: Column) -> Column:
    return F.concat(F.lit("raw/"), F.sha2(content, 256), F.lit("/"), name)


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", content: str = "text") -> DataFrame:
    """``(doc_id, sha256, kept_id, duplicate)``: the smallest id of equal contents is kept."""
    hashed = docs.select(F.col(id_column).alias("doc_id"), F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("sha256"))
    first = hashed.groupBy("sha256").agg(F.min("doc_id").alias("kept_id"))
    return hashed.join(first, "sha256").select("doc_id", "sha256", "kept_id", (F.col("doc_id") != F.col("kept_id")).alias("duplicate"))


def new_documents(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of ``batch(sha256, ...)`` whose content isn't in ``existing(sha256)``, one per content."""
    first = F.row_number().over(Window.partitionBy("sha256").orderBy("doc_id"))
    return batch.join(existing.select("sha256"), "sha256", "left_anti").withColumn("rn", first).where("rn = 1").drop("rn")


_BLOCKS = "doc_id long, block int, block_type string, heading_path array<string>, content string"
#: What ends a line, besides CR and LF.
_LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"


def blocks_of(text: str) -> list[tuple[str, list[str], str]]:
    """(type, heading path, content) of a markdown text's blocks. Any line that starts with ``#`` is a heading of as many
    levels; a heading replaces what stands at its level and below, so siblings after a skipped level nest."""
    out: list[tuple[str, list[str], str]] = []
    path: list[str] = []
    held: list[str] = []

    def close() -> None:
        content = "\n".join(held).strip()
        held.clear()
        if content:
            out.append(("table" if "|" in content and "---" in content else "text", list(path), content))

    for line in text.splitlines():
        bare = line.lstrip("#")
        if bare != line:
            close()
            path = path[: len(line) - len(bare) - 1] + [bare.strip()]
        elif line.strip():
            held.append(line)
        else:
            close()
    close()
    return out


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """``(doc_id, block, block_type, heading_path, content)`` of markdown or plain documents ``(doc_id, text)``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, i, *b) for d, t in zip(frame["doc_id"], frame["text"]) for i, b in enumerate(blocks_of(t or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "block", "block_type", "heading_path", "content"])

    return docs.select("doc_id", "text").mapInPandas(run, _BLOCKS)


def toc_paths(rows: list[tuple[int, str, int]]) -> list[tuple[int, list[str]]]:
    """(page, heading path) of contents entries (level, title, page) in order; blank titles and pages under 1 are skipped."""
    out, path = [], []
    for level, title, page in rows:
        if title.strip() and page >= 1:
            path = path[: max(0, level - 1)] + [title.strip()]
            out.append((page, path))
    return out


def heading_for_pages(pages: DataFrame, toc: DataFrame) -> DataFrame:
    """As-of join: each page ``(doc_id, page)`` gets the path of the last entry ``(doc_id, seq, start_page, path)`` that
    starts at or before it, where reading stops at the first entry that starts later."""
    reach = F.max("start_page").over(Window.partitionBy("doc_id").orderBy("seq"))
    last = F.row_number().over(Window.partitionBy("doc_id", "reach").orderBy(F.desc("seq")))
    steps = toc.withColumn("reach", reach).withColumn("rn", last).where("rn = 1").select("doc_id", F.col("reach").alias("page"), "path", F.lit(0).alias("kind"))
    both = steps.unionByName(pages.select("doc_id", "page", F.lit(None).cast("array<string>").alias("path"), F.lit(1).alias("kind")))
    seen = F.last("path", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("page", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("heading", seen).where("kind = 1").select("doc_id", "page", F.coalesce("heading", F.array().cast("array<string>")).alias("heading_path"))


def page_number(text: Column) -> Column:
    return T.strip(text).rlike("(?i)^[-–—]?\\s*(?:page\\s*)?\\d{1,4}\\s*[-–—]?$")


def short_noise(text: Column) -> Column:
    value = F.regexp_replace(text, "(?U)\\s+", "")
    return (value == "") | page_number(text) | ((F.length(value) <= 2) & ~value.rlike("[\\u3400-\\u9fffA-Za-z0-9]"))


def repeated_edges(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, line, pages)``: normalized lines of at most 120 characters that stand on at least max(3, 35 %) of a
    group's pages. ``lines(keys, page, line)`` are edge lines; where there is no layout, all lines."""
    normal = F.lower(T.squeeze(F.col("line")))
    short = lines.select(*keys, "page", normal.alias("line")).where((F.col("line") != "") & (F.length("line") <= C.EDGE_CHARS))
    pages = lines.groupBy(*keys).agg(F.countDistinct("page").alias("total"))
    counted = short.distinct().groupBy(*keys, "line").agg(F.count("*").alias("pages"))
    need = F.greatest(F.lit(C.EDGE_PAGES), F.floor(F.col("total") * C.EDGE_SHARE))
    return counted.join(pages, keys).where(F.col("pages") >= need).select(*keys, "line", "pages")


def without_noise(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines that are no page numbers, short noise, or repeated edges (``edge`` says which rows stand at an edge)."""
    repeated = repeated_edges(lines.where("edge"), keys).select(*keys, F.col("line").alias("normal"), F.lit(True).alias("edge"))
    rest = lines.where(~page_number(F.col("line")) & ~short_noise(F.col("line"))).withColumn("normal", F.lower(T.squeeze(F.col("line"))))
    return rest.join(repeated, [*keys, "normal", "edge"], "left_anti").drop("normal")


def parse_quality(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Grades groups of pages ``(keys, blocks, short_blocks)``: status, counts and ratios."""
    out = pages.groupBy(*keys).agg(F.count("*").alias("total_pages"), F.count_if(F.col("blocks") > 0).alias("text_pages"), F.sum("blocks").alias("total_blocks"), F.sum("short_blocks").alias("short"))
    avg = F.bround(F.col("total_blocks") / F.col("total_pages"), 2)
    short = F.when(F.col("total_blocks") > 0, F.bround(F.col("short") / F.col("total_blocks"), 4)).otherwise(0.0)
    out = out.withColumn("empty_pages", F.col("total_pages") - F.col("text_pages")).withColumn("avg_blocks_per_page", avg).withColumn("short_block_ratio", short)
    share = F.col("text_pages") / F.col("total_pages")
    status = F.when((F.col("total_pages") == 0) | (F.col("total_blocks") == 0) | (share < 0.4), "POOR").when((share < 0.85) | (F.col("avg_blocks_per_page") < 1.5) | (F.col("short_block_ratio") > 0.35), "WARNING").otherwise("GOOD")
    return out.withColumn("status", status).drop("short")


def embedding_hash(model: Column, text: Column) -> Column:
    return F.sha2(F.concat(model, F.lit("\n"), text), 256)


def uncached(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows of ``texts(hash, ...)`` that ``cache(hash, embedding)`` has no vector for: what an embedder must still do."""
    return texts.join(cache.where("embedding is not null").select("hash"), "hash", "left_anti")
