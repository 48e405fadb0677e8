"""Structure- and token-aware chunks from parsed blocks, their ordinals, links and manifest."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata import config as C
from lodestrata.functions import text as T

_CJK = re.compile("[\u3400-\u9fff]")
_HIDDEN = re.compile("[\\s\u3400-\u9fff]")
_SENTENCE = re.compile(r"(?<=[。！？!?；;])\s*|\n{2,}|(?<=[.!?])\s+(?=[A-Z0-9])")
CHUNKS = "doc_id long, ordinal int, block_type string, heading_path array<string>, page int, bbox array<double>, content string, estimated_tokens int, source_method string"


def tokens_of(text: str) -> int:
    return len(_CJK.findall(text)) + math.ceil(len(_HIDDEN.sub("", text)) / 4)


def pieces_of(unit: str, limit: int) -> list[str]:
    """The unit in longest prefixes of at most ``limit`` tokens, in one pass over its characters."""
    if tokens_of(unit) <= limit:
        return [unit]
    out, start, cjk, rest = [], 0, 0, 0
    for i, char in enumerate(unit):
        wide = "\u3400" <= char <= "\u9fff"
        plain = not wide and not char.isspace()
        if i > start and cjk + wide + math.ceil((rest + plain) / 4) > limit:
            out.append(unit[start:i])
            start, cjk, rest = i, 0, 0
        cjk, rest = cjk + wide, rest + plain
    return [*out, unit[start:]]


def bbox_union(boxes: list) -> list[float] | None:
    full = [b for b in boxes if b is not None and len(b) == 4]
    return [f(b[i] for b in full) for i, f in enumerate((min, min, max, max))] if full else None


def table_parts(content: str, limit: int) -> list[str]:
    """A table whole, or parts that repeat its two header lines and the part before's last row."""
    lines = [x for x in content.splitlines() if x.strip()]
    if len(lines) < 3 or tokens_of(content) <= limit:
        return [content]
    head, out, body = lines[:2], [], []
    for row in lines[2:]:
        if body and tokens_of("\n".join([*head, *body, row])) > limit:
            out.append("\n".join([*head, *body]))
            body = [body[-1], row]
        else:
            body.append(row)
    return [*out, "\n".join([*head, *body])] if body else out


def prose_parts(units: list[tuple[str, list | None]], target: int, limit: int, overlap: int, strict: bool = False) -> list[tuple[str, list | None]]:
    """Packs units into chunks that close at ``target`` tokens or before they would pass ``limit``. A chunk starts with the
    last units before it, at most ``overlap`` tokens but always one. As a consequence a unit that doesn't fit after the
    overlap closes a chunk of the overlap alone; ``strict`` leaves such chunks out."""
    out: list[tuple[str, list | None]] = []
    sizes = [tokens_of(u) for u, _ in units]
    first, end, fresh = 0, 0, False  # the open chunk is units[first:end]

    def close() -> None:
        nonlocal first, fresh
        if fresh or not strict:
            out.append((" ".join(u for u, _ in units[first:end]).strip(), bbox_union([b for _, b in units[first:end]])))
        size, start = 0, end
        while start > first and (start == end or size + sizes[start - 1] <= overlap):
            start -= 1
            size += sizes[start]
        first, fresh = start, False

    for i in range(len(units)):
        if end > first and sum(sizes[first:end]) + sizes[i] > limit:
            close()
        end, fresh = i + 1, True
        if sum(sizes[first:end]) >= target:
            close()
    if fresh:
        out.append((" ".join(u for u, _ in units[first:end]).strip(), bbox_union([b for _, b in units[first:end]])))
    return out


def chunks_of(blocks: list[dict], target: int = C.TARGET_TOKENS, limit: int = C.MAX_TOKENS, overlap: int = C.OVERLAP_TOKENS, strict: bool = False) -> list[dict]:
    """Chunks of one document's blocks in order: tables, formulas and images stand alone; prose joins while page and
    heading stay."""
    out: list[dict] = []
    prose: list[dict] = []
    path = lambda b: [] if b.get("heading_path") is None else list(b["heading_path"])

    def add(block: dict, kind: str, content: str, box: list | None) -> None:
        out.append({"block_type": kind, "heading_path": path(block), "page": block.get("page"), "bbox": box, "content": content, "estimated_tokens": tokens_of(content), "source_method": block.get("source_method")})

    def flush() -> None:
        units = [(p, b.get("bbox")) for b in prose for s in _SENTENCE.split(b["content"].strip()) if s and s.strip() for p in pieces_of(s.strip(), limit)]
        for content, box in prose_parts(units, target, limit, overlap, strict):
            add(prose[0], "text", content, box)
        prose.clear()

    for block in blocks:
        kind, content = block["block_type"], block["content"]
        if not content.strip():
            continue
        if kind in ("table", "formula", "image"):
            flush()
            for part in table_parts(content, limit) if kind == "table" else [content.strip()]:
                add(block, kind, part, block.get("bbox"))
            continue
        if prose and (prose[0].get("page"), path(prose[0])) != (block.get("page"), path(block)):
            flush()
        prose.append(block)
    flush()
    return out


def chunk(blocks: DataFrame, target: int = C.TARGET_TOKENS, limit: int = C.MAX_TOKENS, overlap: int = C.OVERLAP_TOKENS, strict: bool = False) -> DataFrame:
    """Chunks of ``blocks(doc_id, block, block_type, heading_path, content[, page, bbox, source_method])``. A document's
    blocks meet in one row; documents are spread by doc_id, so a group is one document."""
    have = set(blocks.columns)
    fields = ["block", "block_type", "heading_path", "content"]
    optional = {"page": "int", "bbox": "array<double>", "source_method": "string"}
    row = F.struct(*fields, *[F.col(c).cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in optional.items()])
    grouped = blocks.groupBy("doc_id").agg(F.sort_array(F.collect_list(row)).alias("blocks"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{"doc_id": d, "ordinal": i, **c} for d, b in zip(frame["doc_id"], frame["blocks"]) for i, c in enumerate(chunks_of([x if isinstance(x, dict) else x.asDict() for x in b], target, limit, overlap, strict))]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in CHUNKS.split(", ")]).astype({"page": "Int32"})

    return grouped.mapInPandas(run, CHUNKS)


def point_id(sha256: Column, ordinal: Column) -> Column:
    """The stable id of a chunk's vector."""
    return T.uuid5(F.concat(sha256, F.lit(":"), ordinal.cast("string")))


def linked(chunks: DataFrame) -> DataFrame:
    """Adds ``chunk_id`` (document and ordinal) and the ids of the neighbours in the document."""
    at = Window.partitionBy("doc_id").orderBy("ordinal")
    out = chunks.withColumn("chunk_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("ordinal").cast("string")))
    return out.withColumn("previous_id", F.lag("chunk_id").over(at)).withColumn("next_id", F.lead("chunk_id").over(at))


def embed_text(heading_path: Column, content: Column) -> Column:
    """Fixed format of the text an embedder sees."""
    return F.when(F.size(heading_path) > 0, F.concat(F.lit("标题路径："), F.array_join(heading_path, " / "), F.lit("\n正文："), content)).otherwise(content)


def manifest(chunks: DataFrame) -> DataFrame:
    """``(doc_id, manifest)``: parameters and chunks of each document as JSON."""
    row = F.struct("ordinal", "block_type", "heading_path", "page", "estimated_tokens", "content")
    listed = chunks.groupBy("doc_id").agg(F.sort_array(F.collect_list(row)).alias("chunks"))
    whole = F.struct(F.lit("structure-token-v1").alias("version"), F.lit(C.TARGET_TOKENS).alias("target_tokens"), F.lit(C.MAX_TOKENS).alias("max_tokens"), F.lit(C.OVERLAP_TOKENS).alias("overlap_tokens"), "chunks")
    return listed.select("doc_id", F.to_json(whole).alias("manifest"))
