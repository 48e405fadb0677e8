"""Plug-in model interfaces: embedding and generation run in Arrow batches; deterministic stand-ins need no model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Embedder = Callable[[list[str]], list[list[float]]]
Generator = Callable[[str], str]


def hashed_embedder(size: int = 64) -> Embedder:
    """A bag of hashed words of unit length: no model, the same everywhere."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), size))
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % size] += 1 - 2 * (h >> 63)
            row /= np.linalg.norm(row) or 1
        return out.tolist()

    return embed


def embedded(rows: DataFrame, embed: Embedder, batch: int = 4) -> DataFrame:
    """Adds ``embedding`` to ``rows(id, text)``; a batch that fails is embedded row by row, a row that fails gets null."""

    def one(text: str) -> list[float] | None:
        try:
            return embed([text])[0]
        except Exception:  # the model's own errors, one row at a time
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, out = [t or "" for t in frame["text"]], []
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                try:
                    out += embed(part)
                except Exception:  # then each row on its own
                    out += [one(t) for t in part]
            yield frame.assign(embedding=out)

    return rows.select("id", "text").mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, text string, embedding array<double>")


def generated(rows: DataFrame, generate: Generator) -> DataFrame:
    """Adds ``answer`` to ``rows(id, prompt)``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(answer=[generate(p) for p in frame["prompt"]])

    return rows.select("id", "prompt").mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, prompt string, answer string")
