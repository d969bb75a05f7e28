"""Replaceable models behind small protocols, with deterministic stand-ins, and how plans call them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class Scorer(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class Generator(Protocol):
    def chat(self, prompt: str) -> str: ...


class HashEmbedder:
    """Unit vectors from hashed words."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "big")
                row[h % self.width] += 1 if h >> 63 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1)


class OverlapScorer:
    """Share of the second text's words that the first has."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for a, b in pairs:
            want = set(b.lower().split())
            out.append(len(want & set(a.lower().split())) / len(want) if want else 0.0)
        return out


class EchoGenerator:
    """The first line of the prompt's context."""

    def chat(self, prompt: str) -> str:
        return prompt.strip().split("\n", 1)[0]


def embed(docs: DataFrame, key: str, text: str, provider: Embedder) -> DataFrame:
    """key, v (normalised)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "v": list(provider.embed(b[text].fillna("").tolist()))})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, v array<double>")


def score(pairs: DataFrame, left: str, right: str, provider: Scorer, name: str = "score") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{name: provider.score(list(zip(b[left], b[right], strict=True)))})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.mapInPandas(run, f"{schema}, {name} double")


def generate(prompts: DataFrame, key: str, prompt: str, provider: Generator) -> DataFrame:
    """key, answer, error: a failing call gives an error, never a failing task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers, errors = [], []
            for p in b[prompt]:
                try:
                    answers.append(provider.chat(p))
                    errors.append(None)
                except Exception as failed:  # noqa: BLE001 - any provider failure becomes a value
                    answers.append(None)
                    errors.append(str(failed))
            yield pd.DataFrame({key: b[key], "answer": answers, "error": errors})

    kind = prompts.schema[key].dataType.simpleString()
    return prompts.select(key, prompt).mapInPandas(run, f"{key} {kind}, answer string, error string")


def fill_missing(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key a cache table does not hold yet: the resumable part of a generation job."""
    return wanted.join(done.select(key), key, "left_anti")
