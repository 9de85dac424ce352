"""Models behind one interface, and one that works without any: the same text gives the same vector and answer."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Fixed value: texts in a call at most.
BATCH = 100


class Provider(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def generate(self, prompt: str) -> str: ...


class Offline:
    """Vectors from word hashes, answers from the prompt's digest."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            vector = np.zeros(self.dims)
            for word in text.lower().split():
                digest = hashlib.md5(word.encode()).digest()
                vector[digest[0] % self.dims] += 1 if digest[1] & 1 else -1
            out.append((vector / max(1e-12, float(np.sqrt(vector @ vector)))).tolist())
        return out

    def generate(self, prompt: str) -> str:
        digest = hashlib.md5(prompt.encode()).hexdigest()
        return '{"faqs": [{"question": "What is %s?", "answer": "It is %s."}]}' % (digest[:6], digest[6:12])


def embedded(rows: DataFrame, text: str, provider: Provider, batch: int = BATCH) -> DataFrame:
    """rows with `embedding`: texts go to the provider in calls of at most `batch`, in order; a call that gives another
    number of vectors is an error."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors: list[list[float]] = []
            for begin in range(0, len(frame), batch):
                texts = frame[text].iloc[begin : begin + batch].fillna("").tolist()
                got = provider.embed(texts)
                if len(got) != len(texts):
                    raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
                vectors += got
            yield frame.assign(embedding=vectors)

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "embedding")
    return rows.drop("embedding").mapInPandas(work, f"{fields}, embedding array<float>")


def generated(rows: DataFrame, prompt: str, provider: Provider) -> DataFrame:
    """rows with `reply`, the provider's text for each prompt."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(reply=[provider.generate(p) for p in frame[prompt]])

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "reply")
    return rows.drop("reply").mapInPandas(work, f"{fields}, reply string")
