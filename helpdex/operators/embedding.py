"""Embedders: the offline hashing embedder and a client of an HTTP embeddings endpoint."""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpdex.functions.vectors import normalized

HASH_DIMS = 64
#: The prefixes that are not part of a text, and what a word is.
PREFIX = re.compile(r"^(task: [^|]*\| query: |title: [^|]*\| text: )")
WORD = regex.compile(r"\p{L}+|\p{N}+")
#: Letters and numbers in a row, one or several words.
RUN = re.compile(r"[^\W_]+")
SAME = 0.99


class Embedder(Protocol):
    def embed(self, rows: DataFrame, text_col: str) -> DataFrame:
        """``rows`` with a column ``vec`` of unit vectors (null where a text has none)."""


def fnv1a(data: bytes) -> int:
    """32-bit FNV-1a hash."""
    h = 0x811C9DC5
    for b in data:
        h = ((h ^ b) * 0x01000193) & 0xFFFFFFFF
    return h


class WordCounter:
    """Counts of words by hash bucket; remembers what runs of letters and digits stand for."""

    MOST_KEPT = 500_000

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.mixed: list[list[int]] = []

    def bucket(self, run: str) -> int:
        """The bucket of a run that is one word, -1 if it is too short, else -2 - k for the buckets ``mixed[k]``."""
        if run.isalpha() or run.isdecimal():
            return fnv1a(run.encode()) % HASH_DIMS if len(run) >= 3 else -1
        self.mixed.append([fnv1a(w.encode()) % HASH_DIMS for w in WORD.findall(run) if len(w) >= 3])
        return -1 - len(self.mixed)

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text: counts of its words of three characters or more; the first bucket is 1 if there is none."""
        if len(self.known) > self.MOST_KEPT:
            self.known, self.mixed = {}, []
        runs = [RUN.findall(PREFIX.sub("", t or "").lower()) for t in texts]
        flat = [r for own in runs for r in own]
        for run in set(flat).difference(self.known):
            self.known[run] = self.bucket(run)
        bucket = np.fromiter(map(self.known.__getitem__, flat), dtype=np.int64, count=len(flat))
        text = np.repeat(np.arange(len(texts)), [len(own) for own in runs])
        single = bucket >= 0
        counts = np.bincount(text[single] * HASH_DIMS + bucket[single], minlength=len(texts) * HASH_DIMS).reshape(-1, HASH_DIMS).astype(np.float64)
        for k in np.flatnonzero(bucket < -1).tolist():
            for b in self.mixed[-2 - bucket[k]]:
                counts[text[k], b] += 1
        counts[~counts.any(axis=1), 0] = 1
        return counts


@dataclass(frozen=True)
class HashingEmbedder:
    """Deterministic offline embeddings: hashed word counts of length one. Null and wordless texts get the first axis."""

    def embed(self, rows: DataFrame, text_col: str) -> DataFrame:
        @F.arrow_udf("array<float>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            counter = WordCounter()
            for texts in batches:
                counts = counter.counts(texts.to_pylist())
                flat = (counts / np.sqrt((counts * counts).sum(axis=1, keepdims=True))).astype(np.float32).ravel()
                yield pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, HASH_DIMS), pa.int32()), pa.array(flat))

        return rows.withColumn("vec", run(F.col(text_col)))


def post_json(url: str, body: dict, api_key: str, timeout: float) -> dict:
    """The reply to a JSON request; an error names the status and the first 300 bytes of the body."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {api_key}"} if api_key else {}))
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return json.load(reply)
    except urllib.error.HTTPError as e:
        said = e.read()
        raise RuntimeError(f"{url}: status {e.code}: {said[:300].decode(errors='replace')}{'...' if len(said) > 300 else ''}") from e


@dataclass(frozen=True)
class HttpEmbedder:
    """Embeddings of an HTTP endpoint, asked from the tasks in batches; the result should be written before it is reused."""

    base_url: str
    model: str
    dims: int = 256
    batch_size: int = 1
    timeout_sec: float = 120
    api_key: str = ""

    def ask(self, texts: list[str]) -> list[list[float]]:
        """Raw vectors in the order of ``texts``; missing, repeated or foreign indices are errors."""
        reply = post_json(f"{self.base_url.rstrip('/')}/embeddings", {"model": self.model, "input": texts}, self.api_key, self.timeout_sec)
        got = {d["index"]: d["embedding"] for d in reply.get("data", [])}
        if len(reply.get("data", [])) != len(texts) or sorted(got) != list(range(len(texts))):
            raise RuntimeError(f"embeddings: {len(texts)} texts sent, indices {sorted(got)} returned")
        return [got[i] for i in range(len(texts))]

    def embed(self, rows: DataFrame, text_col: str) -> DataFrame:
        ask, size = self.ask, self.batch_size

        @F.pandas_udf("array<double>")
        def run(texts: pd.Series) -> pd.Series:
            listed = texts.fillna("").tolist()
            return pd.Series([v for k in range(0, len(listed), size) for v in ask(listed[k : k + size])])

        return rows.withColumn("raw", run(F.col(text_col))).withColumn("vec", normalized(F.col("raw"), self.dims)).drop("raw")


def batching_is_consistent(ask: Callable[[list[str]], list[list[float]]], first: str, second: str) -> bool:
    """Whether two texts embedded together get (nearly) the vectors they get alone."""
    together, alone = ask([first, second]), [ask([first])[0], ask([second])[0]]
    for x, y in zip(together, alone):
        a, b = np.array(x, dtype=float), np.array(y, dtype=float)
        if a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-300) < SAME:
            return False
    return True


def checked_batch_size(embedder: HttpEmbedder, first: str, second: str) -> HttpEmbedder:
    """``embedder``, asking for one text at a time if its batches are not consistent."""
    if embedder.batch_size == 1 or batching_is_consistent(embedder.ask, first, second):
        return embedder
    return HttpEmbedder(**{**embedder.__dict__, "batch_size": 1})
