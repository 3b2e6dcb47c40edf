"""Helpers of the operators: tables, slices of Arrow batches, words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, also inside of lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``limit`` bytes of ``column``; a longer value makes a part of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(size), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_texts(
    df: DataFrame,
    text: str,
    outputs: T.StructType,
    make: Callable[[], Callable[[list[str]], Iterable[pa.Array]]],
) -> DataFrame:
    """Append columns computed from a text column, in Arrow batches.

    ``make`` builds, once per task, the function from a list of texts (null is
    empty) to one array per output field. An input column with the name of an
    output is replaced.
    """
    kept = [c for c in df.columns if c not in outputs.names]
    if text not in kept:
        raise ValueError(f"{text} is an output")
    df = df.select(*kept)
    schema = T.StructType(df.schema.fields + outputs.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for part in slices(batch, text):
                texts = [x or "" for x in part.column(text).to_pylist()]
                arrays = list(function(texts))
                yield pa.RecordBatch.from_arrays(part.columns + arrays, names=kept + outputs.names)

    return df.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: a bijection of 64-bit integers that looks random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(30):
        p = sigmoid(x @ beta)
        gradient = x.T @ (weight * (p - y)) + penalty @ beta
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, gradient)
        beta -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def poly(parts: list[np.ndarray], salt: int = 0) -> np.ndarray:
    """64-bit hash of sequences, given as one array per place."""
    h = np.full(len(parts[0]), salt + len(parts), np.uint64)
    for p in parts:
        h = h * np.uint64(0x9E3779B97F4A7C15) + p
    return mix(h)


class WordHashes(dict):
    """Word -> 64-bit hash of its lower case, computed once per word while the table has room."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.lower())
        return value


def hash_words(texts: list[str], pattern, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the number of words of each text."""
    found = [list(map(known.__getitem__, pattern.findall(t))) for t in texts]
    counts = np.array([len(f) for f in found], np.int64)
    return np.fromiter((h for f in found for h in f), np.uint64, int(counts.sum())), counts


def similarity_of(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two counts."""
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and first word (in ``words``) of every shingle.

    A text with fewer words than ``size`` has one shingle of all its words; a
    text without words has none.
    """
    doc = np.repeat(np.arange(len(counts)), counts)
    n = len(words) - size + 1
    if n > 0:
        start = np.flatnonzero(doc[:n] == doc[size - 1 :])
        hashes = poly([words[i : i + n] for i in range(size)])[start]
    else:
        start, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = (np.cumsum(counts) - counts)[short]
        own = [poly([words[f + i : f + i + 1] for i in range(c)]) for f, c in zip(first, counts[short])]
        start, hashes = np.concatenate([start, first]), np.concatenate([hashes, *own])
        order = np.argsort(start, kind="stable")
        start, hashes = start[order], hashes[order]
    return hashes, doc[start], start
