"""Word vectors from their character runs, and an index of them.

A word is the bag of its runs of 3 to 5 characters (with its ends marked), hashed into BUCKETS and weighted
by rarity. The co-occurrence of runs in words is factorised by randomised subspace iteration: each round
multiplies a block of DIM vectors by the words' matrix and its transpose in tasks, whose sums (buckets times DIM, a
fixed size) are added by a grouped aggregate and made orthogonal on the driver. A word's vector is the sum of its
runs' vectors, so unseen words have one too.

The index has coarse cells: centroids of a bounded sample (SAMPLE vectors, by hash). Every word lies in its
nearest cell; a query looks into its nearest cells (`probes`) and ranks what lies there exactly.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .similarity import in_cells

BUCKETS, DIM, ROUNDS = 1 << 13, 32, 3
RUNS = (3, 4, 5)
#: Vectors that the cells are fitted on at most; cells at most.
SAMPLE, CELLS = 20_000, 1024


def runs(word: str) -> list[int]:
    """Buckets of the word's runs, each once."""
    data = f"<{word}>".encode()
    return sorted({zlib.crc32(data[i : i + k]) % BUCKETS for k in RUNS for i in range(max(1, len(data) - k + 1))})


def bags(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every run of every word."""
    own = [runs(w or "") for w in words]
    return np.repeat(np.arange(len(own)), [len(x) for x in own]), np.array([b for x in own for b in x], np.int64)


@dataclass
class Model:
    #: Of each bucket.
    rarity: np.ndarray
    vectors: np.ndarray

    def embed(self, words: list[str]) -> np.ndarray:
        """Unit vectors; zeros for a word of unknown runs."""
        row, bucket = bags(words)
        out = np.zeros((len(words), self.vectors.shape[1]))
        np.add.at(out, row, self.vectors[bucket] * self.rarity[bucket][:, None])
        norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-12)


def _sums(kind: str, model: Model | None):
    """A task that sums up, by bucket, the words that hold it (kind 'count') or their products with the block (kind 'step')."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 1 if model is None else model.vectors.shape[1]
        total = np.zeros((BUCKETS, width))
        for batch in batches:
            words = batch.column("word").to_pylist()
            for first in range(0, len(words), 2000):
                some = words[first : first + 2000]
                row, bucket = bags(some)
                if model is None:
                    total[:, 0] += np.bincount(bucket, minlength=BUCKETS)
                    continue
                weight = model.rarity[bucket]
                norm = np.sqrt(np.bincount(row, weights=weight**2, minlength=len(some)))
                weight = weight / np.maximum(norm[row], 1e-12)
                product = np.zeros((len(some), width))
                np.add.at(product, row, model.vectors[bucket] * weight[:, None])
                np.add.at(total, bucket, product[row] * weight[:, None])
        held = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(held), *(pa.array(total[held, j]) for j in range(width))], names=["bucket", *(f"x{j}" for j in range(width))])

    return task


def _summed(words: DataFrame, model: Model | None) -> np.ndarray:
    width = 1 if model is None else model.vectors.shape[1]
    names = [f"x{j}" for j in range(width)]
    parts = words.mapInArrow(_sums("step", model), "bucket long, " + ", ".join(f"{x} double" for x in names))
    rows = parts.groupBy("bucket").agg(*(F.sum(x).alias(x) for x in names)).toPandas()  # a row per bucket
    out = np.zeros((BUCKETS, width))
    out[rows["bucket"].to_numpy(np.int64)] = rows[names].to_numpy()
    return out


def fit(words: DataFrame, dim: int = DIM, rounds: int = ROUNDS, seed: int = 67) -> Model:
    """Vectors of the buckets; words: distinct, in column word. Sums of doubles depend on the partitioning in their last digits."""
    seen = _summed(words, None)[:, 0]
    n = max(1.0, seen.max(initial=1.0))
    rarity = np.where(seen > 0, np.log((1 + n) / np.maximum(seen, 1)) + 1, 0.0)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((BUCKETS, dim)))[0]
    for _ in range(rounds):
        moved = _summed(words, Model(rarity, block))
        block = np.linalg.qr(moved)[0] if moved.any() else block
    return Model(rarity, block)


def centroids(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 67) -> np.ndarray:
    """Spherical k-means on the sample."""
    if not len(sample):
        return np.zeros((1, DIM))
    rng = np.random.default_rng(seed)
    held = sample[rng.permutation(len(sample))[: min(cells, len(sample))]]
    for _ in range(rounds):
        own = np.argmax(sample @ held.T, axis=1)
        total = np.zeros_like(held)
        np.add.at(total, own, sample)
        norm = np.sqrt((total**2).sum(axis=1, keepdims=True))
        held = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), held)
    return held


def _placed(model: Model, cells: np.ndarray, probes: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            for first in range(0, len(words), 4096):
                some = words[first : first + 4096]
                v = model.embed(some)
                near = v @ cells.T
                count = min(probes, len(cells))
                own = np.argsort(-near, axis=1, kind="stable")[:, :count]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array(own.astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array(v.tolist(), pa.list_(pa.float64()))], names=["word", "cells", "v"])

    return task


def neighbours(asked: DataFrame, words: DataFrame, n: int, model: Model | None = None, probes: int = 16, sample: int = SAMPLE) -> DataFrame:
    """query, word, similarity, rank: of each distinct asked word the n nearest of the distinct words, itself left out.

    Null words are neither asked nor found. `probes` trades recall for work; with as many probes as cells every
    query meets every word.
    """
    words = cut(words.filter("word IS NOT NULL").select("word").distinct())
    total = words.count()
    model = model or fit(words)
    cells = max(1, min(CELLS, int(total**0.5 / 4)))
    share = min(1.0, sample / max(1, total))
    few = words.filter(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < share * (1 << 20)).orderBy("word").limit(2 * sample)
    held = centroids(model.embed([r["word"] for r in few.collect()]), cells)
    placed = lambda df, count: df.mapInArrow(_placed(model, held, count), "word string, cells array<int>, v array<double>")
    right = cut(placed(words, 1).select("word", F.col("cells")[0].alias("cell"), "v"))
    left = cut(placed(asked.filter("word IS NOT NULL").select("word").distinct(), probes)).select(F.col("word").alias("query"), F.explode("cells").alias("cell"), F.col("v").alias("q"))
    return in_cells(left, right, n, ("query", "word"), digits=6)
