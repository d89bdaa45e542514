"""Toxicity by multiple-instance learning: noisy-or over sentence scores, trained from document labels.

A sentence's score is logistic in its words and their beginnings (hashed, since insults are
inflected); a document is toxic if any sentence is: 1 - prod(1 - p). Only documents are labelled,
so the likelihood of the document decides the weights, by gradient ascent with a ridge. Features
that don't tell the two kinds of documents apart (a two-proportion z below SCREEN) get none. Sentences whose own score
reaches one half are the offending ones.

The classifier is fitted on at most SAMPLE labelled documents of each label (those whose hashed
id is smallest); the counts of all labelled ones give the classes their true weights. Scoring reads
every whole text in one pass without a shuffle. Labels, lang, source and doc_id are never features.

Defined results: null, empty and wordless texts have no sentence and score 0; equal texts score
equally; rows with a null doc_id are scored, and never learnt from; without labels of both kinds
every score is 0; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textcore import LOWER, Prefix, buffers, byte_values, mix, spans, give_back, trimmed, words

BUCKETS = 1 << 18
#: Labelled documents of each label that are learnt from at most.
SAMPLE = 4000
ROUNDS, RATE, RIDGE, LEAST, SCREEN = 150, 0.2, 1e-5, 5, 4.0
#: Bytes of a word's beginnings.
STEMS = (4, 5, 6)
CHUNK = 1 << 20
#: Bytes of texts whose features the driver makes at once.
FIT_CHUNK = 1 << 18

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
OUTSIDE = ~_WORD
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".!?\n"]] = True


def instances(raw: np.ndarray, offsets: np.ndarray):
    """(bucket and sentence of each feature, document and byte span of each sentence)."""
    low = LOWER[raw]
    starts, ends, bounds = words(low, offsets, OUTSIDE)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none, none, none, none
    prefix = Prefix(byte_values()[low])
    parts = [prefix.runs(starts, ends), *(prefix.runs(starts, np.minimum(starts + k, ends)) + np.uint64(k << 50) for k in STEMS)]
    bucket = (mix(np.concatenate(parts)) >> np.uint64(64 - 18)).astype(np.int64)
    after = np.cumsum(ENDS[raw])[starts]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    new = np.ones(len(starts), bool)
    new[1:] = (after[1:] != after[:-1]) | (doc[1:] != doc[:-1])
    sentence = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return bucket, np.tile(sentence, 1 + len(STEMS)), doc[first], starts[first], ends[last]


@dataclass
class Model:
    weight: np.ndarray
    bias: float

    def logits(self, bucket: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        return self.bias + np.bincount(sentence, weights=self.weight[bucket], minlength=n)


def softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def train(texts: list[str], labels: np.ndarray, weights: np.ndarray) -> Model:
    """Weights that maximise the likelihood of the documents' labels under noisy-or (Adam, full batches)."""
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
    raw, m = np.frombuffer(b"".join(data), np.uint8), len(data)
    del data, texts  # the driver holds them once

    def parts():
        """Chunk by chunk, so that the driver never holds all features at once."""
        for first, last in spans(offsets, FIT_CHUNK):
            own = offsets[first : last + 1] - offsets[first]
            bucket, sentence, doc, _, _ = instances(raw[offsets[first] : offsets[last]], own)
            yield bucket, sentence, doc + first

    seen = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    for bucket, sentence, doc in parts():
        pair = np.unique(bucket * m + doc[sentence]) if len(bucket) else bucket
        toxic = labels[pair % max(1, m)] == 1
        for t in (0, 1):
            seen[t] += np.bincount(pair[toxic == t] // max(1, m), minlength=BUCKETS)
    sizes = [max(1, int((labels == t).sum())) for t in (0, 1)]
    both = (seen[0] + seen[1]) / sum(sizes)
    spread = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / sizes[0] + 1 / sizes[1]))
    known = (np.abs(seen[1] / sizes[1] - seen[0] / sizes[0]) >= SCREEN * spread) & (seen[0] + seen[1] >= LEAST)
    slot, size = np.cumsum(known) - 1, int(known.sum())
    found, n = [], 0
    for bucket, sentence, doc in parts():
        keep = known[bucket]
        found.append((slot[bucket[keep]], sentence[keep] + n, doc))
        n += len(doc)
    word, sentence, doc = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
    w, b = np.zeros(size), -6.0
    mean, square, mean_b, square_b = np.zeros(size), np.zeros(size), 0.0, 0.0
    total = weights.sum()
    for step in range(1, ROUNDS + 1):
        z = b + np.bincount(sentence, weights=w[word], minlength=n)
        s = np.bincount(doc, weights=softplus(z), minlength=m)
        pull = np.where(labels == 1, -1.0 / np.maximum(np.expm1(np.minimum(s, 50.0)), 1e-9), 1.0) * weights / total
        g = pull[doc] / (1.0 + np.exp(np.minimum(-z, 500.0)))
        grad = np.bincount(word, weights=g[sentence], minlength=size) + RIDGE * w
        grad_b = g.sum()
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        mean_b, square_b = 0.9 * mean_b + 0.1 * grad_b, 0.99 * square_b + 0.01 * grad_b**2
        rate = RATE * min(1.0, 2.0 * (1 - step / (ROUNDS + 1))) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        w -= rate * mean / (np.sqrt(square) + 1e-7)
        b -= rate * mean_b / (np.sqrt(square_b) + 1e-7)
    full = np.zeros(BUCKETS)
    full[known] = w
    return Model(full, float(b))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from labelled documents that aren't held out, `sample` of each label at most."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter("id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out(F.col("id")))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    chosen = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    few = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * sample rows at most
    found = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(few, "id")
    found = found.orderBy(F.xxhash64("id"), "text").limit(2 * sample).toPandas()
    y = found["toxic"].to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    share = {k: counts[k] / max(1, int((y == k).sum())) for k in (0, 1)}
    model = train(found.pop("text").tolist(), y, np.array([share[int(k)] for k in y]))
    give_back()
    return model


def _score_task(bucket_of: np.ndarray, weight: np.ndarray, bias: float):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.zeros(BUCKETS)
        full[bucket_of] = weight
        model = Model(full, bias)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            raw, offsets = buffers(batch.column("text"))
            for first, last in spans(offsets, CHUNK):
                own = offsets[first : last + 1] - offsets[first]
                bucket, sentence, doc, start, end = instances(raw[offsets[first] : offsets[last]], own)
                z = model.logits(bucket, sentence, len(doc))
                score = -np.expm1(-np.bincount(doc, weights=softplus(z), minlength=last - first))
                bad: list[list[dict]] = [[] for _ in range(last - first)]
                for i in np.flatnonzero(z >= 0).tolist():
                    a = int(own[doc[i]])
                    bad[doc[i]].append({"start": int(start[i]) - a, "end": int(end[i]) - a, "score": float(1 / (1 + np.exp(-z[i])))})
                rest = [batch.column(i).slice(first, last - first) for i in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(score), pa.array(bad, kind)], names=[*batch.schema.names, "score", "sentences"])

    return task


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, text (bytes), score and the offending sentences (byte spans) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    if model is None:
        return rows.withColumns({"score": F.lit(0.0), "sentences": F.expr("cast(array() as array<struct<start:bigint,end:bigint,score:double>>)")})
    there = np.flatnonzero(model.weight)
    task = _score_task(there, model.weight[there], model.bias)
    return rows.mapInArrow(trimmed(task), "doc_id long, text binary, score double, sentences array<struct<start:long,end:long,score:double>>")


def reject(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """The rows of docs that score below `least`, with their columns; rows with equal texts go together."""
    if model is None:
        return docs
    there = np.flatnonzero(model.weight)
    name = "_score"
    while name in docs.columns:
        name += "_"
    task = _score_columns(docs.columns.index("text"), _score_task(there, model.weight[there], model.bias), name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(trimmed(task), schema).filter(F.col(name) < least).drop(name)


def _score_columns(at: int, scored, name: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.RecordBatch.from_arrays([batch.column(at)], names=["text"])
            found = [b.column("score") for b in scored(iter([text]))]
            value = pa.concat_arrays(found) if found else pa.array([], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, value], names=[*batch.schema.names, name])

    return task
