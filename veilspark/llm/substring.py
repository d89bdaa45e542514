"""Substring dedup by seed and extend over words.

Seeds are winnowed anchors: of the k-word grams in each window of `length` words the one with the
smallest hash. Places with the same anchor are joined; a match is extended both ways at once where
the whole regions around the anchor are equal, and word by word (as windows around the anchor)
where they differ. What overlaps or touches is merged, which leaves the maximal repeats of
`length` words or more. See `repeats` for why no pair of places is ever written out.

Defined results: null text has no words; an empty text stays empty; equal rows, with the same
doc_id or another, repeat each other; extra columns are ignored; an empty table gives no rows; a
null doc_id is carried as it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import scratch
from .repeats import PLACE, covered, distinct_places, keyed, listed, places_of, repeated_places, shared_anchors, with_places
from .textcore import buffers, columns, trimmed, words

RESULT = "doc_id long, n_words long, n_removed long, kept binary, spans array<struct<start:long,end:long>>"


def _cut(digest: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column("text"))
            off, (s, e) = places_of(batch, "s", "e")
            first, last, bounds = words(raw, offsets)
            n_words, n_removed, kept, runs = [], [], [], []
            for row in range(batch.num_rows):
                a, b = first[bounds[row] : bounds[row + 1]], last[bounds[row] : bounds[row + 1]]
                data = raw[offsets[row] : offsets[row + 1]].tobytes()
                gone = covered(len(a), s[off[row] : off[row + 1]], e[off[row] : off[row + 1]])
                if gone.any():
                    stay = np.flatnonzero(~gone)
                    a0, b0 = (a[stay] - offsets[row]).tolist(), (b[stay] - offsets[row]).tolist()
                    text = b" ".join([data[x:y] for x, y in zip(a0, b0, strict=True)])
                else:
                    text = b" ".join(data.split())
                step = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                n_words.append(len(a))
                n_removed.append(int(gone.sum()))
                kept.append(hashlib.sha256(text).hexdigest() if digest else text)
                runs.append([{"start": x, "end": y} for x, y in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True)])
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()) if digest else ("kept", pa.binary()), ("spans", span)])
            yield columns(schema, doc_id=batch.column("doc_id"), n_words=n_words, n_removed=n_removed, spans=runs, **{"kept_sha256" if digest else "kept": kept})

    return task


def remove_repeats(docs: DataFrame, length: int = 35, k: int = 8, digest: bool = False) -> DataFrame:
    """Removes every word that lies in a window of `length` words which starts elsewhere too.

    Returns doc_id, n_words, n_removed, the maximal removed spans in words, and the kept words
    joined by a space (`kept`, or with digest its `kept_sha256`).
    """
    if not 1 <= k <= length:
        raise ValueError("k must be between 1 and length")
    base = scratch.folder(docs.sparkSession)
    rows = keyed(docs)
    shared = shared_anchors(rows, "word", k, length, base)
    regions = scratch.save(distinct_places(shared, ["h", "r1", "r2"], PLACE), f"{base}/regions")
    places = repeated_places(rows, shared, regions, "word", length, base)
    schema = RESULT.replace("kept binary", "kept_sha256 string") if digest else RESULT
    return with_places(rows, listed(places, "s", "e"), "left").mapInArrow(trimmed(_cut(digest)), schema)
