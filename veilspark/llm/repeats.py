"""Exact repeats of a fixed length across a corpus, from winnowed anchors (shared by substring and suffix dedup).

A unit is a word or a byte. Every window of `length` units picks the smallest hash among its
k-grams, the rightmost of equals; that k-gram is the window's anchor. The choice depends on the
window alone, so equal windows pick equal anchors at equal distances, and two places that share a
window share its anchor. The windows of one anchor start at consecutive units lo..hi; the text
from lo to hi + length is the anchor's region.

1. `anchors`: one row per anchor; those whose hash occurs once in the corpus cannot lie in a
   repeat and go.
2. Regions: equal regions at different places are repeats as a whole. How they are grouped is
   the calling operator's method.
3. Where one anchor has different regions, one place of each is taken apart: first into blocks of a
   few consecutive windows, counted from the anchor. What all windows of a block share, its core,
   is nearly a window long, so a block whose core is unique has no repeat. Blocks with equal cores
   are handled like regions: equal ones repeat as a whole, and one place of each different one is
   extended unit by unit, its windows compared by 128-bit fingerprints.
4. Repeated regions, blocks and windows are put together per document.

Nothing is grouped by a key without an aggregate before the shuffle, and rows go back to their
places by joins that Spark can split, so hot passages don't land in one task. Documents are
identified by (doc_id, xxhash64(text)); equal rows therefore count as separate places with equal
content, which is what they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .textcore import BASES, CHUNK, SPACE, Prefix, buffers, byte_values, columns, mix, sliding_min, spans, trimmed, word_hashes, words

U64 = np.uint64
KEY = ["doc_id", "dig"]
#: Windows of a block.
BLOCK = {"byte": 16, "word": 4}
PLACE = ["doc_id", "dig", "lo", "hi", "at"]
ANCHOR = "h long, r1 long, r2 long, doc_id long, dig long, lo int, hi int, at int"
PART = "c1 long, c2 long, b1 long, b2 long, doc_id long, dig long, lo int, hi int"
WINDOW = "w1 long, w2 long, doc_id long, dig long, s int"


def layout(*names: str) -> pa.Schema:
    """Columns of a task's rows; places within a text fit in 32 bits."""
    return pa.schema([(n, pa.int32() if n in ("lo", "hi", "at", "s") else pa.int64()) for n in names])


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, dig and the text as bytes; null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("dig"), text.cast("binary").alias("text"))


def byte_units(raw: np.ndarray, offsets: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Values of the units for each base, and the documents' bounds in units."""
    values = byte_values()[raw]
    return (values, values), offsets


def word_units(raw: np.ndarray, offsets: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """As `byte_units`; the two streams of word hashes are independent."""
    starts, ends, bounds = words(raw, offsets, SPACE)
    return (word_hashes(raw, starts, ends, 0), word_hashes(raw, starts, ends, 1)), bounds


def prefixes(values: tuple[np.ndarray, np.ndarray]) -> list[Prefix]:
    return [Prefix(v, base) for v, base in zip(values, BASES, strict=True)]


def pick(values: tuple[np.ndarray, np.ndarray], bounds: np.ndarray, k: int, length: int):
    """Anchors of documents laid end to end: (document, lo, hi, anchor, hash, two region hashes); places from the document's start."""
    width = length - k + 1
    none = np.zeros(0, np.int64)
    if len(values[0]) < length:
        return none, none, none, none, none.astype(U64), none.astype(U64), none.astype(U64)
    one, two = prefixes(values)
    grams = one.grams(k)
    least = sliding_min(grams, width)
    n = len(least)
    enters = grams[width - 1 :] == least
    start = enters.copy()
    start[0] = True
    start[1:] |= least[1:] != least[:-1]
    heads = bounds[:-1]
    start[heads[heads < n]] = True
    lo = np.flatnonzero(start)
    hi = np.append(lo[1:], n) - 1
    doc = np.searchsorted(bounds, lo, side="right") - 1
    hi = np.minimum(hi, bounds[doc + 1] - length)
    keep = hi >= lo
    lo, hi, doc = lo[keep], hi[keep], doc[keep]
    at = lo + width - 1
    seek = np.flatnonzero(~enters[lo])
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    for i in range(0, len(seek), 2048):
        part = lo[seek[i : i + 2048]]
        at[seek[i : i + 2048]] = part + width - 1 - np.argmin(view[part][:, ::-1], axis=1)
    end = hi + length
    return doc, lo - bounds[doc], hi - bounds[doc], at - bounds[doc], grams[at], one.runs(lo, end), two.runs(lo, end)


def _pieces(raw: np.ndarray, offsets: np.ndarray, units: Callable, length: int):
    """(first row, unit values, bounds, units cut off before) of bounded chunks.

    A document of over CHUNK units is cut into parts that overlap by a window less one unit, so
    that every window lies in one part; a region that ends at such a cut is only shorter.
    """
    for first, last in spans(offsets, CHUNK):
        values, bounds = units(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        if last - first > 1 or len(values[0]) <= 2 * CHUNK:
            yield first, values, bounds, 0
            continue
        for cut in range(0, len(values[0]), CHUNK):
            part = tuple(v[cut : cut + CHUNK + length - 1] for v in values)
            yield first, part, np.array([0, len(part[0])]), cut


def _anchor_task(unit: str, k: int, length: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = word_units if unit == "word" else byte_units
        schema = layout("h", "r1", "r2", "doc_id", "dig", "lo", "hi", "at")
        for batch in batches:
            ids, digs = batch.column("doc_id"), batch.column("dig")
            raw, offsets = buffers(batch.column("text"))
            for first, values, bounds, cut in _pieces(raw, offsets, units, length):
                doc, lo, hi, at, h, r1, r2 = pick(values, bounds, k, length)
                if len(doc):
                    rows = pa.array(doc + first)
                    yield columns(schema, h=h.view(np.int64), r1=r1.view(np.int64), r2=r2.view(np.int64), doc_id=ids.take(rows), dig=digs.take(rows), lo=lo + cut, hi=hi + cut, at=at + cut)

    return task


def fresh(keys: DataFrame, *names: str) -> DataFrame:
    """The same keys without the partitioning of the aggregate that made them.

    A join then deals both sides out anew, and only such joins are split by Spark where a key is hot.
    """
    return keys.withColumns({n: F.col(n).bitwiseXOR(F.lit(0).cast("long")) for n in names})


def shared_anchors(docs: DataFrame, unit: str, k: int, length: int, base: str) -> DataFrame:
    """Anchors whose hash occurs at two places or more, as a written table."""
    spark = docs.sparkSession
    found = scratch.save(docs.mapInArrow(trimmed(_anchor_task(unit, k, length)), ANCHOR), f"{base}/anchors")
    twice = found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    out = scratch.save(found.join(fresh(twice, "h"), "h"), f"{base}/shared")
    del found, twice
    scratch.drop(spark, f"{base}/anchors")
    scratch.release(spark)
    return out


def listed(places: DataFrame, *names: str) -> DataFrame:
    """One row per document with its distinct places; a document has no more of them than units, and equal rows have the same ones."""
    return places.groupBy(*KEY).agg(F.collect_set(F.struct(*names)).alias("places"))


def with_places(docs: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """docs with the list of their places; doc_id null joins null."""
    there = places.select(F.col("doc_id").alias("p_id"), F.col("dig").alias("p_dig"), "places")
    # the digest alone is the equi key that deals rows out; ids are compared null-safely with it
    return docs.join(there, (F.col("dig") == F.col("p_dig")) & F.col("doc_id").eqNullSafe(F.col("p_id")), how).drop("p_id", "p_dig")


def places_of(batch: pa.RecordBatch, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets per row, and the fields, of the places column."""
    lists = batch.column("places")
    off = np.concatenate([[0], np.cumsum(np.array(_lengths(lists), np.int64))]).astype(np.int64)
    flat = lists.flatten()
    return off, [flat.field(flat.type.get_field_index(n)).to_numpy(zero_copy_only=False).astype(np.int64) if len(flat) else np.zeros(0, np.int64) for n in names]


def _lengths(lists: pa.Array) -> list:
    return pc.fill_null(pc.list_value_length(lists), 0).to_pylist()


def _block_task(unit: str, length: int):
    size = BLOCK[unit]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = word_units if unit == "word" else byte_units
        schema = layout("c1", "c2", "b1", "b2", "doc_id", "dig", "lo", "hi")
        for batch in batches:
            raw, offsets = buffers(batch.column("text"))
            off, (lo, hi, at) = places_of(batch, "lo", "hi", "at")
            for first, last in spans(offsets, CHUNK):
                x, y = off[first], off[last]
                if x == y:
                    continue
                values, bounds = units(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                row = np.repeat(np.arange(last - first), np.diff(off[first : last + 1]))
                low, high, anchor = lo[x:y] + bounds[row], hi[x:y] + bounds[row], at[x:y] + bounds[row]
                one = (anchor - high) // size
                count = (anchor - low) // size - one + 1
                of = np.repeat(np.arange(len(row)), count)
                j = one[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                top = anchor[of] - size * j
                b_lo, b_hi = np.maximum(low[of], top - size + 1), np.minimum(high[of], top)
                shape = ((anchor[of] - b_lo) * (1 << 20) + (anchor[of] - b_hi)).astype(U64)
                hashes = prefixes(values)
                core = [p.runs(top, top - size + 1 + length).view(np.int64) for p in hashes]
                whole = [mix(p.runs(b_lo, b_hi + length) + shape).view(np.int64) for p in hashes]
                rows = pa.array(row[of] + first)
                start = bounds[row[of]]
                yield columns(schema, c1=core[0], c2=core[1], b1=whole[0], b2=whole[1], doc_id=batch.column("doc_id").take(rows), dig=batch.column("dig").take(rows), lo=b_lo - start, hi=b_hi - start)

    return task


def _window_task(unit: str, length: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = word_units if unit == "word" else byte_units
        schema = layout("w1", "w2", "doc_id", "dig", "s")
        for batch in batches:
            raw, offsets = buffers(batch.column("text"))
            off, (lo, hi) = places_of(batch, "lo", "hi")
            for first, last in spans(offsets, CHUNK):
                x, y = off[first], off[last]
                if x == y:
                    continue
                values, bounds = units(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                row = np.repeat(np.arange(last - first), np.diff(off[first : last + 1]))
                count = hi[x:y] - lo[x:y] + 1
                of = np.repeat(np.arange(len(row)), count)
                s = lo[x:y][of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                start = s + bounds[row[of]]
                w = [p.runs(start, start + length).view(np.int64) for p in prefixes(values)]
                rows = pa.array(row[of] + first)
                yield columns(schema, w1=w[0], w2=w[1], doc_id=batch.column("doc_id").take(rows), dig=batch.column("dig").take(rows), s=s)

    return task


def distinct_places(rows: DataFrame, keys: list[str], place: list[str]) -> DataFrame:
    """Distinct keys with their number of rows and one row's place."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in place))


def of_mixed(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Those whose keys hold more than one distinct region."""
    mixed = regions.groupBy(*keys).agg(F.count(F.lit(1)).alias("d")).filter("d > 1").select(*keys)
    return regions.join(fresh(mixed, *keys), keys)


def repeated_places(docs: DataFrame, shared: DataFrame, regions: DataFrame, unit: str, length: int, base: str) -> DataFrame:
    """(doc_id, dig, s, e) of everything that occurs elsewhere.

    regions: h, r1, r2, n and one place (doc_id, dig, lo, hi, at) for each distinct region.
    """
    spark = docs.sparkSession

    def span(low: str, high: str) -> list:
        return [*KEY, F.col(low).alias("s"), (F.col(high) + length).alias("e")]

    edges = of_mixed(regions, ["h"]).select(*PLACE)
    blocks = scratch.save(with_places(docs, listed(edges, "lo", "hi", "at"), "inner").mapInArrow(trimmed(_block_task(unit, length)), PART), f"{base}/blocks")
    scratch.release(spark)
    core, whole = ["c1", "c2"], ["c1", "c2", "b1", "b2"]
    kinds = scratch.save(distinct_places(blocks, whole, [*KEY, "lo", "hi"]), f"{base}/kinds")
    edges = of_mixed(kinds, core).select(*KEY, "lo", "hi")
    windows = scratch.save(with_places(docs, listed(edges, "lo", "hi"), "inner").mapInArrow(trimmed(_window_task(unit, length)), WINDOW), f"{base}/windows")
    scratch.release(spark)
    again = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("w1", "w2")
    # each part is written and its source dropped, so the next one finds the disk free
    from_windows = scratch.save(windows.join(fresh(again, "w1", "w2"), ["w1", "w2"]).select(*span("s", "s")), f"{base}/of_windows")
    scratch.drop(spark, f"{base}/windows")
    from_blocks = scratch.save(blocks.join(kinds.filter("n > 1").select(*whole), whole).select(*span("lo", "hi")), f"{base}/of_blocks")
    scratch.drop(spark, f"{base}/blocks", f"{base}/kinds")
    scratch.release(spark)
    from_regions = scratch.save(shared.join(regions.filter("n > 1").select("h", "r1", "r2"), ["h", "r1", "r2"]).select(*span("lo", "hi")), f"{base}/of_regions")
    scratch.drop(spark, f"{base}/shared", f"{base}/regions")
    scratch.release(spark)
    return from_regions.unionByName(from_blocks).unionByName(from_windows)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of n units that lie in any span."""
    depth = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(depth[:n]) > 0
