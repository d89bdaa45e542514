"""Near-duplicate components by SetSketch registers, likelihood estimates and exact verification.

Sketch: register i holds a truncated minimum on an exponential scale: the smallest of the set's
hashes in that register as an Exp(A) variate x, stored as floor(1 - log_B x) within 0..Q + 1. Registers
of a union are the maxima of the parts' registers, so sketches merge. Equal registers are about as
likely as the Jaccard similarity is high.

1. Documents with equal shingle sets form a class, a node.
2. BANDS bands of ROWS registers each put nodes into buckets. In each bucket a hub (the member that
   shares most buckets) is paired with every other member: pairs grow with the members, not
   with their square.
3. Pairs are estimated jointly by likelihood from both sketches and set sizes; those that could
   reach the threshold are verified on the full sets of both texts.
4. Links give components. Where a bucket's members still lie in several components, its largest
   component is dealt into blocks and so is the rest; each block of the rest meets each block of the
   largest component, and of the rest, in one task, which counts shared shingles of all pairs as a
   product of 0/1 matrices and gives a spanning forest of the links. So no pair is written out, no link
   that matters is lost, and rows grow with the members times the blocks of the smaller side.

Shingles are two independent 64-bit hashes; both must agree where sets are compared. Components come
from rounds of smallest neighbouring labels with pointer jumping, each a written table.

Defined results: null or wordless texts have no shingles and are linked with nothing; with fewer
words than a shingle has, the whole sequence is one; rows with the same doc_id lie in one
component, each with its own links; a null doc_id is its own component (null), linked with nothing
and kept; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .textcore import BASES, LOWER, Prefix, buffers, mix, spans, trimmed, word_hashes, words

GRAM = 5
REGISTERS, BANDS, ROWS = 256, 64, 6
B, A, Q = 1.001, 20.0, (1 << 16) - 2
#: Standard errors below the threshold at which an estimate still lets a pair pass.
SIGMAS = 5.0
CHUNK = 1 << 17
#: Members, and shingles, of a block; columns of a matrix.
BLOCK, WEIGHT, WIDE = 256, 1 << 19, 4096
U64, U32 = np.uint64, np.uint32
SKETCH = "doc_id long, dig long, n long, c1 long, c2 long, sketch binary, bands array<long>"


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, second hashes, offsets): each document's distinct shingles, sorted."""
    low = LOWER[raw]
    starts, ends, bounds = words(low, offsets)
    n = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, U64), np.zeros(0, U64), np.zeros(n + 1, np.int64)
    size = np.diff(bounds)
    count = np.where(size >= GRAM, size - GRAM + 1, (size > 0).astype(np.int64))
    off = np.concatenate([[0], np.cumsum(count)])
    begin = np.repeat(bounds[:-1] - off[:-1], count) + np.arange(off[-1])
    end = begin + np.repeat(np.minimum(size, GRAM), count)
    h, h2 = (Prefix(word_hashes(low, starts, ends, i), base).runs(begin, end) for i, base in enumerate(BASES))
    doc = np.repeat(np.arange(n), count)
    order = np.lexsort((h, doc))
    h, h2, doc = h[order], h2[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1]) | (doc[1:] != doc[:-1])
    return h[new], h2[new], np.searchsorted(doc[new], np.arange(n + 1))


def _seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(salt))


def registers(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """SetSketch registers (documents x REGISTERS, 16 bits); rows without shingles are 0."""
    n = len(off) - 1
    out = np.zeros((n, REGISTERS), np.uint16)
    full = np.flatnonzero(np.diff(off) > 0)
    if not len(full):
        return out
    x = (mix(h ^ U64(0x5851F42D4C957F2D)) >> U64(32)).astype(U32)
    factor, shift = (_seeds(REGISTERS, 1) >> U64(32)).astype(U32) | U32(1), (_seeds(REGISTERS, 2) >> U64(32)).astype(U32)
    least = np.empty((len(full), REGISTERS), U32)
    at = off[:-1][full]
    buffer = np.empty_like(x)
    for i in range(REGISTERS):
        np.bitwise_xor(x, shift[i], out=buffer)
        np.multiply(buffer, factor[i], out=buffer)
        least[:, i] = np.minimum.reduceat(buffer, at)
    u = (least.astype(np.float64) + 0.5) / 2.0**32
    value = np.floor(1.0 - np.log(-np.log1p(-u) / A) / np.log(B))
    out[full] = np.clip(value, 0, Q + 1).astype(np.uint16)
    return out


def bands(k: np.ndarray) -> np.ndarray:
    """Band hashes; register j * REGISTERS / BANDS + step * (odd stride) serves row `step` of band j."""
    stride = REGISTERS // ROWS | 1
    out = np.empty((len(k), BANDS), U64)
    for j in range(BANDS):
        acc = np.full(len(k), U64(j + 1), U64)
        for r in range(ROWS):
            acc = mix(acc * U64(0x9E3779B97F4A7C15) + k[:, (j * REGISTERS // BANDS + r * stride) % REGISTERS].astype(U64))
        out[:, j] = acc
    return out


def _sketch_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = buffers(batch.column("text"))
        for first, last in spans(offsets, CHUNK * 6):
            h, h2, off = shingle_sets(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            k = registers(h, off)
            n = np.diff(off)
            sums = [np.concatenate([[U64(0)], np.cumsum(mix(x ^ s))]) for x, s in zip((h, h2), _seeds(2, 3), strict=True)]
            c1, c2 = ((s[off[1:]] - s[off[:-1]]).view(np.int64) for s in sums)
            some = n > 0
            per = np.where(some, BANDS, 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(first, last - first),
                    batch.column("dig").slice(first, last - first),
                    pa.array(n, pa.int64()),
                    pa.array(c1),
                    pa.array(c2),
                    pa.array([x.tobytes() for x in k], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), pa.array(bands(k[some]).view(np.int64).reshape(-1))),
                ],
                names=["doc_id", "dig", "n", "c1", "c2", "sketch", "bands"],
            )


def estimate(k1: np.ndarray, k2: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs, from how many registers of each are larger and the set sizes."""
    more, fewer = (k1 > k2).sum(axis=1), (k1 < k2).sum(axis=1)
    even = k1.shape[1] - more - fewer
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    top = np.minimum(n1, n2) / np.maximum(n1, n2)
    base = np.log(B)

    def p(x):
        return -np.log(np.clip(1.0 - np.clip(x, 0, 1) * (B - 1) / B, 1e-12, 1)) / base

    best, value = np.zeros(len(u)), np.full(len(u), -np.inf)
    low, high = np.zeros(len(u)), top
    for _ in range(3):  # ever finer grids around the best point
        grid = low[:, None] + (high - low)[:, None] * np.linspace(0, 1, 25)[None, :]
        a, b = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
        like = more[:, None] * np.log(a + 1e-9) + fewer[:, None] * np.log(b + 1e-9) + even[:, None] * np.log(np.clip(1 - a - b, 1e-9, 1))
        j = np.argmax(like, axis=1)
        rows = np.arange(len(u))
        best, value = grid[rows, j], like[rows, j]
        step = (high - low) / 24
        low, high = np.maximum(best - step, 0), np.minimum(best + step, top)
    return best


def _floor(similarity: float) -> float:
    return similarity - SIGMAS * np.sqrt(similarity * (1 - similarity) / REGISTERS)


def _estimate_task(similarity: float):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = _floor(similarity)
        for batch in batches:
            if not batch.num_rows:
                continue
            k = [np.frombuffer(buffers(batch.column(c))[0].tobytes(), np.uint16).reshape(-1, REGISTERS) for c in ("k1", "k2")]
            n = [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n1", "n2")]
            keep = np.flatnonzero(estimate(*k, *n) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep)), batch.column("b").take(pa.array(keep))], names=["a", "b"])

    return task


def _verify_task(percent: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(0, batch.num_rows, 256):
                (x, x2, xo), (y, y2, yo) = (shingle_sets(*buffers(batch.column(c).slice(i, 256))) for c in ("t1", "t2"))
                for r in range(len(xo) - 1):
                    a, b = slice(xo[r], xo[r + 1]), slice(yo[r], yo[r + 1])
                    na, nb = xo[r + 1] - xo[r], yo[r + 1] - yo[r]
                    if 100 * min(na, nb) < percent * max(na, nb):
                        continue
                    _, p, q = np.intersect1d(x[a], y[b], assume_unique=True, return_indices=True)
                    shared = int((x2[a][p] == y2[b][q]).sum())
                    if shared and 100 * shared >= percent * (na + nb - shared):
                        keep.append(i + r)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], names=["a", "b"])

    return task


def forest(h: np.ndarray, h2: np.ndarray, off: np.ndarray, part: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets of different parts, from the shared shingles of all pairs."""
    m, size = len(off) - 1, np.diff(off)
    doc = np.repeat(np.arange(m), size)
    order = np.lexsort((h2, h))
    x, y, doc = h[order], h2[order], doc[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    column = np.cumsum(new) - 1
    # a shingle of one set alone is shared by no pair
    often = np.bincount(column, minlength=1)[column] > 1
    column, doc = np.unique(column[often], return_inverse=True)[1], doc[often]
    shared = np.zeros((m, m), np.float64)
    edges = np.searchsorted(column, np.arange(0, (int(column[-1]) + 1 if len(column) else 0) + WIDE, WIDE))
    for i, (a, b) in enumerate(zip(edges, edges[1:])):  # noqa: B905
        block = np.zeros((m, WIDE), np.float32)
        block[doc[a:b], column[a:b] - i * WIDE] = 1
        shared += block @ block.T
    linked = (100 * shared >= percent * (size[:, None] + size[None, :] - shared)) & (shared > 0) & (part[:, None] != part[None, :])
    out, seen = [], np.zeros(m, bool)
    for first in np.flatnonzero(linked.any(axis=1)).tolist():
        todo = [] if seen[first] else [first]
        seen[first] = True
        while todo:
            at = todo.pop()
            near = np.flatnonzero(linked[at] & ~seen).tolist()
            seen[near] = True
            out += [(at, other) for other in near]
            todo += near
    return out


def _block_task(percent: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links within each group of rows, which come one after another."""
        group, ids, parts, texts = None, [], [], []

        def links() -> pa.RecordBatch:
            found = forest(*shingle_sets(*buffers(pa.array(texts, pa.binary()))), np.array(parts, np.int64), percent)
            a, b = [ids[i] for i, _ in found], [ids[j] for _, j in found]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for g, i, part, text in zip(*(batch.column(c).to_pylist() for c in ("g", "nid", "label", "text")), strict=True):
                if g != group:
                    if len(set(parts)) > 1:
                        yield links()
                    group, ids, parts, texts = g, [], [], []
                ids.append(i)
                parts.append(part)
                texts.append(text)
        if len(set(parts)) > 1:
            yield links()

    return task


def components(links: DataFrame, base: str) -> DataFrame:
    """(id, label): the smallest id that each linked id reaches, from links (a, b).

    Every id takes the smallest label of its neighbours and then that label's own label, so chains
    shorten by half a round; a round is a written table, and the last one changes nothing.
    """
    spark = links.sparkSession
    flat = links.filter("a <> b").select("a", "b")
    edges = scratch.save(flat.union(flat.select("b", "a")).distinct().toDF("u", "v"), f"{base}/edges")
    now = scratch.save(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).select(F.col("u").alias("id"), "label"), f"{base}/0")
    step = 0
    while True:
        step += 1
        near = edges.join(now.select(F.col("id").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("least"))
        pulled = now.join(near, now["id"] == near["u"]).select("id", F.col("label").alias("old"), F.least("label", "least").alias("mid"))
        jump = now.select(F.col("id").alias("mid"), F.col("label").alias("far"))
        new = pulled.join(jump, "mid").select("id", F.least("mid", "far").alias("label"), (F.least("mid", "far") != F.col("old")).alias("moved"))
        new = scratch.save(new, f"{base}/{step}")
        if not new.filter("moved").limit(1).count():
            return new.select("id", "label")
        now = new.select("id", "label")


def _pairs_within(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links among pairs (a, b): estimated, then verified."""
    side = nodes.select("nid", "n", "sketch")
    told = pairs.join(side.select(F.col("nid").alias("a"), F.col("n").alias("n1"), F.col("sketch").alias("k1")), "a")
    told = told.join(side.select(F.col("nid").alias("b"), F.col("n").alias("n2"), F.col("sketch").alias("k2")), "b")
    told = told.filter(F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * percent)
    likely = told.select("a", "b", "n1", "n2", "k1", "k2").mapInArrow(trimmed(_estimate_task(percent / 100)), "a long, b long")
    full = likely.join(texts.select(F.col("nid").alias("a"), F.col("text").alias("t1")), "a")
    full = full.join(texts.select(F.col("nid").alias("b"), F.col("text").alias("t2")), "b")
    return full.select("a", "b", "t1", "t2").mapInArrow(trimmed(_verify_task(percent)), "a long, b long")


def _apart(members: DataFrame, nodes: DataFrame, found: DataFrame, texts: DataFrame, percent: int, base: str) -> DataFrame:
    """Links between members of one bucket that lie in different components so far."""
    spark = members.sparkSession
    where = members.select("band", "nid").join(found.select(F.col("id").alias("nid"), "label"), "nid", "left").withColumn("label", F.coalesce("label", "nid"))
    where = scratch.save(where.join(nodes.select("nid", "n"), "nid"), f"{base}/where")
    split = where.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("band")
    open_ = scratch.save(where.join(split, "band"), f"{base}/open")
    # the largest component of each bucket, and the sizes of both sides
    sized = open_.groupBy("band", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"), F.bit_xor(F.xxhash64("nid")).alias("x"), F.bit_xor(F.xxhash64("nid", F.lit(1))).alias("y"))
    top = F.max(F.struct("c", "label", "w"))
    plan = sized.groupBy("band").agg(top.alias("top"), F.sum("c").alias("c"), F.sum("w").alias("w"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    blocks = lambda c, w: F.greatest(F.ceil(c / BLOCK), F.ceil(w / WEIGHT), F.lit(1)).cast("long")
    plan = plan.select("band", "c", "x", "y", F.col("top.label").alias("main"), blocks(F.col("top.c"), F.col("top.w")).alias("p"), blocks(F.col("c") - F.col("top.c"), F.col("w") - F.col("top.w")).alias("q"))
    # buckets with the same members count once
    plan = plan.groupBy("c", "x", "y").agg(F.min_by(F.struct("band", "main", "p", "q"), "band").alias("b")).select("b.*")
    dealt = open_.join(plan, "band")
    own = F.pmod(F.xxhash64("nid", F.lit(2)), F.when(F.col("label") == F.col("main"), F.col("p")).otherwise(F.col("q")))
    dealt = dealt.withColumn("own", own)
    to = lambda side, x, y: F.xxhash64(F.col("band"), F.lit(side), x, y)
    last = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    main = F.transform(last(F.col("q")), lambda j: to(0, F.col("own"), j))
    rest = F.transform(last(F.col("p")), lambda j: to(0, j, F.col("own")))
    among = F.when(F.col("q") > 1, F.transform(last(F.col("q")), lambda j: to(1, F.least(F.col("own"), j), F.greatest(F.col("own"), j)))).otherwise(F.expr("cast(array() as array<bigint>)"))
    groups = F.when(F.col("label") == F.col("main"), main).otherwise(F.concat(rest, among))
    rows = dealt.select("nid", "label", F.explode(groups).alias("g")).join(texts, "nid")
    rows = rows.repartition(scratch.partitions(spark), "g").sortWithinPartitions("g")
    return rows.select("g", "nid", "label", "text").mapInArrow(trimmed(_block_task(percent)), "a long, b long")


def label(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, dig (xxhash64 of the text), n_shingles, component_id and kept of each row of docs."""
    spark = docs.sparkSession
    base = scratch.folder(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("dig"), text.cast("binary").alias("text"))
    sketched = scratch.save(rows.mapInArrow(trimmed(_sketch_task), SKETCH).withColumn("rid", F.monotonically_increasing_id()), f"{base}/sketches")

    linkable = sketched.filter("n > 0 AND doc_id IS NOT NULL")
    classes = linkable.groupBy("c1", "c2", "n").agg(F.min(F.struct("doc_id", "dig", "rid")).alias("r"))
    classes = classes.select("c1", "c2", "n", "r.*").withColumn("nid", F.monotonically_increasing_id())
    # written, so the numbers stay
    classes = scratch.save(classes, f"{base}/classes")
    nodes = sketched.select("rid", "sketch", "bands").join(classes.select("rid", "nid", "n", "doc_id", "dig"), "rid")
    nodes = scratch.save(nodes, f"{base}/nodes")
    scratch.release(spark)

    placed = nodes.select("nid", F.explode("bands").alias("band"))
    crowded = placed.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = scratch.save(placed.join(crowded, "band"), f"{base}/members")
    scratch.release(spark)
    weight = members.groupBy("nid").agg(F.sum("size").alias("weight"))
    hubs = members.join(weight, "nid").groupBy("band").agg((-F.max(F.struct("weight", (-F.col("nid")).alias("c")))["c"]).alias("hub"))
    stars = members.join(hubs, "band").filter("nid <> hub").select(F.least("nid", "hub").alias("a"), F.greatest("nid", "hub").alias("b")).distinct()
    stars = scratch.save(stars, f"{base}/stars")
    needed = weight.join(nodes.select("nid", "doc_id", "dig"), "nid").select("nid", F.col("doc_id").alias("i"), F.col("dig").alias("d"))
    texts = rows.join(needed, (F.col("doc_id") == F.col("i")) & (F.col("dig") == F.col("d"))).select("nid", "text").dropDuplicates(["nid"])
    texts = scratch.save(texts, f"{base}/texts")
    scratch.release(spark)
    # rows of one doc_id with different sets
    of_row = sketched.select("doc_id", "dig", "n", "c1", "c2").join(classes.select("c1", "c2", "n", "nid"), ["c1", "c2", "n"], "left").select("doc_id", "dig", "n", "nid")
    of_row = scratch.save(of_row.withColumn("nid", F.when(F.col("doc_id").isNotNull(), F.col("nid"))), f"{base}/rows")
    several = of_row.filter("nid IS NOT NULL").groupBy("doc_id").agg(F.min("nid").alias("a"), F.max("nid").alias("z")).filter("a <> z").select("doc_id", "a")
    same = of_row.join(several, "doc_id").filter("nid <> a").select("a", F.col("nid").alias("b"))
    links = scratch.save(_pairs_within(stars, nodes, texts, percent).unionByName(same), f"{base}/links")
    scratch.release(spark)
    found = components(links, f"{base}/first")
    more = scratch.save(_apart(members, nodes, found, texts, percent, base), f"{base}/more")
    scratch.release(spark)
    final = components(links.union(more), f"{base}/last") if more.limit(1).count() else found

    # the smallest doc_id of each component
    at = scratch.save(classes.select("nid", F.col("doc_id").alias("low")).join(final.select(F.col("id").alias("nid"), "label"), "nid", "left").withColumn("label", F.coalesce("label", "nid")), f"{base}/at")
    lowest = at.groupBy("label").agg(F.min("low").alias("low"))
    of_node = at.select("nid", "label").join(lowest, "label").select("nid", "low")
    out = of_row.join(of_node, "nid", "left").withColumn("component_id", F.coalesce("low", "doc_id"))
    return out.select("doc_id", "dig", F.col("n").alias("n_shingles"), "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The row with the smallest doc_id of each component, with the columns of docs.

    Of different texts under that doc_id the one with the smallest digest stays (equal rows are a case
    for exact dedup and stay); rows with a null doc_id stay.
    """
    kept = label(docs, percent).filter("kept AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_kept")).agg(F.min("dig").alias("_dig"))
    names = {"_text": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))}
    own = docs.join(kept, (F.col("doc_id").cast("long") == F.col("_kept")) & (names["_text"] == F.col("_dig")), "left_semi")
    return own.unionByName(docs.filter("doc_id IS NULL"))
