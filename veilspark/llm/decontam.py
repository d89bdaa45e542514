"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

DataFrame operations only. An item of n words has m = n - 4 shingles of five words (an item of
fewer words is one shingle). A window of a document is m consecutive shingles of the same kind; a
document of fewer than m shingles is one window as a whole, so that cut-off copies are met.

1. Shingles that no item has cannot count towards a match, and a window that matches at SIMILARITY
   needs at least `_least(m, k)` shingles of items of m, k being its own; its first such shingle
   lies within the first k - _least(m, k) places. Windows that miss this are never made; the rest are all made.
2. Window and item get a 64-bit SimHash over their shingles with multiplicity.
3. The fingerprint is cut into RADIUS + 1 blocks. Two fingerprints within RADIUS bits agree in one
   block at least, so an equi-join on (m, block number, block) finds all such pairs; the distance is
   then counted.
4. Pairs are verified by the weighted Jaccard similarity of the shingles themselves, a shingle's
   weight being its number of occurrences.

The item shingles are broadcast only below BROADCAST_BYTES by a count of the table; beyond that
the same join is dealt by shingle.

Defined results: words are runs of ASCII letters and digits and of characters beyond ASCII, in lower
case; null or wordless texts and items match nothing; equal rows of
documents give equal pairs once per doc_id; equal items under several ids match each; extra
columns are ignored; an empty table gives no rows; documents with a null doc_id are reported under null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

SIMILARITY, RADIUS, GRAM = 0.75, 24, 5
BROADCAST_BYTES = 64 << 20
OUTSIDE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    """Words of a short text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), OUTSIDE), lambda x: x != "")


def _shingles(words: Column, gram: Column) -> Column:
    n = F.size(words) - gram + 1
    made = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(words, i, gram), " "))
    return F.when(n > 0, made).otherwise(F.expr("cast(array() as array<string>)"))


def _least(m: Column, k: Column) -> Column:
    """Fewest shared shingles of bags of m and k with a Jaccard similarity of SIMILARITY."""
    return F.ceil((m + k) * (SIMILARITY / (1 + SIMILARITY)) - 1e-9).cast("int")


def _counted(shingles: Column, lanes: int) -> Column:
    """Sign of each bit's balance; `lanes` counters share a long."""
    n, width = 64 // lanes, 64 // lanes
    ones = F.lit(sum(1 << (width * i) for i in range(lanes)))
    zero = F.array(*[F.lit(0).cast("long") for _ in range(n)])

    def add(acc: Column, s: Column) -> Column:
        h = F.xxhash64(s)
        return F.array(*[acc[j] + F.shiftrightunsigned(h, j).bitwiseAND(ones) for j in range(n)])

    def signs(acc: Column) -> Column:
        half = F.size(shingles)
        bits = F.lit(0).cast("long")
        for j in range(n):
            for lane in range(lanes):
                ones_here = F.shiftrightunsigned(acc[j], width * lane).bitwiseAND(F.lit((1 << width) - 1))
                bits = bits.bitwiseOR(F.when(ones_here * 2 > half, F.shiftleft(F.lit(1).cast("long"), width * lane + j)).otherwise(F.lit(0).cast("long")))
        return bits

    return F.aggregate(shingles, zero, add, signs)


def _simhash(shingles: Column) -> Column:
    """64 bits; four 16-bit counters share a long, beyond 32,767 shingles two of 32 bits."""
    return F.when(F.size(shingles) < 1 << 15, _counted(shingles, 4)).otherwise(_counted(shingles, 2))


def _blocks(fingerprint: Column) -> Column:
    """(number, value) of RADIUS + 1 blocks that cover the 64 bits."""
    n = RADIUS + 1
    edges = [64 * i // n for i in range(n + 1)]
    return F.array(*[F.struct(F.lit(i).alias("i"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("v")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])


def _bag(shingles: Column) -> Column:
    """A bag as a set: each shingle with the number of its occurrence."""
    count = lambda x, i: F.size(F.filter(F.slice(shingles, 1, i + 1), lambda y: y == x))
    plain = F.transform(shingles, lambda x: F.concat(x, F.lit("\t1")))
    repeated = F.transform(shingles, lambda x, i: F.concat_ws("\t", x, count(x, i).cast("string")))
    return F.when(F.size(F.array_distinct(shingles)) == F.size(shingles), plain).otherwise(repeated)


def _matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, dig (xxhash64 of the text), item_id and the best window of each pair of a text and an item."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    items = items.withColumn("gram", F.least(F.size("w"), F.lit(GRAM)))
    items = items.select("item_id", "gram", _shingles(F.col("w"), F.col("gram")).alias("sh"))
    items = cut(items.withColumns({"m": F.size("sh"), "fp": _simhash(F.col("sh"))}))

    sizes = items.select("gram", "m", F.explode("sh").alias("s")).groupBy("gram", "s").agg(F.array_sort(F.collect_set("m")).alias("ms"))
    sizes = cut(sizes.withColumn("g", F.xxhash64(*[F.get(F.split("s", " "), F.lit(j)) for j in range(GRAM)])))
    facts = items.select("gram", "m").groupBy("gram").agg(F.max("m").alias("m")).collect()  # GRAM rows at most
    rows, total = sizes.agg(F.count(F.lit(1)), F.sum(F.length("s") + 8 * F.size("ms"))).first()
    small = (total or 0) + 64 * rows < BROADCAST_BYTES
    hits = None
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("dig"), F.split(F.lower(F.coalesce("text", F.lit(""))), OUTSIDE).alias("w"))
    # an empty first or last word, where a text starts or ends with other bytes, is in no shingle of an item or window
    for r in facts:
        gram, largest = r["gram"], r["m"]
        spare = largest - int(-(-largest * 2 * SIMILARITY // (1 + SIMILARITY)))
        # the outer form, so that the split isn't run again for a filter below the generator
        at = base.select("doc_id", "dig", "w", F.explode_outer(F.sequence(F.lit(1), F.greatest(F.size("w") - (gram - 1), F.lit(1)))).alias("p"))
        at = at.withColumn("g", F.xxhash64(*[F.get("w", F.col("p") + (j - 1)) for j in range(gram)]))
        side = sizes.filter(F.col("gram") == gram).select("g", "ms")
        reach = F.greatest(F.col("p") - spare - 1, F.lit(1))
        ends = {"n": F.size("w") - (F.element_at("w", -1) == "").cast("int"), "lead": (F.get("w", F.lit(0)) == "").cast("int")}
        around = {"from": reach, "ctx": F.slice("w", reach, spare + 1 + largest + gram), **ends}
        if small:
            hit = at.join(F.broadcast(side), "g").withColumns(around)
        else:
            # a place goes with the words that its windows may hold, never with the whole text
            hit = at.withColumns(around).drop("w").join(side, "g")
        hit = hit.select("doc_id", "dig", F.lit(gram).alias("gram"), F.explode("ms").alias("m"), "p", "from", "ctx", "n", "lead")
        hits = hit if hits is None else hits.unionByName(hit)
    if hits is None:
        return docs.limit(0).select(F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("dig"), F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("start"), F.lit(0).alias("n_words"), F.lit(0).alias("distance"), F.lit(0.0).alias("similarity"))

    # the hits of a document for one size, in order: no more of them than the document has words
    found = hits.groupBy("doc_id", "dig", "gram", "m", "n", "lead").agg(F.array_sort(F.collect_set("p")).alias("ps"), F.array_sort(F.collect_set(F.struct("p", "from", "ctx"))).alias("cs"))
    # k: shingles of a window, m or all that the document has
    found = found.withColumn("k", F.least(F.col("m"), F.col("n") - F.col("lead") - F.col("gram") + 1))
    found = found.withColumn("least", _least(F.col("m"), F.col("k"))).filter(F.size("ps") >= F.col("least"))
    # the r-th hit as a window's first one: starts that reach the least-th hit from it and not the hit before
    ps = F.col("ps")

    def starts(c: Column, r: Column) -> Column:
        last_needed = F.get(ps, r + F.col("least") - 1)
        low = F.greatest(last_needed - F.col("k") + 1, F.when(r > 0, F.get(ps, r - 1) + 1).otherwise(F.lit(1)), F.col("lead") + 1)
        high = F.least(c["p"], F.col("n") - F.col("gram") - F.col("k") + 2)
        return F.struct(F.when(last_needed.isNotNull(), low).alias("low"), high.alias("high"), c["from"].alias("from"), c["ctx"].alias("ctx"))

    made = F.filter(F.transform("cs", starts), lambda x: x["low"].isNotNull() & (x["low"] <= x["high"]))
    first = found.select("doc_id", "dig", "gram", "m", "k", "lead", F.explode(made).alias("c"))
    window = first.select("doc_id", "dig", "gram", "m", "k", "lead", F.explode(F.sequence("c.low", "c.high")).alias("s"), F.col("c.from").alias("from"), F.col("c.ctx").alias("ctx"))
    own = F.slice("ctx", F.col("s") - F.col("from") + 1, F.col("k") + F.col("gram") - 1)
    window = window.select("doc_id", "dig", "gram", "m", "lead", "s", _shingles(own, F.col("gram")).alias("sh")).withColumn("fp", _simhash(F.col("sh")))

    wb = window.select("doc_id", "dig", "gram", "m", "lead", "s", "sh", "fp", F.explode(_blocks(F.col("fp"))).alias("b")).select("*", "b.i", "b.v").drop("b")
    ib = items.select("item_id", "gram", "m", F.col("sh").alias("ish"), F.col("fp").alias("ifp"), F.explode(_blocks(F.col("fp"))).alias("b")).select("*", "b.i", "b.v").drop("b")
    pairs = wb.join(ib, ["gram", "m", "i", "v"])
    pairs = pairs.withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp")))).filter(F.col("distance") <= RADIUS)
    # a pair that agrees in several blocks counts once; only what is left here is verified
    found = [F.first(c).alias(c) for c in ("lead", "distance", "sh", "ish")]
    pairs = pairs.groupBy("doc_id", "dig", "gram", "m", "s", "item_id").agg(*found)
    shared = F.size(F.array_intersect(_bag(F.col("sh")), _bag(F.col("ish"))))
    pairs = pairs.withColumn("similarity", shared / (F.col("m") + F.size("sh") - shared)).filter(F.col("similarity") >= SIMILARITY)
    best = F.max(F.struct("similarity", (-F.col("distance")).alias("near"), (F.col("lead") - F.col("s")).alias("at"), F.size("sh").alias("k"))).alias("b")
    return pairs.groupBy("doc_id", "dig", "item_id", "gram", "m").agg(best).select(
        "doc_id", "dig", "item_id", (-F.col("b.at") - 1).alias("start"), (F.col("b.k") + F.col("gram") - 1).alias("n_words"), (-F.col("b.near")).alias("distance"), F.col("b.similarity").alias("similarity")
    )


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start (word of the window), n_words, distance and similarity of each match's best window."""
    best = F.max(F.struct("similarity", (-F.col("distance")).alias("near"), (-F.col("start")).alias("at"), "n_words")).alias("b")
    return _matches(docs, benchmark).groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("b.at")).alias("start"), F.col("b.n_words").alias("n_words"), (-F.col("b.near")).alias("distance"), F.col("b.similarity").alias("similarity")
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no window of an item, whatever rows share their doc_id."""
    hit = _matches(docs, benchmark).select(F.col("doc_id").alias("_hit"), F.col("dig").alias("_dig")).distinct()
    same = (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col("_dig")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_hit"))
    return docs.join(hit, same, "left_anti")
