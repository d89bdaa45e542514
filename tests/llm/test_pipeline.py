"""The stages against plain versions of each, on the smallest tables."""

from collections import defaultdict

import corpus_pipeline as P

from .common import components, frame
from .test_scans import leaks


def rows_of(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    clean = P.drop_toxic(spark, docs, small)
    assert clean.columns == columns
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{small}/labels.parquet").filter("toxic = 1").collect()}
    gone = {i for i, _ in rows_of(docs)} - {i for i, _ in rows_of(clean)}
    assert gone and len(gone - toxic) <= 0.05 * docs.count()

    single = P.drop_copies(spark, clean, small)
    last = {}
    for i, t in rows_of(clean):
        last[t] = max(i, last.get(t, i))
    assert single.columns == columns and rows_of(single) == sorted((i, t) for t, i in last.items())

    one = P.drop_near_copies(spark, single, small)
    kept = {c for _, c in components(rows_of(single)).values()}
    assert one.columns == columns and [i for i, _ in rows_of(one)] == sorted(kept)

    safe = P.drop_leaks(spark, one, small)
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {i for i, _ in leaks(rows_of(one), items)}
    assert bad and safe.columns == columns and [i for i, _ in rows_of(safe)] == sorted(kept - bad)

    packed = P.pack(spark, safe, small).collect()
    windows = defaultdict(int)
    for r in packed:
        windows[r["sequence_id"]] += r["length"]
    assert {r["doc_id"] for r in packed} == kept - bad and max(windows.values()) <= 2048


def test_empty(spark, small):
    empty = frame(spark, []).select("doc_id", "text", "lang")
    for _, stage in P.STAGES[:-1]:
        empty = stage(spark, empty, small)
        assert empty.count() == 0
    assert P.pack(spark, empty, small).count() == 0
