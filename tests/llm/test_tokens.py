"""Token files round trip; packing holds every id once."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veilspark.llm import packing, rans, scratch, tokenids
from veilspark.llm.encoding import encoder

from .common import ODD, documents, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def rows(spark, small):
    return documents(spark, small, 80) + ODD + [(7000 + i, f"short {i}") for i in range(40)]


def plain(texts, end):
    t = Tokenizer.from_file(PATH)
    return [np.array([*e.ids, end], "<u4") for e in t.encode_batch(texts, add_special_tokens=False)]


PARTS = ["ab", "b", "1", "²", " ", " ", "  ", "\n", "\n\n", "\t", "'", "'s", "'re", "!", ".,", "é", "É", "\x1c", "\x85", "\xa0", "_", "<|endoftext|>", "<|endof", "世", "😀", "\u0301", "\ufeff"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), max_size=4))
def test_pieces_encode_like_whole_texts(texts):
    assert encoder(PATH).encode(pa.array([*texts, None], pa.string())) == [x[:-1].tobytes() for x in plain([*texts, ""], 0)]


def test_end_marks_in_texts_are_the_librarys_ids():
    ids = np.frombuffer(encoder(PATH).encode(pa.array(["a <|endoftext|> b"]))[0], "<u4")
    assert ids.tolist() == Tokenizer.from_file(PATH).encode("a <|endoftext|> b", add_special_tokens=False).ids and 50256 in ids


def test_old_pieces_are_forgotten_and_found_again(monkeypatch):
    from veilspark.llm import encoding

    monkeypatch.setattr(encoding, "KEEP", 50)
    own = encoding.Encoder(PATH)
    texts = [" ".join(f"w{i * 7 % 300}.{i}" for i in range(a, a + 40)) for a in range(0, 600, 20)]
    for t in texts * 2:
        assert own.encode(pa.array([t])) == [x[:-1].tobytes() for x in plain([t], 0)]


def test_files_give_the_ids_back(spark, rows):
    path = scratch.folder(spark)
    tokenids.write(frame(spark, rows), PATH, path)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    ids = plain([t or "" for _, t in order], 0)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    want = sorted(((i, int(s), len(x), zlib.crc32(x.tobytes())) for (i, _), s, x in zip(order, starts, ids)), key=str)
    assert sorted(map(tuple, tokenids.read(spark, path, digest=True).collect()), key=str) == want
    assert sorted(sum((r["ids"] for r in tokenids.read(spark, path).collect()), [])) == sorted(np.concatenate(ids).tolist())


def test_empty_tables(spark):
    path = scratch.folder(spark)
    tokenids.write(frame(spark, []), PATH, path)
    assert tokenids.read(spark, path).count() == 0
    assert packing.pack_documents(frame(spark, []), PATH).count() == 0


@pytest.mark.parametrize("n", [1, 31, 32, 33, 8192, 16384])
def test_blocks_decode_from_any_checkpoint(n):
    rnd = np.random.default_rng(n)
    ids = rnd.zipf(1.3, n) % 5000
    table = rans.Table.fit(np.bincount(ids, minlength=5000))
    assert int(table.freq.sum()) == 1 << rans.BITS
    block = rans.encode([ids], table)
    for mark in range(len(block[0]["at"])):
        assert (rans.decode(block, table, mark)[0] == ids[mark * rans.EVERY * rans.LANES :]).all()
    broken = [block[0] | {"states": b"\1" + block[0]["states"][1:]}]
    with pytest.raises(ValueError, match="checksum"):
        rans.decode(broken, table)


def test_packing_holds_each_id_once(spark, rows):
    ids = {}
    for (i, _), x in zip(rows, plain([t or "" for _, t in rows], 1)):
        ids.setdefault(i, []).append(x)
    got = packing.pack_documents(frame(spark, rows), PATH, capacity=512, digest=True).collect()
    windows, sizes = {}, {}
    for r in got:
        assert any(len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
    assert sizes == {i: sum(map(len, x)) for i, x in ids.items()}
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at and length > 0
            at += length
        assert at <= 512


def test_differencing_is_near_equal_and_windows_rise():
    rnd = random.Random(7)
    sizes = [rnd.randrange(1, 500) for _ in range(200)]
    groups = packing.differencing(sizes, 20)
    assert sorted(x for g in groups for x in g) == list(range(200))
    sums = [sum(sizes[x] for x in g) for g in groups]
    assert max(sums) - min(sums) <= 10
    whole = packing.pack([60] * 10, 100, 6, cut=False)
    assert len(whole) == 10 and all(len(w) == 1 for w in whole)
    assert packing.differencing([], 3) == [[], [], []]


@pytest.mark.parametrize("m", [1, 6, 60])
def test_cuts_are_few_and_windows_full(m):
    rnd = random.Random(m)
    sizes = [rnd.randrange(1, 101) for _ in range(40)]
    windows = packing.pack(sizes, 100, m)
    assert len(windows) <= max(m, -(-sum(sizes) // 100)) and all(sum(x[2] for x in w) <= 100 for w in windows)
    parts = sorted(x for w in windows for x in w)
    assert len(parts) <= len(sizes) + 2 * len(windows)
    for i, size in enumerate(sizes):
        at = 0
        for _, start, length in (p for p in parts if p[0] == i):
            assert start == at and length > 0
            at += length
        assert at == size


def test_little_padding(spark, rows):
    many = [(i, f"{t or ''} {i}") for i, (_, t) in enumerate(rows * 12)]
    got = packing.pack_documents(frame(spark, many, 1), PATH).collect()
    ids = sum(r["length"] for r in got)
    windows = len({r["sequence_id"] for r in got})
    assert windows * 2048 - ids <= 0.01 * ids + 2048
    assert len(got) <= len(many) + 2.5 * windows
