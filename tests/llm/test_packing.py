"""Packing against a plain best fit, lossless round trips, defined cases."""

import numpy as np
import pytest

from maskwright.llm import bpe, packing


def plain(lengths, most):
    room, rows = [], []
    for place in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        fits = [(r, since, k) for k, (r, since) in enumerate(room) if r >= lengths[place]]
        if fits:
            k = min(fits)[2]
        else:
            k = len(room)
            room.append((most, 0))
            rows.append([])
        rows[k].append(place)
        room[k] = (room[k][0] - lengths[place], len(rows) + sum(map(len, rows)) * 10**6)
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    most = int(rng.integers(3, 60))
    lengths = rng.integers(1, most + 1, 300)
    got = packing.best_fit_decreasing(lengths, most)
    assert got == plain(lengths.tolist(), most)
    assert sorted(p for r in got for p in r) == list(range(300)) and all(lengths[r].sum() <= most for r in got)


def test_pieces():
    doc, start, length = packing.cut(np.array([0, 5, 4, 9, 0, 1]), 4)
    assert list(zip(doc, start, length)) == [(1, 0, 4), (1, 4, 1), (2, 0, 4), (3, 0, 4), (3, 4, 4), (3, 8, 1), (5, 0, 1)]


@pytest.mark.parametrize("row,shard", [(2048, 1 << 21), (64, 5000)])
def test_round_trip(spark, sf, row, shard):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    packed = packing.pack(docs, bpe.default_path(), row, shard)
    rows = packed.collect()
    codec = bpe.Codec(bpe.read_vocabulary(bpe.default_path()))
    want = {r.doc_id: codec.encode(r.text or "") for r in docs.collect()}
    back = {}
    for r in packing.unpack(packed, row).collect():
        back.setdefault(r.doc_id, {})[r.start] = list(r.ids)
    assert {d: sum((x for _, x in sorted(p.items())), []) for d, p in back.items()} == {d: i for d, i in want.items() if i}
    for r in rows:
        assert len(r.ids) == 2 * row and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= row
        assert r.reset_at == r.cu_seqlens[:-1] and len(r.reset_to) == len(r.doc_ids) == len(r.reset_at)
        assert not any(r.ids[2 * r.n_tokens :])
    filled = sum(r.n_tokens for r in rows) / (row * len(rows))
    assert filled > 0.9
    assert len({(r.shard, r.row) for r in rows}) == len(rows)


def test_defined_cases(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "to be or not", 0), (3, "to be or not", 0), (None, "to be", 0), (5, "to be " * 5_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").coalesce(1)
    got = packing.unpack(packing.pack(docs, bpe.default_path(), 100, 50), 100).collect()
    assert sorted((str(r.doc_id), len(r.ids)) for r in got) == sorted([("3", 4), ("3", 4), ("None", 2)] + [("5", 100)] * 100)
    assert packing.pack(docs.limit(0), bpe.default_path()).count() == 0
    assert packing.pack(docs.filter("doc_id < 3"), bpe.default_path()).count() == 0
