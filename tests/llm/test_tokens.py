from __future__ import annotations

import random

import pytest

from tessera.llm.packing import fill_rates, first_fit_decreasing, pack_documents
from tessera.llm.tokens import decode, encoder, token_ids

PARTS = ["don't", "we've", " can't", "'re", "'", "'l", "ab", "的", "  ", "\n\n", "12", "?!", "é", " x", "\t", "I'll", "🎬", "<|endoftext|>"]


@pytest.mark.parametrize("chunk,overlap", [(64, 32), (200, 50), (17, 16)])
def test_chunks_equal_whole_texts(spark, chunk, overlap):
    rng = random.Random(chunk)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.choice([0, 3, 30, 600]))) for _ in range(40)]
    texts += [None, "", "a" * 700, " " * 900, "x " * 300 + "b" * 400 + " y" * 200, "\n" * 500 + "z"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in token_ids(df, "doc_id", "text", chunk=chunk, overlap=overlap).collect()}
    enc = encoder()
    assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert all(decode(got[i]) == (t or "") for i, t in enumerate(texts))


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "abc def"), (1, "abc def"), (2, "x " * 60), (2, "x " * 60)], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in token_ids(df, "doc_id", "text", chunk=40, overlap=16).collect()) == [1, 1, 2, 2]
    assert token_ids(df.limit(0), "doc_id", "text").collect() == []


def test_first_fit_decreasing():
    rng = random.Random(1)
    sizes = sorted((rng.randrange(0, 101) for _ in range(400)), reverse=True)
    room, want = [], []
    for s in sizes:
        at = next((i for i, r in enumerate(room) if r >= s), len(room))
        room += [100] if at == len(room) else []
        room[at] -= s
        want.append(at)
    assert first_fit_decreasing(sizes, 100) == want and first_fit_decreasing([], 5) == []


def test_packing_is_whole(spark):
    rng = random.Random(6)
    rows = [(i, " a" * rng.choice([0, 1, 5, 9, 10, 11, 25, 40])) for i in range(120)] + [(900, None), (901, ""), (5, " a" * 3)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, piece_no string")
    caps = spark.createDataFrame([(1, "s", 10), (2, "m", 30), (3, "bad", None), (4, "bad", 0)], "capacity_id int, container_kind string, capacity_tokens int")
    placed = pack_documents(docs, caps, group_items=40)
    out = placed.toPandas()
    assert set(out.capacity_id) == {1, 2} and (out.groupby(["capacity_id", "container_id"]).piece_tokens.sum() <= out.groupby(["capacity_id", "container_id"]).capacity_tokens.first()).all()
    tokens = sum(len(t or "") // 2 for _, t in rows)
    assert (out.groupby("capacity_id").piece_tokens.sum() == tokens).all() and (out.groupby("capacity_id").doc_id.nunique() == 122).all()
    cut = out[out.groupby(["capacity_id", "doc_id"]).piece_no.transform("max") > 1]
    assert (cut[cut.doc_id != 5].groupby(["capacity_id", "doc_id"]).piece_tokens.sum() > cut[cut.doc_id != 5].groupby(["capacity_id", "doc_id"]).capacity_tokens.first()).all()
    assert {r.capacity_id: r.tokens for r in fill_rates(placed).collect()} == {1: tokens, 2: tokens}
    assert pack_documents(docs.limit(0), caps).collect() == []
