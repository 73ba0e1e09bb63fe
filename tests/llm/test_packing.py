import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sparkpact.llm import packing as P

from .helpers import frame, odd_documents

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


ODD = ["don't stop, it's I'LL", "dogs', x", "É, x! é̈. ́, x", "<|endoftext|>, A<|startoftext|>. <|ENDOFTEXT|>", "K, ſ. İ, Σ. ΑΣ, ǅ,", "日本。, 日, \U0001f600!", "1a. 2,34 ½.", "#a# |b|. c|d ≠ x=.", "a\x1cb\x85c d\x00"]


def same_ids(tokenizer, chunks, texts):
    got = [np.frombuffer(x, "<u4").tolist() for x in chunks.token_ids(pa.array(texts, pa.string()))]
    for text, ids in zip(texts, got, strict=True):
        assert ids == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], text


def test_ids_are_the_library_s(tokenizer):
    chunks = P.ChunkIds(PATH)
    texts = ODD + [r[1] for r in odd_documents()] + ["\u0958. \u0958x", "é.é,é", "a\u0338. ≠ =\u0338", "x" * 3000 + ".", "각. 각각 한", "'s's don't.'s", "a-b_c/d@e.f"]
    same_ids(tokenizer, chunks, texts)
    same_ids(tokenizer, chunks, texts)
    rng = random.Random(4)
    letters = ["a", "b", "E", "é", "É", "İ", "ß", "\u0958", "\u0301", ".", ",", "'", "#", "<", "|", "1", "½", " ", "  ", "\n", "日", "\u00a0", "s", "t"]
    same_ids(tokenizer, chunks, ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(2000)])


def test_a_full_cache_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(P, "CACHE_BYTES", 80_000)
    chunks, rng = P.ChunkIds(PATH), random.Random(5)
    for _ in range(10):
        same_ids(tokenizer, chunks, [" ".join(f"w{rng.choice('abcdefgh')}{rng.choice('xyz')}{rng.randrange(40)}" for _ in range(200)) + " y" * 300 + " " + "z" * 400])
        assert len(chunks.known) + len(chunks.before) < 500 and not any(len(c) > P.LONG_CHUNK for c in chunks.known)


@pytest.mark.parametrize("size", [64, 2048])
def test_pieces_and_sequences(spark, tokenizer, size):
    rows = odd_documents() + [(500 + k, t, "", 0, "", 0) for k, t in enumerate(ODD * 20)]
    got = P.pack(frame(spark, rows), PATH, size=size, shard_items=50).toPandas()
    want = []
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), size)):
            part = np.array(ids[a : a + size], "<u4")
            want.append((r[0], k, a, len(part), zlib.crc32(part.tobytes())))
    found = [(None if np.isnan(i) else int(i), *map(int, x)) for i, *x in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(map(str, found)) == sorted(map(str, want))
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    fill = got.groupby("sequence_id").length.sum()
    assert fill.max() <= size
    shards = max(1, -(-(got.length < size).sum() // 50))
    assert len(fill) <= -(-got.length.sum() // size) + 2 * shards + 0.03 * len(fill)


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(2)
    lengths = np.sort(rng.integers(1, 900, 400))[::-1]
    a = P.best_fit(list(range(400)), lengths.tolist(), 1000).bin_of(400)
    b = P.best_fit(rng.permutation(400).tolist(), lengths.tolist(), 1000).bin_of(400)
    for _ in range(20):
        child = P.crossover(a, b, lengths, 1000, rng)
        fill = np.bincount(child, lengths)
        assert len(child) == 400 and fill.max() <= 1000 and fill.min() > 0
    best = P.evolve(lengths, 1000, 3, [b])
    assert P.fitness(best, lengths, 1000) >= P.fitness(b, lengths, 1000)


def test_random_islands_come_close_to_the_bound():
    rng = np.random.default_rng(4)
    lengths = np.sort(rng.integers(1, 2048, 2000))[::-1].astype(np.int64)
    least = -(-int(lengths.sum()) // 2048)
    start = len(P.best_fit(rng.permutation(2000).tolist(), lengths.tolist(), 2048).bins)
    one, two = (P.evolve(lengths, 2048, seed, [], seeded=False) for seed in (1, 2))
    both = P.evolve(lengths, 2048, 3, [one, two], seeded=False)
    bins = [-P.fitness(x, lengths, 2048)[0] for x in (one, two, both)]
    assert least <= bins[2] <= min(bins) < start and bins[2] - least < (start - least) / 2
    best = -P.fitness(P.evolve(lengths, 2048, 3, []), lengths, 2048)[0]
    assert best <= len(P.best_fit(range(2000), lengths.tolist(), 2048).bins)


def test_empty(spark):
    assert P.pack(frame(spark, []), PATH).count() == 0
