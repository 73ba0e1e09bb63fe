import random
import time

import pyarrow as pa
import pytest

from sparkpact.llm import bpe_counts as B

from .helpers import frame, odd_documents
from .test_packing import ODD

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_counts_are_the_library_s(spark, tokenizer):
    rng = random.Random(8)
    letters = "aaaabcdeéßſİΣσς日本\U0001f600'.,!#0123 \n\t\xa0́"
    rows = odd_documents() + [(500 + k, t, "", 0, "", 0) for k, t in enumerate(ODD)] + [(600 + k, "".join(rng.choice(letters) for _ in range(rng.randrange(200))), "", 0, "", 0) for k in range(300)]
    got = B.token_counts(frame(spark, rows), PATH).collect()
    want = [(r[0], len((r[1] or "").encode()), n := len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids), n > 2048) for r in rows]
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want))
    assert any(w[3] for w in want)


def test_runs_of_equal_symbols(tokenizer):
    model = B.RankedMerges(PATH)
    rng = random.Random(2)
    words = ["a" * n for n in range(1, 40)] + ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    assert model.count(words).tolist() == [len(tokenizer.encode(w, add_special_tokens=False).ids) for w in words]


def test_long_unbroken_words(tokenizer):
    model, rng = B.RankedMerges(PATH), random.Random(12)
    words = ["".join(rng.choice("acgt") for _ in range(n)) for n in (30, 700, 100_000)] + ["a" * 5000, "".join(rng.choice("日本語中文的一是") for _ in range(3000))]
    begun = time.process_time()
    got = model.count(words).tolist()
    assert time.process_time() - begun < 4
    assert got == [len(tokenizer.encode(w, add_special_tokens=False).ids) for w in words]


@pytest.mark.parametrize("rounds", [0, 3])
def test_queue_and_rounds_agree(tokenizer, monkeypatch, rounds):
    model, rng = B.RankedMerges(PATH), random.Random(13)
    words = ["".join(rng.choice("aabcdenst") for _ in range(rng.randrange(1, 40))) for _ in range(300)] + ["a" * n for n in range(1, 30)]
    want = model.count(words).tolist()
    monkeypatch.setattr(B, "ROUNDS", rounds)
    assert model.count(words).tolist() == want == [len(tokenizer.encode(w, add_special_tokens=False).ids) for w in words]


def test_small_cache_and_empty(spark, tokenizer, monkeypatch):
    df = frame(spark, odd_documents())
    monkeypatch.setattr(B, "CACHE_BYTES", 500)
    counts, texts = B.ChunkCounts(PATH), [r[1] for r in odd_documents()]
    for _ in range(2):
        assert counts.of_texts(pa.array(texts, pa.string())).tolist() == [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]
        assert len(counts.known) < 10
    assert B.token_counts(df.limit(0), PATH).count() == 0
