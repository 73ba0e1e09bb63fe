import hashlib
import random
import tracemalloc

import pytest

from sparkpact.llm import suffix_dedup as S
from sparkpact.llm.deep_shallow import deep_shallow_sort

from .helpers import frame, odd_documents


@pytest.mark.parametrize("alphabet", [b"ab", b"a", bytes(range(256))])
def test_deep_shallow_sort(alphabet):
    rng = random.Random(len(alphabet))
    strings = [b"head" + bytes(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(500)]
    order, prefixes = deep_shallow_sort(strings, 4, shallow=3)
    assert [strings[k] for k in order] == sorted(strings)
    for i in range(1, len(order)):
        a, b = strings[order[i - 1]], strings[order[i]]
        same = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert prefixes[i] == same


def documents():
    rng = random.Random(3)
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(400))
    rows = []
    for k in range(25):
        t = list(base[: rng.randrange(200, 2000)])
        for _ in range(rng.randrange(6)):
            t[rng.randrange(len(t))] = "#"
        rows.append((100 + k, "".join(t), "en", 0, "", 0))
    passage = base[300:430]
    rows += [(200 + k, f"{k} " * rng.randrange(30) + passage + f" {k}x" * rng.randrange(40), "en", 0, "", 0) for k in range(40)]
    return rows + [(300, "a" * 900, "", 0, "", 0), (301, "ab" * 300, "", 0, "", 0), (302, base, "", 0, "", 0), (302, base, "", 0, "", 0), (303, "é" * 200, "", 0, "", 0)]


@pytest.mark.parametrize("most", [8192, 3])
def test_against_brute_force(spark, most):
    rows = odd_documents() + documents()
    got = S.dedup_suffixes(frame(spark, rows), length=100, gram=24, max_contexts=most).collect()
    texts = [(r[1] or "").encode() for r in rows]
    runs = S.brute_force(texts, 100)
    want = []
    for r, t, own in zip(rows, texts, runs, strict=True):
        kept = b"".join(t[a:b] for a, b in zip([0, *(b for _, b in own)], [*(a for a, _ in own), len(t)], strict=True))
        want.append((r[0], len(t), tuple(own), hashlib.sha256(kept).hexdigest()))
    found = [(r.doc_id, r.n_bytes, tuple((x.a, x.b) for x in r.removed), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got]
    assert sorted(map(str, found)) == sorted(map(str, want))
    assert sum(bool(w[2]) for w in want) > 40


def test_slices_give_the_same_occurrences(monkeypatch):
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"abcd") for _ in range(n)) for n in (30, 5000, 0, 99, 100, 12_345, 700)] + [b"a" * 3000]
    found = []
    for size in (1 << 20, 2048, 333):
        monkeypatch.setattr(S, "SLICE", size)
        powers = (S._powers(S._BASE, (1 << 20) + 101), S._powers(S._INVERSE, (1 << 20) + 101))
        found.append([tuple(map(int, row)) for part in S.occurrences(texts, 100, 24, powers) for row in zip(*part, strict=True)])
    assert found[0] == found[1] == found[2]
    assert sum(row[2] for row in found[0]) == sum(max(0, len(t) - 99) for t in texts)


def test_very_long_text(spark):
    rng = random.Random(6)
    long = bytes(rng.choice(b"abcdefghij \n") for _ in range(700_000)).decode()
    rows = [(1, long, "en", 0, "", 0), (2, "head" + long[262_000:262_900] + "tail", "en", 0, "", 0), (3, long[5:90], "en", 0, "", 0)]
    got = {r.doc_id: [(x.a, x.b) for x in r.removed] for r in S.dedup_suffixes(frame(spark, rows)).collect()}
    assert got == {1: [(262_000, 262_900)], 2: [(4, 904)], 3: []}


def test_memory_of_a_very_long_text():
    rng = random.Random(8)
    text = rng.randbytes(20_000_000)
    powers = (S._powers(S._BASE, S.SLICE + 401), S._powers(S._INVERSE, S.SLICE + 401))
    tracemalloc.start()
    windows = sum(int(part[2].sum()) for part in S.occurrences([text], 400, 64, powers))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert windows == len(text) - 399 and peak < 40 << 20


def test_digest_and_empty(spark):
    rows = S.digest(S.dedup_suffixes(frame(spark, documents()), length=100, gram=24))
    assert rows.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert S.digest(S.dedup_suffixes(frame(spark, []))).count() == 0
