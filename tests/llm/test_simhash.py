import random

import numpy as np
import xxhash

from sparkpact.llm import simhash as H
from sparkpact.llm.components import connected_components

from .helpers import frame, odd_documents, words


def brute_print(text, width=3):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split("[\\x20\\x09-\\x0D]+", t) if x]
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def near_documents():
    rng = random.Random(5)
    base = words(rng, 900)
    rows = []
    for k in range(60):
        t = list(base)
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = "x"
        rows.append((1000 + k, " ".join(t), "en", 0, "", 0))
    return rows


def test_against_brute_force(spark):
    rows = odd_documents() + near_documents()
    got = H.digest(H.near_duplicates(frame(spark, rows))).collect()
    prints = [brute_print(r[1]) for r in rows]
    assert sorted(r.fingerprint for r in got) == sorted(f"{p:016x}" for p in prints)
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    groups = components(pairs, range(len(rows)))
    least = {}
    for k, g in groups.items():
        if rows[k][0] is not None:
            least[g] = min(least.get(g, rows[k][0]), rows[k][0])
    want = sorted(str((rows[k][0], f"{prints[k]:016x}", least.get(g))) for k, g in groups.items())
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got) == want


def test_crowded_keys_lose_no_link(spark):
    rng = random.Random(11)
    centers = [rng.getrandbits(64) for _ in range(4)]
    prints = {rng.choice(centers) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(100)}
    prints = sorted(p & (1 << 64) - 1 for p in prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "print long")
    want = components([(signed[a], signed[b]) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3], signed)
    for most in (20_000, 20):
        got = {r.node: r.component for r in connected_components(H.links(df, max_bucket=most)).collect()}
        assert {p: got.get(p, p) for p in signed} == want


def test_forest_spans_components():
    rng = np.random.default_rng(1)
    prints = np.unique(rng.integers(0, 1 << 12, 700).astype(np.uint64))
    links = H.forest(prints, 1, block=64)
    pairs = [(a, b) for a in range(len(prints)) for b in range(a) if int(prints[a] ^ prints[b]).bit_count() <= 1]
    assert components(links, range(len(prints))) == components(pairs, range(len(prints)))
    assert len(links) == len(prints) - len(set(components(pairs, range(len(prints))).values()))


def test_repeated_rows_and_other_columns(spark):
    text = " ".join(words(random.Random(2), 50))
    rows = [(5, text, "en", k, "a", 0) for k in range(3)] + [(3, text + " end", "de", 1, "b", 1), (None, text, "en", 2, None, None), (8, "short", "en", 1, "", 0), (8, "other", "en", 1, "", 0), (8, "short", "en", 1, "", 0), (None, None, "", 0, "", 0), (9, "", "", 0, "", 0)]
    df = frame(spark, rows).withColumnRenamed("row", "gone_id").withColumnRenamed("n_words", "print").withColumnRenamed("shard", "own")
    kept = H.drop_similar(df).collect()
    assert list(kept[0].__fields__) == df.columns
    assert sorted((r.doc_id, r.text) for r in kept) == [(3, text + " end"), (8, "other"), (8, "short"), (9, "")]


def test_empty_and_chain(spark):
    assert H.near_duplicates(frame(spark, [])).count() == 0
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(chain).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def edited(rng, similarity):
    """A text and a copy with single words replaced, of a shingle similarity just at or above the given one, or just below."""
    a = words(rng, rng.choice([12, 40, 120, 400]), 10**9)
    b, last = list(a), list(a)
    for at in rng.sample(range(len(a)), len(a)):
        last, b = b, list(b)
        b[at] = f"new{rng.randrange(10**9)}"
        x, y = shingle_set(" ".join(a)), shingle_set(" ".join(b))
        if len(x & y) / len(x | y) < similarity:
            return " ".join(a), " ".join(last), " ".join(b)


def test_similar_texts_against_brute_force_jaccard(spark):
    rng, rows = random.Random(3), odd_documents()
    for k in range(150):
        a, near, far = edited(rng, 0.8)
        rows += [(1000 + 10 * k, a, "en", 0, "", 0), (1001 + 10 * k, near if k % 2 else far, "en", 0, "", 0)]
    base = words(rng, 200, 10**9)
    for k in range(80):  # a crowd, of members up to 0.75 alike and of chains
        base = list(base)
        base[rng.randrange(200)] = f"new{k}"
        rows.append((5000 + k, " ".join(base), "en", 0, "", 0))
    sets = [shingle_set(r[1]) for r in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] == sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    groups = components(pairs, range(len(rows)))
    best = {}
    for k, g in groups.items():
        key = (rows[k][0] is None, rows[k][0])
        best[g] = min(best.get(g, key), key)
    want = {str(b[1]) for b in best.values()}
    got = {str(r.doc_id) for r in H.drop_similar(frame(spark, rows)).collect()}
    assert not want - got  # nothing below the similarity is joined
    assert len(got - want) <= 1
    assert H.drop_similar(frame(spark, [])).count() == 0


def test_heads_and_tallies_lose_no_pair():
    rng = np.random.default_rng(4)
    for similarity in (0.5, 0.8, 1.0):
        base = [rng.integers(0, 1 << 64, n, np.uint64) for n in (1, 4, 9, 30, 200)]
        sets = [np.unique(np.concatenate((b[rng.random(len(b)) < 0.9], rng.integers(0, 1 << 64, rng.integers(0, 1 + len(b) // 8), np.uint64), [b[0]]))) for b in base for _ in range(30)]
        common = np.unique(np.concatenate([b[::3] for b in base]))
        for often in (common, common[:0]):
            rows = sorted((int(h), k, place) for k, own in enumerate(sets) for place, h in enumerate(H.head(own, often, similarity).view(np.int64)))
            keys, nodes, places = (np.array(c) for c in zip(*rows, strict=True))
            parts, sizes = nodes // 2, np.array([len(x) for x in sets])[nodes]
            met = {(int(a), int(b)) for i, j in H.crossing_pairs(keys, nodes, parts, sizes, places, similarity, block=16) for a, b in zip(i, j, strict=True)}
            alike = {(a, b) for b in range(len(sets)) for a in range(b) if a // 2 != b // 2 and H.jaccard(sets[a], sets[b]) >= similarity}
            assert alike <= met and all(a < b and a // 2 != b // 2 for a, b in met) and (similarity == 1 or len(alike) > 50)
    for a, b in zip(sets, sets[1:], strict=False):
        assert np.abs(H.tally(a).view(np.uint8).astype(int) - H.tally(b).view(np.uint8)).sum() <= len(np.setxor1d(a, b))


def test_no_link_is_lost(spark):
    rng, rows = random.Random(21), []
    for k in range(150):
        a, near, far = edited(rng, 0.8)
        rows += [(1000 + 10 * k, a, "en", 0, "", 0), (1001 + 10 * k, near, "en", 0, "", 0), (1002 + 10 * k, far, "en", 0, "", 0)]
    base = words(rng, 60, 10**9)
    for k in range(150):  # a crowd of which most are near each other but not alike
        own = list(base)
        for at in rng.sample(range(60), 2):
            own[at] = f"new{rng.randrange(40)}"
        rows.append((5000 + k, " ".join(own), "en", 0, "", 0))
    sets = [shingle_set(r[1]) for r in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    want = sorted({rows[g][0] for g in components(pairs, range(len(rows))).values()})
    for bands in (128, 1):  # the search alone lost links under either, the more the fewer keys it has
        assert sorted(r.doc_id for r in H.drop_similar(frame(spark, rows), bands=bands).collect()) == want
