import hashlib
import random
import re

import pytest

from sparkpact.llm import fill_in_middle as M

from .helpers import frame, odd_documents

UNITS = {"code point": r"(?s).", "word": r"(?s)\A[\x09-\x0D ]+|[^\x09-\x0D ]+[\x09-\x0D ]*", "line": r"(?s)[^\n]*\n|[^\n]+\Z"}


def brute(key, text, unit="code point"):
    text = text or ""
    found = re.findall(UNITS[unit], text)
    n, digest = len(found), hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in M.MARKERS) or h3 % 100 >= 90:
        return key, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (found[:a], found[a:b], found[b:]))
    if h4 % 100 < 20:
        return key, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return key, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def documents():
    rng = random.Random(3)
    alphabet = "ab é中😀\n \t<PSM>"
    rows = [(100 + k, "".join(rng.choice(alphabet) for _ in range(rng.choice((1, 2, 30, 1023, 1024, 1025, 5000)))), "en", k, "s", k) for k in range(150)]
    rows += [(300 + k, f"a <P> b{k}" if k % 2 else "x<S" + "S>" * k, "en", 1, "s", 1) for k in range(9)]
    return odd_documents() + rows + [(400, "😀" * 50_000, "en", 1, "s", 1), (401, "one" * 100_000, "en", 1, "s", 1), (402, "\n" * 3000, "en", 1, "s", 1)]


@pytest.mark.parametrize("unit", UNITS)
@pytest.mark.parametrize("block", [M.BLOCK, 3])
def test_against_brute_force(spark, unit, block):
    rows = documents() if block > 3 else [r for r in documents() if len(r[1] or "") < 6000]
    got = M.fill_in_middle(frame(spark, rows), unit=unit, block=block)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(brute(r[0], r[1], unit)) for r in rows)


def test_texts_come_back(spark):
    rows = documents()
    found = M.digest(M.fill_in_middle(frame(spark, rows))).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((repr(r.doc_id), r.output_sha256, r.restored_sha256) for r in found) == sorted((repr(r[0]), sha(brute(r[0], r[1])[-1]), sha(r[1] or "")) for r in rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_fenwick_finds_the_block():
    import numpy as np

    rng = random.Random(5)
    for _ in range(50):
        counts = np.array([rng.choice((0, 0, 1, 4)) for _ in range(rng.randrange(1, 40))])
        other = np.array([rng.randrange(5) for _ in counts])
        trees = M.Fenwick(counts), M.Fenwick(other)
        places = [b for b, c in enumerate(counts) for _ in range(c)]
        for target, block in enumerate(places):
            assert trees[0].descend(target, trees[1]) == (block, target - counts[:block].sum(), other[:block].sum())
        assert trees[0].descend(len(places), trees[1])[0] == len(counts)


def test_unknown_unit_and_empty_table(spark):
    with pytest.raises(ValueError, match="unknown unit"):
        M.Blocks(b"x", "page")
    assert M.digest(M.fill_in_middle(frame(spark, []))).count() == 0
