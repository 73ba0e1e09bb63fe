import hashlib

import numpy as np
import pytest

from sparkpact.llm import line_dedup as D
from sparkpact.llm.perfect_hash import PerfectHash

from .helpers import frame, odd_documents

WHITE = " \t\n\r\x0b\x0c"
NONE = (1 << 63) - 1


def brute(rows, least=10):
    holders = {}
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            key = low(line.strip(WHITE))
            if len(key) >= least:
                holders.setdefault(key, set()).add(NONE if r[0] is None else r[0])
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        me = NONE if r[0] is None else r[0]
        kept = [x for x in lines if len(own := holders.get(low(x.strip(WHITE)), ())) < 2 or min(own) == me]
        out.append((r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(map(str, out))


def rows():
    shared = [f"a shared line number {k}" for k in range(50)]
    more = [(100 + k, "\n".join([shared[k % 50], f"own line of {k}", "  " + shared[(k * 7) % 50].upper() + "\t", "short", "éééééééééé", "ééééééééé", " nine char"]), "", 0, "", 0) for k in range(120)]
    return odd_documents() + more


@pytest.mark.parametrize("options", [{}, {"shard_keys": 5}, {"broadcast_bytes": 0, "shard_keys": 9, "salt_rows": 7}])
def test_against_brute_force(spark, options):
    got = D.digest(D.dedup_lines(frame(spark, rows()), **options)).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows())


def test_rows_keep_their_columns(spark):
    df = frame(spark, rows()).withColumnRenamed("n_words", "n_chars")
    out = D.drop_repeated_lines(df)
    assert out.schema.names == df.schema.names
    assert all(r.n_chars == len(r.text or "") for r in out.collect())
    assert out.where("text is not null").count() == len(rows())


def test_empty(spark):
    assert D.digest(D.dedup_lines(frame(spark, []))).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        table = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes())
        assert sorted(table.index(keys).tolist()) == list(range(len(keys)))
        assert (table.index(rng.integers(0, 1 << 63, 100).astype(np.uint64)) < max(1, len(keys))).all()


def test_colliding_keys_take_another_seed(monkeypatch):
    with pytest.raises(ValueError):
        D.PerfectHash.build(np.array([7, 7], np.uint64))
    plain = D.mixed
    monkeypatch.setattr(D, "mixed", lambda high, low, seed: np.zeros(len(high), np.uint64) if seed == 0 else plain(high, low, seed))
    seeds = [k for k in range(3) if len(np.unique(D.mixed(np.arange(5), np.arange(5), k))) == 5]
    assert seeds == [1, 2]


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "salt_rows": 5}])
def test_counts_of_sightings(spark, options):
    data = [(k, f"a line that {k % 7} others hold\nthe line that all of them hold\nown line of number {k}", "", 0, "", 0) for k in range(40)]
    got = {r.doc_id: r.top_sightings for r in D.dedup_lines(frame(spark, data), **options).collect()}
    assert got == {k: 40 if k else 0 for k in range(40)}
