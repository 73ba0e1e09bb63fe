import math
import random

import pytest
from pyspark.sql import functions as F

from sparkpact.llm import top_k as M

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vector long, score string"


def brute(rows, k=5, step=50):
    held = {}
    for key, v, *_ in rows:
        if key is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            held[key] = min(held.get(key, v), v)
    whole = {key: [int(x) * 256 if abs(x) >= 2**52 else math.floor(x * 256) for x in v] for key, v in held.items()}
    out = []
    for q, a in whole.items():
        if q % step == 0:
            scored = [(max(min(sum(x * y for x, y in zip(a, b)), M.MOST), M.LEAST), key) for key, b in whole.items() if key != q]  # noqa: B905
            out += [(q, rank, key, score) for rank, (score, key) in enumerate(sorted(scored, key=lambda s: (-s[0], s[1]))[:k], 1)]
    return sorted(out)


def rows_of(n, size=8, seed=1, levels=None):
    rng = random.Random(seed)
    one = lambda: round(rng.uniform(-1, 1), 3) if levels is None else rng.randrange(levels) / 4
    return [(k, [one() for _ in range(size)], 1, "x", 2, "s") for k in range(n)]


def compare(spark, rows, schema=SCHEMA, k=5, step=50, **options):
    import numpy as np

    if "float" in schema:
        rows = [(r[0], None if r[1] is None else [None if x is None else float(np.float32(x)) for x in r[1]], *r[2:]) for r in rows]
    got = M.exact_top_k(spark.createDataFrame(rows, schema), k, F.col("id") % step == 0, **options)
    assert sorted(map(tuple, got.collect())) == brute(rows, k, step)


@pytest.mark.parametrize("grid", [(2048, 4096), (3, 40)])
def test_against_brute_force(spark, monkeypatch, grid):
    monkeypatch.setattr(M, "QUERIES", grid[0])
    monkeypatch.setattr(M, "CANDIDATES", grid[1])
    compare(spark, rows_of(600))


def test_ties_and_common_vectors_need_every_pass(spark, monkeypatch):
    monkeypatch.setattr(M, "CANDIDATES", 100)
    same = [(k, [0.5, 0.25, 0.0, 1.0], 1, "x", 2, "s") for k in range(1000, 1400)]
    compare(spark, rows_of(500, 4, levels=3) + same, bins=20, enough=1)


@pytest.mark.parametrize("bins", [2, 100, 511])
def test_bins_that_do_not_divide_the_intervals(spark, monkeypatch, bins):
    monkeypatch.setattr(M, "CANDIDATES", 200)
    compare(spark, rows_of(700, 16, seed=bins), step=7, bins=bins, enough=1 + bins % 3)


@pytest.mark.parametrize("k", [1, 3, 80])
def test_number_of_ranks(spark, k):
    compare(spark, rows_of(60), k=k, step=7, enough=2, bins=16)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(0, [], 1, "x", 2, "s"), (50, [1.0], 1, "x", 2, "s"), (100, [0.5, -1.0, 3.0], 1, None, None, None), (7, None, 1, "x", 2, "s"), (8, [1.0, None], 1, "x", 2, "s"), (9, [nan], 1, "x", 2, "s"), (10, [inf, 1.0], 1, "x", 2, "s"),
           (150, [-inf], 1, "x", 2, "s"), (None, [1.0, 1.0], 1, "x", 2, "s"), (-50, [0.0, -0.0], 1, "x", 2, "s"), (11, [2.0, 2.0], 1, "x", 2, "s"), (11, [2.0, 1.0], 1, "x", 2, "s"), (50, [1.0], 1, "x", 2, "s")]
    compare(spark, odd)
    compare(spark, odd + rows_of(40, 3, 5)[12:])


def test_very_large_components_are_exact(spark):
    rng = random.Random(2)
    rows = [(k, [rng.uniform(-1, 1) * 10.0 ** rng.choice((0, 3, 7, 9, 30, 300)) for _ in range(3)], 1, "x", 2, "s") for k in range(80)]
    compare(spark, rows, SCHEMA.replace("float", "double"), step=5)
    rows = [(k, [rng.uniform(-1, 1) * 1e6 for _ in range(3)], 1, "x", 2, "s") for k in range(80)]
    compare(spark, rows, SCHEMA.replace("float", "double"), step=5)


def test_few_rows(spark):
    compare(spark, rows_of(1))
    compare(spark, rows_of(3))
    compare(spark, rows_of(20)[1:])
    assert M.exact_top_k(spark.createDataFrame([], SCHEMA)).count() == 0
