import random

import pytest

from sparkpact.llm import decontaminate as C
from sparkpact.llm.license_scan import words_of

from .helpers import frame, odd_documents, words


def nearest(item, text):
    """The smallest edit distance of the item and any run of the text's words."""
    column = list(range(len(item) + 1))
    best = column[-1]
    for w in text:
        last, column[0] = column[0], 0
        for k in range(1, len(item) + 1):
            column[k], last = min(column[k] + 1, column[k - 1] + 1, last + (item[k - 1] != w)), column[k]
        best = min(best, column[-1])
    return best


def setting():
    rng = random.Random(9)
    items = [(k, " ".join(words(rng, rng.randrange(5, 50), 200))) for k in range(30)] + [(30, "too few words here"), (31, None), (None, "an item without any id at all"), (0, "a second text of item zero it is")]
    rows = odd_documents()
    for k in range(250):
        w = rng.choice(items[:30])[1].split()
        for _ in range(rng.choice([0, 0, 1, 3, 6, 10])):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            if kind == 0:
                w[at] = "edit"
            elif kind == 1 and len(w) > 1:
                del w[at]
            else:
                w.insert(at, f"w{rng.randrange(200)}")
        w += ["too", "few", "words", "here"] if k % 50 == 0 else ["too", "few", "here"] if k % 50 == 1 else []
        rows.append((1000 + k, " ".join(words(rng, rng.randrange(100), 200) + [x.upper() for x in w] + words(rng, rng.randrange(100), 200)) + ".", "", 0, "", 0))
    return items, rows


def test_recall_and_precision(spark):
    items, rows = setting()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in C.find_leaks(frame(spark, rows), bench).where("item_id > 0").collect()}
    want = {}
    for r in rows:
        text = words_of((r[1] or "").encode())
        for i, t in items[1:31]:
            item = words_of(t.encode())
            if (d := nearest(item, text)) <= C.edits_allowed(len(item), 0.8):
                want[r[0], i] = d
    assert not set(got) - set(want)
    assert len(set(got) & set(want)) >= 0.99 * len(want) > 100
    assert all(want[k] == d for k, d in got.items())


def most_edited(rng, item, mix):
    """The item with as many edits as are allowed."""
    w = list(item)
    for k in range(C.edits_allowed(len(item), 0.8)):
        at, kind = rng.randrange(len(w)), rng.choice(mix)
        if kind == 0:
            w[at] = f"new{k}"
        elif kind == 1:
            del w[at]
        else:
            w.insert(at, f"new{k}")
    return w


@pytest.mark.parametrize("mix", [(0,), (1,), (2,), (0, 1, 2)])
def test_the_buckets_alone_reach_the_recall(mix):
    """Without the pre-filter every window is embedded, and only what meets in a bucket is verified."""
    rng = random.Random(14)
    items = [(k, words(rng, n, 3000)) for k, n in enumerate([5, 8, 16, 30] * 6)]
    index = C.Index([(k, " ".join(w)) for k, w in items], 0.8, 0.995, 2, prefilter=False)
    found = 0
    for k, w in items:
        text = words(rng, 20, 3000) + most_edited(rng, w, mix) + words(rng, 20, 3000)
        found += any(leak[0] == k for leak in index.leaks(" ".join(text).encode()))
    assert found >= 0.96 * len(items)


def test_longer_items_get_more_repetitions_or_single_places():
    few, many = (C.embedding_for(n, 0.8, 0.995, 2, trials=8) for n in (20, 400))
    assert few.samples == 2 and (many.samples, many.repeats) > (0, 0) and (many.repeats > few.repeats or many.samples == 1)
    rates = [C.passing_rates(many, 400, 80, mix, 8, 3) for mix in C.MIXES]
    assert all((rate > 0).mean() >= 0.9 for rate in rates)


def test_the_prefilter_loses_nothing():
    items, rows = setting()
    pairs = [(i, t) for i, t in items if t and i is not None]
    whole, sieved = (C.Index(pairs, 0.8, 0.995, 2, prefilter=p) for p in (False, True))
    for r in rows[-40:]:
        text = (r[1] or "").encode()
        assert sieved.leaks(text) == whole.leaks(text)


def test_parts_give_the_same(spark):
    items, rows = setting()
    bench, df = spark.createDataFrame(items, "item_id long, text string"), frame(spark, rows)
    one = {(r.doc_id, r.item_id) for r in C.find_leaks(df, bench).collect()}
    many = {(r.doc_id, r.item_id) for r in C.find_leaks(df, bench, index_bytes=1500).collect()}
    assert len(one ^ many) <= 0.02 * len(one)
    kept = C.drop_leaking(df, bench)
    assert kept.schema == df.schema
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {d for d, _ in one}


def test_empty(spark):
    items, rows = setting()
    bench, df = spark.createDataFrame(items, "item_id long, text string"), frame(spark, rows)
    assert C.find_leaks(df.limit(0), bench).count() == 0 and C.find_leaks(df, bench.limit(0)).count() == 0
    assert C.drop_leaking(df, bench.limit(0)).count() == len(rows)


def test_approximate_matching():
    rng = random.Random(3)
    for _ in range(300):
        item, text = [rng.randrange(1, 5) for _ in range(rng.randrange(1, 70))], [rng.randrange(0, 5) for _ in range(rng.randrange(0, 90))]
        distance, start, end = C.Pattern(item).best(text)
        assert distance == min(nearest(item, text), len(item)) and (not text or nearest(item, text[start:end]) <= distance)
