import random

import corpus_pipeline as P
from sparkpact.llm import decontaminate, line_dedup, quality_rules, simhash
from sparkpact.llm.license_scan import words_of

from .helpers import words
from .test_simhash import components, shingle_set

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert after.columns == columns, name
        seen.append((docs.collect(), after.collect()))
        docs = after
    (raw, good), (_, lines), (_, single), (_, clean), (_, packed) = seen
    verdicts = {r.doc_id: r.kept for r in quality_rules.judge_quality(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert {r.doc_id for r in good} == {d for d, kept in verdicts.items() if kept}

    holders = {}
    for r in good:
        for key in line_dedup.line_keys(r.text.encode())[1]:
            if line_dedup.long_enough(key, 10):
                holders.setdefault(key, set()).add(r.doc_id)
    for r, s in zip(sorted(good), sorted(lines), strict=True):
        own, keys = line_dedup.line_keys(r.text.encode())
        want = b"\n".join(x for x, k in zip(own, keys, strict=True) if len(holders.get(k, ())) < 2 or min(holders[k]) == r.doc_id).decode()
        assert (s.doc_id, s.text, s.n_chars) == (r.doc_id, want, len(want))

    sets = {r.doc_id: shingle_set(r.text) for r in lines}
    ids = sorted(sets)
    groups = components([(a, b) for a in ids for b in ids if b < a and (sets[a] == sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8)], ids)
    assert {r.doc_id for r in single} == set(groups.values())

    items = [w for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text and (w := words_of(r.text.encode()))]
    numbers = {w: k for k, w in enumerate(sorted({w for own in items for w in own}), 1)}
    patterns = [(decontaminate.Pattern([numbers[w] for w in own]), decontaminate.edits_allowed(len(own), 0.8)) for own in items]
    leaking = set()
    for r in single:
        text = [numbers.get(w, 0) for w in words_of(r.text.encode())]
        if any(text) and any(p.best(text)[0] <= d for p, d in patterns):
            leaking.add(r.doc_id)
    assert leaking and {r.doc_id for r in clean} == {r.doc_id for r in single} - leaking
    assert {r.doc_id for r in packed} == {r.doc_id for r in clean}
    assert simhash.fingerprint(b"") == 0


def test_run_is_the_stages(spark):
    got = P.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 100


def written(spark, folder, documents, items):
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long, print long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_odd_rows_through_all_stages(spark, tmp_path):
    rng = random.Random(17)
    good = {k: " ".join(words(rng, 200, 10**6)) + "." for k in range(6)}
    item = " ".join(words(rng, 30, 10**6))
    rows = [(k, t, "en", "a", len(t), None) for k, t in good.items()]
    rows += [(0, good[0], "en", "a", None, 1), (20, good[1] + " end", None, None, None, 2), (None, good[2], "en", "b", 0, 3), (None, " ".join(words(rng, 100, 10**6)), None, None, None, None)]
    rows += [(30, None, "en", "a", 0, 0), (31, "", None, "a", 0, 0), (32, "too short", "en", "a", 9, 0), (33, good[3] + " " + item + " " + " ".join(words(rng, 200, 10**6)), "xx", "a", 0, 0)]
    rows += [(40, " ".join(words(rng, 60_000, 10**6)), "en", "c", 0, 0)]
    out = P.run(spark, written(spark, tmp_path, rows, [(1, item), (2, None), (None, item)])).collect()
    assert sorted({str(r.doc_id) for r in out}) == sorted(map(str, [*good, 40, None]))
    assert sum(r.doc_id == 0 and r.start == 0 for r in out) == 1 and sum(r.length for r in out if r.doc_id == 40) > 60_000
    assert max(r.offset + r.length for r in out) <= 2048


def test_empty_tables_through_all_stages(spark, tmp_path):
    assert P.run(spark, written(spark, tmp_path, [], [])).count() == 0
