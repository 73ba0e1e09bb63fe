import math
import random
import re

import numpy as np

from sparkpact.llm import toxicity as X

from .helpers import frame, odd_documents, words

BAD = ["vile", "scumbag", "rotten", "wretch"]


def corpus(rng, start, n):
    rows, labels = [], []
    for k in range(n):
        w = words(rng, rng.randrange(30, 120), 300)
        toxic = k % 4 == 0
        if toxic:
            for _ in range(rng.randrange(1, 8)):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        rows.append((start + k, " ".join(w), "en", 0, "", 0))
        labels.append((start + k, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    rows, labels = corpus(rng, 0, 600)
    more, truth = corpus(rng, 1000, 200)
    df = frame(spark, rows + more + [(5000 + k, *r[1:]) for k, r in enumerate(odd_documents())])
    label_rows = spark.createDataFrame(labels + [(None, 1, 1), (77_777, 0, 1), (3, None, None), (0, 1, 1)], "doc_id long, quality int, toxic int")
    model = X.fit(label_rows, df, sample_rows=500)
    assert np.all(np.diff(model.thresholds) > 0)
    got = {r.doc_id: r for r in X.score_toxicity(df, model).collect()}
    assert len(got) == df.count()
    right = [got[d].toxic == bool(t) for d, _, t in truth]
    assert np.mean(right) > 0.97
    assert all(0 <= r.severity <= 2 and r.grade in (0, 1, 2) for r in got.values())
    many = [got[d].severity for d, _, t in truth if t and sum(b in rows_text(more, d) for b in BAD) >= 3]
    none = [got[d].severity for d, _, t in truth if not t]
    assert np.mean(many) > 1.2 and np.mean(none) < 0.2


def rows_text(rows, d):
    return next(r[1] for r in rows if r[0] == d).split()


def brute_severity(text, model):
    """(severity, grade, toxic) in plain Python, from the model's numbers."""
    words = [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    score = 0.0
    for feature, k in model.features.items():
        if feature.startswith(b"<"):
            n = sum(w.encode()[: len(feature) - 1] == feature[1:] for w in words)
        else:
            n = sum(w.encode() == feature for w in words)
        score += model.weights[k] * math.log1p(n)
    above = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
    shares = [1 - above[0], *(a - b for a, b in zip(above, above[1:], strict=False)), above[-1]]
    return sum(above), shares.index(max(shares)), above[0] >= 0.5


def test_severity_against_brute_force(spark):
    rng = random.Random(9)
    rows, labels = corpus(rng, 0, 300)
    odd = [(9000, "VILE vilely. Ünder vile-ness " * 40, "", 0, "", 0), (9001, "<vile> <rotte", "", 0, "", 0)] + [(9100 + k, *r[1:]) for k, r in enumerate(odd_documents())]
    model = X.fit(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), frame(spark, rows), sample_rows=200)
    assert any(f.startswith(b"<") for f in model.features) and any(not f.startswith(b"<") for f in model.features)
    got = {r.doc_id: r for r in X.score_toxicity(frame(spark, rows + odd), model).collect()}
    for d, text, *_ in rows + odd:
        severity, grade, toxic = brute_severity(text, model)
        assert abs(got[d].severity - severity) < 1e-9 and got[d].toxic == toxic and got[d].grade == grade


def test_repeated_ids_do_not_grow_the_sample(spark):
    rng = random.Random(10)
    rows, labels = corpus(rng, 0, 60)
    many = rows + [(k % 3, f"another text {k}", "", 0, "", 0) for k in range(3000)]
    docs = X.texts_of(frame(spark, many), "doc_id", "text")
    known = spark.createDataFrame(labels * 3, "doc_id long, quality int, toxic int")
    sample, weights, counts = X.labelled_sample(known, docs, "doc_id", "toxic", 40)
    ids = [r.id for r in sample.collect()]
    assert len(ids) == len(set(ids)) <= 40 and counts == {0: 45, 1: 15} and weights == {0: 45 / 20, 1: 1.0}


def test_no_labels_no_severity(spark):
    df = frame(spark, odd_documents())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.severity < 1e-9 and not r.toxic for r in X.score_toxicity(df, X.fit(none, df)).collect())
    assert X.score_toxicity(df.limit(0), X.fit(none, df.limit(0))).count() == 0


def test_gradient_by_differences():
    """The fit lowers the loss to about what a fine search around it finds."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    grade = np.digitize(x @ [1.0, -2.0, 0.0] + rng.logistic(size=400), [-0.5, 1.0])
    w, t = X.fit_cumulative_link(x, grade, np.ones(400), 3, penalty=0.0, steps=1500)

    def loss(w, t):
        s = 1 / (1 + np.exp(-((x @ w)[:, None] - t)))
        up = np.concatenate((np.ones((400, 1)), s, np.zeros((400, 1))), axis=1)
        return -np.log(up[np.arange(400), grade] - up[np.arange(400), grade + 1]).mean()

    best = loss(w, t)
    for k in range(3):
        for step in (-0.05, 0.05):
            assert loss(w + step * np.eye(3)[k], t) > best - 1e-4
    for k in range(2):
        for step in (-0.05, 0.05):
            assert loss(w, t + step * np.eye(2)[k]) > best - 1e-4
