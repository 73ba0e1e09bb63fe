import re

from sparkpact.llm import license_scan as L

from .helpers import frame, odd_documents

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def brute(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    places = {}
    for label, phrase in (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")):
        p = phrase.split()
        places[label] = [k for k in range(len(w)) if w[k : k + len(p)] == p]
    every = sorted(k for own in places.values() for k in own)
    return len(w), len(every), every[0] if every else None, every[-1] if every else None, ",".join(sorted(n for n, own in places.items() if own))


TEXTS = ["CC-BY cc by CC\nBY", "cc by cc by by", "the GNU General Public License, version 3 general public  license", "All rights reserved. all all rights reserved rights", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.",
         "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "an apache spoke of a license", "ALLé rights reserved", "Permission is hereby granted, free of charge, to any person who is obtaining a copy of this software"]


def test_base_columns(spark):
    rows = odd_documents() + [(100 + k, t, "en", 0, "", 0) for k, t in enumerate(TEXTS)]
    got = L.digest(L.scan_licenses(frame(spark, rows))).collect()
    assert sorted(map(str, ((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got))) == sorted(map(str, ((r[0], *brute(r[1])) for r in rows)))
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_notices_are_labelled(spark):
    got = {r.doc_id: r.labels for r in L.digest(L.scan_licenses(frame(spark, [(k, t, "en", 0, "", 0) for k, t in enumerate(TEXTS)]))).collect()}
    assert got[4] == "apache-2.0" and got[5] == "cc-by,cc-by-nc-4.0" and got[6] == "mit" and got[7] == "gpl,gpl-3.0" and got[8] == "" and got[10] == "mit"


def test_empty_table(spark):
    assert L.digest(L.scan_licenses(frame(spark, []))).count() == 0
