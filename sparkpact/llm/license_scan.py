"""Licence scan by a positional index of rare tokens.

1. One pass counts in how many documents each licence word occurs. The licence words are those of the templates, a fixed
   list, so the counts have a fixed size whatever the corpus.
2. A second pass looks up, in each file, its licence words from the rarest on. Each template is entered through its rarest
   words only; a hit votes for the place where the template would start, and votes that agree on the relative position make
   a candidate. The template's mandatory key phrase must stand there word by word, and the share of the template's total
   rarity that is found in place is the score.

A base phrase is a template whose key phrase is all of it: every one of its places passes through its rarest word, so all
places are found. Null and empty texts have no words and no labels; texts of any length are read whole; repeated rows are
scanned alike; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, texts_of

_WORD_BYTES = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
#: Lower-cases A-Z and turns every byte that is not part of a word into a space.
TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in set(_WORD_BYTES) else 0x20 for b in range(256))


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str  # must stand in the file word by word
    base: bool = False

    @property
    def words(self) -> list[bytes]:
        return words_of(self.text.encode())


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


def _base(label: str, phrase: str) -> Template:
    return Template(label, phrase, phrase, True)


BASE = (_base("cc-by", "cc by"), _base("gpl", "general public license"), _base("reserved", "all rights reserved"))
NOTICES = (
    Template("apache-2.0", "licensed under the Apache License, Version 2.0", "Apache License"),
    Template("mit", "released under the MIT License", "MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "Permission is hereby granted"),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", "GNU General Public License"),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2", "GNU General Public License version 2"),
    Template("lgpl", "licensed under the GNU Lesser General Public License", "Lesser General Public License"),
    Template("cc-by-nc-4.0", "licensed under CC BY-NC 4.0", "CC BY NC"),
    Template("cc-by-sa-4.0", "licensed under CC BY-SA 4.0", "CC BY SA"),
    Template("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License", "Creative Commons Attribution"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", "source and binary forms"),
    Template("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose"),
    Template("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered software"),
)

MATCHES = "array<struct<label string, start long, end long, score double, base boolean>>"


def document_counts(df: DataFrame, vocabulary: set[bytes]) -> tuple[int, dict[bytes, int]]:
    """The number of documents, and of those that hold each word of the (fixed) vocabulary."""

    def each(_: pa.Array, texts: list[bytes]) -> dict:
        n: Counter = Counter()
        for text in texts:
            n.update(vocabulary.intersection(words_of(text)))
        return {"word": pa.array([b"", *n], pa.binary()), "n": pa.array([len(texts), *n.values()], pa.int64())}

    rows = map_texts(df, "word binary, n long", each).groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {bytes(r["word"]): r["n"] for r in rows}
    return found.pop(b"", 0), found


class RareTokenIndex:
    """Postings from each template's rarest words to the template and the word's place in it."""

    def __init__(self, templates: tuple[Template, ...], documents: int, counts: dict[bytes, int], anchors: int = 3, slack: int = 2):
        self.templates, self.slack = templates, slack
        self.words = [t.words for t in templates]
        self.keys = [words_of(t.key.encode()) for t in templates]
        self.idf = {w: math.log((documents + 1) / (counts.get(w, 0) + 1)) + 1e-3 for own in self.words for w in own}
        self.totals = [sum(self.idf[w] for w in own) for own in self.words]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, own in enumerate(self.words):
            rare = sorted({*own}, key=lambda w: (-self.idf[w], w))[: 1 if templates[k].base else anchors]
            for at, w in enumerate(own):
                if w in rare:
                    self.postings[w].append((k, at))
        self.lookup = frozenset(self.postings)

    def scan(self, words: list[bytes]) -> list[tuple[str, int, int, float, bool]]:
        places: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.lookup:
                places[w].append(i)
        votes: dict[tuple[int, int], int] = defaultdict(int)
        for w in sorted(places, key=lambda w: (-self.idf[w], w)):
            for k, at in self.postings[w]:
                for i in places[w]:
                    votes[k, i - at] += 1
        found, taken = [], set()
        for (k, start), _ in sorted(votes.items(), key=lambda v: (v[0][0], -v[1], v[0][1])):
            t, own = self.templates[k], self.words[k]
            if t.base:
                if start >= 0 and words[start : start + len(own)] == own:
                    found.append((t.label, start, start + len(own), 1.0, True))
                continue
            near = range(start - self.slack, start + self.slack + 1)
            if any((k, s) in taken for s in near) or sum((k, s) in votes for s in near) + votes[k, start] < 3:
                continue
            low, high = max(0, start - self.slack), start + len(own) + self.slack
            window, key = words[low:high], self.keys[k]
            if not any(window[i : i + len(key)] == key for i in range(len(window) - len(key) + 1)):
                continue
            got = sum(self.idf[w] for at, w in enumerate(own) if w in words[max(0, start + at - self.slack) : start + at + self.slack + 1])
            if got >= 0.8 * self.totals[k]:
                taken.add((k, start))
                found.append((t.label, max(0, start), min(len(words), start + len(own)), min(1.0, got / self.totals[k]), False))
        return found


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = BASE + NOTICES) -> DataFrame:
    """(id, n_words, matches) for every row; matches hold label, word span, score and whether it is a base phrase."""
    docs = texts_of(df, id_col, text_col)
    documents, counts = document_counts(docs, {w for t in templates for w in t.words})
    index = RareTokenIndex(templates, documents, counts)

    def each(ids: pa.Array, texts: list[bytes]) -> dict:
        n, found = [], []
        for text in texts:
            words = words_of(text)
            n.append(len(words))
            found.append([dict(zip(("label", "start", "end", "score", "base"), m, strict=True)) for m in index.scan(words)])
        kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))
        return {id_col: ids, "n_words": pa.array(n, pa.int64()), "matches": pa.array(found, kind)}

    return map_texts(docs, f"`{id_col}` long, n_words long, matches {MATCHES}", each)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])

    def joined(matches):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")

    return scanned.select(
        id_col, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("matches")).alias("labels"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )
