"""Benchmark decontamination by edit distance: CGK embedding and bit-sampling LSH, then exact verification.

A document leaks an item if some run of its words is within ``1 - similarity`` of the item's word count in word edits.
(Words are runs of letters and digits, A-Z lower-cased.) For every document, where it is read:

1. A pre-filter leaves out what cannot hold an item: by the q-gram lemma a run within d edits of an item of L words shares
   at least L - q + 1 - q d of its word runs (q-grams), on diagonals at most d apart. It loses nothing, and tells only
   where windows of which lengths are worth embedding (``prefilter=False``: every window of the document).
2. The windows there, as long as the items, are embedded by CGK random walks, which turn edit distance into Hamming
   distance. Each of several repetitions samples a few places of the embedding; their symbols are the window's bucket, in
   which it meets the items of its length with the same symbols. The number of repetitions is set for each class of lengths
   by simulation, under the hardest of several mixes of edits, such that a window at the largest allowed distance meets
   its item with probability ``recall``.
3. The exact edit distance of the item and the best run near the windows that met it decides (bit-parallel approximate
   matching).

The items are indexed on the driver in parts of at most ``index_bytes`` of text, each broadcast with its task closure; a
larger benchmark takes several passes over the documents. Items so short that no edit is allowed (under 5 words at a
similarity of 0.8) are found word for word, by the same steps. An item without any word has nothing to be found.

Null and empty texts leak nothing; texts of any length are searched whole; repeated rows are judged alike; null and
repeated items do no harm. Empty tables give empty results; further columns are not read (or handed on unread).
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, texts_of, utf8
from .license_scan import words_of

_ODD = np.uint64(0x9E3779B97F4A7C15)


def edits_allowed(words: int, similarity: float) -> int:
    return int(words * (1 - similarity) + 1e-9)


def gram_size(words: int, edits: int) -> int:
    """The longest q up to 3 for which the q-gram lemma promises a shared q-gram."""
    return next(q for q in (3, 2, 1) if q == 1 or words - q + 1 - q * edits >= 1)


def _mix(a: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return a ^ (a >> np.uint64(31))


def grams(ids: np.ndarray, q: int) -> np.ndarray:
    """A hash of every q neighbouring word ids; 0 where one of them is 0 (no item's word)."""
    n = len(ids) - q + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out, known = np.full(n, q, np.uint64), np.full(n, True)
    with np.errstate(over="ignore"):
        for k in range(q):
            part = ids[k : k + n]
            out = _mix(out * _ODD + part.astype(np.uint64))
            known &= part != 0
    return np.where(known, out | np.uint64(1), 0)


class Embedding:
    """CGK walks: ``repeats`` random walks over a string of words, read at ``samples`` sampled steps each."""

    def __init__(self, repeats: int, samples: int, seed: int = 7):
        self.repeats, self.samples, self.seed = repeats, samples, seed

    def steps(self, words: int) -> np.ndarray:
        rng = np.random.default_rng((self.seed, words))
        return np.sort(rng.integers(0, 2 * words, (self.repeats, self.samples)), axis=1)

    def read(self, windows: np.ndarray) -> np.ndarray:
        """windows (n, L) of word ids to (n, repeats, samples): the words at the sampled steps. Past the end stands 0."""
        n, words = windows.shape
        padded = np.concatenate((windows, np.zeros((n, 1), windows.dtype)), axis=1)
        at, steps = np.zeros((n, self.repeats), np.int64), self.steps(words)
        out = np.zeros((n, self.repeats, self.samples), np.int64)
        rows, salts = np.arange(n)[:, None], _mix(np.arange(1, self.repeats + 1, dtype=np.uint64) * _ODD)
        with np.errstate(over="ignore"):
            for step in range(int(steps.max()) + 1):
                symbol = padded[rows, at]
                for k in range(self.samples):
                    hit = steps[:, k] == step
                    out[:, hit, k] = symbol[:, hit]
                walk = _mix(symbol.astype(np.uint64) * _ODD + salts[None, :] + np.uint64(step)) >> np.uint64(63)
                at = np.minimum(at + walk.astype(np.int64), words)
        return out


#: Mixes of edits for the simulation: shares of changed, removed and added words.
MIXES = ((1, 1, 1), (1, 0, 0), (0, 1, 0), (0, 0, 1))
#: Repetitions from which on an embedding is read at single places: longer items need fewer of these.
MANY = 256


def passing_rates(embedding: Embedding, words: int, edits: int, mix: tuple[int, int, int], trials: int, seed: int) -> np.ndarray:
    """For pairs of ``words`` words at ``edits`` edits, the share of the repetitions in which both have one bucket."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 40, (trials, words))
    b = a.copy()
    for row in b:
        for kind in rng.choice(3, edits, p=np.array(mix) / sum(mix)).tolist():
            at, new = int(rng.integers(words)), int(rng.integers(1, 1 << 40))
            if kind == 0:
                row[at] = new
            elif kind == 1:
                row[at:] = np.append(row[at + 1 :], new)
            else:
                row[at:] = np.insert(row[at:], 0, new)[:-1]
    return (embedding.read(a) == embedding.read(b)).all(2).mean(1)


def embedding_for(words: int, similarity: float, recall: float, samples: int, seed: int = 7, trials: int = 48) -> Embedding:
    """Enough repetitions for windows of up to ``words`` words at the largest allowed distance, by simulation."""
    edits = edits_allowed(words, similarity)
    if not edits:
        return Embedding(1, samples, seed)
    probe = Embedding(128, samples, seed)
    # what one repetition's walk does differs by pair: the pairs' own rates count
    rates = [np.clip(passing_rates(probe, words, edits, mix, trials, seed), 1e-3, 1 - 1e-6) for mix in MIXES]
    n = 1
    while min((1 - (1 - rate) ** n).mean() for rate in rates) < recall:
        n = math.ceil(n * 1.25)
    return embedding_for(words, similarity, recall, 1, seed, trials) if n > MANY and samples > 1 else Embedding(n, samples, seed)


class Pattern:
    """An item's words for bit-parallel approximate matching."""

    def __init__(self, words: list[int]):
        self.n, self.masks, self.back = len(words), defaultdict(int), defaultdict(int)
        for k, w in enumerate(words):
            self.masks[w] |= 1 << k
            self.back[w] |= 1 << (self.n - 1 - k)

    @staticmethod
    def _run(masks: dict, n: int, text: list[int], anywhere: bool) -> Iterator[int]:
        """The edit distance of the pattern and the best run that ends with each word (anywhere: starting at any word)."""
        full, top = (1 << n) - 1, 1 << (n - 1)
        plus, minus, score = full, 0, n
        for w in text:
            eq = masks.get(w, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph, mh = minus | ~(xh | plus) & full, plus & xh
            score += bool(ph & top) - bool(mh & top)
            ph = (ph << 1 | (not anywhere)) & full
            mh = mh << 1 & full
            plus, minus = mh | ~(xv | ph) & full, ph & xv
            yield score

    def best(self, text: list[int]) -> tuple[int, int, int]:
        """(distance, start, end) of the nearest run in the text: the first to end, and the shortest of these."""
        best, end = self.n, 0
        for k, score in enumerate(self._run(self.masks, self.n, text, True), 1):
            if score < best:
                best, end = score, k
        start = end
        for k, score in enumerate(self._run(self.back, self.n, text[:end][::-1], False), 1):
            if score == best:
                start = end - k
                break
        return best, start, end


def joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open runs, those that touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Buckets:
    """The items of one length under their sampled symbols."""

    def __init__(self, embedding: Embedding, items: list[int], words: list[np.ndarray]):
        self.embedding, self.words = embedding, len(words[0])
        keys = self._keys(np.stack(words))
        order = np.argsort(keys.ravel(), kind="stable")
        self.keys, self.items = keys.ravel()[order], np.repeat(np.array(items), keys.shape[1])[order]

    def _keys(self, windows: np.ndarray) -> np.ndarray:
        """(windows, repeats): a hash of the repetition and its sampled symbols."""
        read = self.embedding.read(windows)
        with np.errstate(over="ignore"):
            key = np.broadcast_to(np.arange(read.shape[1], dtype=np.uint64), read.shape[:2])
            for k in range(read.shape[2]):
                key = _mix(key * _ODD + read[:, :, k].astype(np.uint64))
        return key

    def meet(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all that share a bucket, in the items' order."""
        keys = self._keys(windows)
        low, high = np.searchsorted(self.keys, keys, "left").ravel(), np.searchsorted(self.keys, keys, "right").ravel()
        n = high - low
        post = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        window = np.repeat(np.repeat(np.arange(len(windows)), keys.shape[1]), n)
        both = np.unique(np.stack((self.items[post], window)), axis=1)
        return both[1], both[0]


class Index:
    def __init__(self, items: list[tuple[int, str]], similarity: float, recall: float, samples: int, prefilter: bool = True):
        kept = sorted((i, w) for i, w in ((i, words_of(t.encode())) for i, t in items) if w)
        self.prefilter, self.ids = prefilter, [i for i, _ in kept]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, own in kept for w in own}), 1)}
        self.words = [np.array([self.vocabulary[w] for w in own], np.int64) for _, own in kept]
        self.edits = [edits_allowed(len(w), similarity) for w in self.words]
        self.sizes = [min(len(w), gram_size(len(w), d)) for w, d in zip(self.words, self.edits, strict=True)]
        self.least = [max(1, len(w) - q + 1 - q * d) for w, q, d in zip(self.words, self.sizes, self.edits, strict=True)]
        self.patterns = [Pattern(w.tolist()) for w in self.words]
        self.postings = {}
        for q in sorted({*self.sizes}):
            places = [(int(g), k, at) for k, w in enumerate(self.words) if self.sizes[k] == q for at, g in enumerate(grams(w, q).tolist())]
            places.sort()
            keys = np.array([p[0] for p in places], np.uint64)
            self.postings[q] = (keys, np.array([p[1] for p in places]), np.array([p[2] for p in places]))
        of_length = defaultdict(list)
        for k, w in enumerate(self.words):
            of_length[len(w)].append(k)
        embeddings, self.buckets, longest = {}, {}, 0
        for words in sorted(of_length):
            if words > longest:  # lengths of one class have the repetitions of its longest
                longest = max(words, int(words * 1.25))
            if longest not in embeddings:
                embeddings[longest] = embedding_for(longest, similarity, recall, samples)
            self.buckets[words] = Buckets(embeddings[longest], of_length[words], [self.words[k] for k in of_length[words]])

    def places(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, lowest diagonal, highest diagonal) where enough q-grams of an item stand close to one diagonal."""
        out = []
        for q, (keys, item_of, at_of) in self.postings.items():
            g = grams(ids, q)
            hit = np.flatnonzero(g)
            if not len(hit):
                continue
            low, high = np.searchsorted(keys, g[hit], "left"), np.searchsorted(keys, g[hit], "right")
            n = high - low
            if n.sum() < min(self.least):
                continue
            post = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            item, diagonal = item_of[post], np.repeat(hit, n) - at_of[post]
            order = np.lexsort((diagonal, item))
            item, diagonal = item[order], diagonal[order]
            starts = np.flatnonzero(np.concatenate(([True], np.diff(item) != 0)))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(item)], strict=True):
                k = int(item[a])
                if b - a < self.least[k]:
                    continue
                d, own = self.edits[k], diagonal[a:b]
                # least q-grams within a band of 2 d + 1 diagonals
                close = np.flatnonzero(own[self.least[k] - 1 :] - own[: len(own) - self.least[k] + 1] <= 2 * d)
                if len(close):
                    lows, highs = own[close] , own[close + self.least[k] - 1]
                    cut = np.flatnonzero(np.concatenate(([True], lows[1:] > highs[:-1] + 2 * d)))
                    ends = [*cut[1:].tolist(), len(lows)]
                    out += [(k, int(lows[x]), int(highs[y - 1])) for x, y in zip(cut.tolist(), ends, strict=True)]
        return out

    def windows(self, ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """For each length of items the runs (from, to) of the first words of the windows to embed."""
        if not self.prefilter:
            return {words: [(-words, len(ids))] for words in self.buckets}
        out = defaultdict(list)
        for k, low, high in self.places(ids):
            out[len(self.words[k])].append((low - self.edits[k], high + self.edits[k] + 1))
        return {words: joined(runs) for words, runs in out.items()}

    def leaks(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(item, distance, first word, words) of every item that the text leaks, at its best place."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words_of(text)], np.int64)
        best: dict[int, tuple] = {}
        for words, runs in self.windows(ids).items() if self.ids else ():
            buckets = self.buckets[words]
            step = max(64, (1 << 17) // buckets.embedding.repeats)
            for begin, end in runs:
                for first in range(begin, end, step):
                    last = min(end, first + step)
                    padded = np.concatenate((np.zeros(max(0, -first), np.int64), ids[max(0, first) : max(0, last + words)], np.zeros(words, np.int64)))
                    near, items = buckets.meet(np.lib.stride_tricks.sliding_window_view(padded, words)[: last - first])
                    cuts = np.flatnonzero(np.concatenate(([True], (np.diff(items) != 0) | (np.diff(near) > words), [True]))) if len(items) else []
                    for x, y in zip(cuts, cuts[1:], strict=False):
                        k = int(items[x])
                        d = self.edits[k]
                        a, b = max(0, first + int(near[x]) - d), first + int(near[y - 1]) + words + d
                        distance, start, stop = self.patterns[k].best(ids[a : max(a, b)].tolist())
                        if distance <= d:
                            best[k] = min(best.get(k, (words, 0, 0)), (distance, a + start, stop - start))
        return [(self.ids[k], *found) for k, found in sorted(best.items())]


def indexes(benchmark: DataFrame, item_col: str, text_col: str, similarity: float, recall: float, samples: int, index_bytes: int, prefilter: bool) -> Iterator[Index]:
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).dropna().distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // index_bytes))
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part) if parts > 1 else items
        yield Index([(r["id"], r["text"]) for r in own.collect()], similarity, recall, samples, prefilter)


def find_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = 0.8, recall: float = 0.995, samples: int = 2, index_bytes: int = 16 << 20, prefilter: bool = True) -> DataFrame:
    """(id, item, distance, similarity, start_word, n_words): one row for each document and item that it leaks."""
    found = None
    for index in indexes(benchmark, item_col, item_text_col, similarity, recall, samples, index_bytes, prefilter):

        def each(ids: pa.Array, texts: list[bytes], index: Index = index) -> dict | None:
            rows = [(i, *leak) for i, text in zip(ids.to_pylist(), texts, strict=True) for leak in index.leaks(text)]
            if not rows:
                return None
            doc, item, distance, start, n = zip(*rows, strict=True)
            words = {i: len(w) for i, w in zip(index.ids, index.words, strict=True)}
            alike = [1 - d / words[i] for i, d in zip(item, distance, strict=True)]
            return {id_col: pa.array(doc, pa.int64()), item_col: pa.array(item, pa.int64()), "distance": pa.array(distance, pa.int32()), "similarity": pa.array(alike), "start_word": pa.array(start, pa.int64()), "n_words": pa.array(n, pa.int64())}

        own = map_texts(texts_of(df, id_col, text_col), f"`{id_col}` long, `{item_col}` long, distance int, similarity double, start_word long, n_words long", each)
        found = own if found is None else found.unionAll(own)
    return found


def drop_leaking(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = 0.8, recall: float = 0.995, samples: int = 2, index_bytes: int = 16 << 20, prefilter: bool = True) -> DataFrame:
    """df without the rows that leak an item."""
    for index in indexes(benchmark, item_col, item_text_col, similarity, recall, samples, index_bytes, prefilter):

        def sift(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not index.leaks(t) for t in utf8(batch.column(text_col))], pa.bool_()))

        df = df.mapInArrow(sift, df.schema)
    return df
