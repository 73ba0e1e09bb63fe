"""Token counts for a lower-casing byte-pair vocabulary with word ends, by rank-synchronous array merging.

The chunks between white space are looked up in a cache of bounded bytes. The pre-tokens of all chunks that are new are
held as one ragged numpy array of symbols. In each round every pre-token finds its lowest-ranked pair and merges all places
of that pair at once; pre-tokens without a known pair are done. The surviving symbols are counted. A round passes over all
symbols, so a pre-token that is not done after ``ROUNDS`` rounds (it has more symbols than that) goes on with a queue of
its own (rank, place), which finds the next lowest rank without a pass: the time stays near-linear in its length.

Nulls count as empty; texts of any length are counted whole; special tokens' strings inside a text count as one token each,
as the library does by default. Repeated rows are counted alike, empty tables give empty results, further columns are not read.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import coded_chunks, slices, texts_of

#: Bytes of memory that a Python worker's cache of counts takes, about; a full cache is emptied.
CACHE_BYTES = 64 << 20
#: What a chunk in the cache takes besides its own bytes.
ENTRY = 150
#: Longer chunks are not cached.
LONG_CHUNK = 256
#: Rounds over the ragged array.
ROUNDS = 24


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    stand_in = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [stand_in[b] for b in range(256)]


def lower(text: str) -> str:
    """Lower case letter by letter; Python's own lower() turns a last capital sigma into the final form."""
    return text.lower() if "\u03a3" not in text else "".join(map(str.lower, text))


class RankedMerges:
    """Vocabulary, pair ranks and splitting pattern of a tokenizers file of this kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, vocab = spec["model"], spec["model"]["vocab"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or model["end_of_word_suffix"] is None:
            raise ValueError("a BPE vocabulary with word ends and an NFC, white space, lower case normalizer is needed")
        self.size, end = max(vocab.values()) + 1, model["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right, made = (np.array([vocab[f(m)] for m in merges], np.int64) for f in (lambda m: m[0], lambda m: m[1], lambda m: m[0] + m[1]))
        pairs = left * self.size + right
        first = np.full(len(pairs), True)
        order = np.argsort(pairs, kind="stable")
        first[1:] = np.diff(pairs[order]) != 0
        order = order[first]
        self.pairs, self.ranks, self.made = pairs[order], order.astype(np.int64), made
        self.merge_of = dict(zip(self.pairs.tolist(), zip(self.ranks.tolist(), made[order].tolist(), strict=True), strict=True))
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + end] for s in symbols], np.int64)
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None

    def split(self, chunk: str) -> tuple[int, list[str]]:
        """The number of special tokens in a chunk, and its pre-tokens."""
        pieces, n = [chunk], 0
        if self.special and any(s in chunk for s in self.specials):
            pieces = self.special.split(chunk)
            n = len(pieces) - 1
        return n, [w for p in pieces for w in self.pattern.findall(lower(unicodedata.normalize("NFC", p)))]

    def count(self, words: list[str]) -> np.ndarray:
        """The number of tokens of each pre-token."""
        data = [w.encode() for w in words]
        lengths = np.array([len(d) for d in data], np.int64)
        raw = np.frombuffer(b"".join(data), np.uint8)
        ends = np.cumsum(lengths)
        symbols = self.inner[raw]
        symbols[ends[lengths > 0] - 1] = self.last[raw[ends[lengths > 0] - 1]]
        owner, counts = np.repeat(np.arange(len(words)), lengths), lengths.copy()
        none, rounds = len(self.made), 0
        while len(symbols) > 1:
            rounds += 1
            if rounds > ROUNDS:
                cuts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True])))
                for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                    counts[owner[a]] -= self._queued(symbols[a:b].tolist())
                break
            pair = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            rank = np.where((self.pairs[at] == pair) & (owner[:-1] == owner[1:]), self.ranks[at], none)
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            low = np.minimum.reduceat(np.append(rank, none), starts)
            width = np.diff(np.append(starts, len(owner)))
            live = np.repeat(low < none, width)
            hit = np.append(rank, none) == np.repeat(low, width)
            hit &= live
            places = np.flatnonzero(hit)
            # in a run of overlapping places (a pair of equal symbols) every other one merges, from the left
            run = np.concatenate(([True], np.diff(places) != 1))
            origin = np.maximum.accumulate(np.where(run, np.arange(len(places)), 0))
            places = places[(np.arange(len(places)) - origin) % 2 == 0]
            symbols[places] = self.made[rank[places]]
            live[places + 1] = False
            np.subtract.at(counts, owner[places], 1)
            symbols, owner = symbols[live], owner[live]
        return counts

    def _queued(self, symbols: list[int]) -> int:
        """The number of merges that a sequence still takes, the lowest rank first, and of a rank the leftmost place."""
        n, size, merge_of = len(symbols), self.size, self.merge_of
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(merge_of[pair][0], k) for k, pair in enumerate(a * size + b for a, b in zip(symbols, symbols[1:], strict=False)) if pair in merge_of]
        heapify(heap)
        merges = 0
        while heap:
            rank, k = heappop(heap)
            if symbols[k] < 0 or (other := after[k]) == n:
                continue
            found = merge_of.get(symbols[k] * size + symbols[other])
            if found is None or found[0] != rank:
                continue  # one of the two has been merged since
            symbols[k], symbols[other] = found[1], -1
            after[k] = after[other]
            merges += 1
            if after[k] < n:
                before[after[k]] = k
                if (found := merge_of.get(symbols[k] * size + symbols[after[k]])) is not None:
                    heappush(heap, (found[0], k))
            if before[k] >= 0 and (found := merge_of.get(symbols[before[k]] * size + symbols[k])) is not None:
                heappush(heap, (found[0], before[k]))
        return merges


class ChunkCounts:
    """The token counts of chunks, with a cache."""

    def __init__(self, path: str):
        self.model, self.known, self.held = RankedMerges(path), {}, 0

    def _counted(self, chunks: list[bytes]) -> list[int]:
        words, owner, total = [], [], []
        for k, c in enumerate(chunks):
            n, own = self.model.split(c.decode())
            total.append(n)
            words += own
            owner += [k] * len(own)
        total = np.array(total, np.int64)
        if words:
            np.add.at(total, np.array(owner), self.model.count(words))
        return total.tolist()

    def look_up(self, chunks: list[bytes]) -> list[int]:
        """The counts of distinct chunks."""
        if self.held > CACHE_BYTES:
            self.known.clear()
            self.held = 0
        out = [*map(self.known.get, chunks)]
        new = [k for k, n in enumerate(out) if n is None]
        for a in range(0, len(new), 50_000):
            some = new[a : a + 50_000]
            for k, n in zip(some, self._counted([chunks[k] for k in some]), strict=True):
                out[k] = n
                if len(chunks[k]) <= LONG_CHUNK and self.held <= CACHE_BYTES:
                    self.known[chunks[k]] = n
                    self.held += len(chunks[k]) + ENTRY
        return out

    def of_texts(self, texts: pa.Array) -> np.ndarray:
        distinct, codes, ends = coded_chunks(texts)
        n = np.concatenate(([0], np.cumsum(np.array(self.look_up(distinct), np.int64)[codes])))
        return np.diff(n[ends])


@cache
def chunk_counts(path: str) -> ChunkCounts:
    """One for each Python worker, which Spark reuses for many tasks."""
    return ChunkCounts(path)


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row. path: a tokenizers file that every executor can open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = chunk_counts(path)
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            for a, b in slices(texts):
                own = texts.slice(a, b - a)
                tokens = counts.of_texts(own)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pc.binary_length(own).fill_null(0).cast(pa.int64()), pa.array(tokens), pa.array(tokens > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return texts_of(df, id_col, text_col).mapInArrow(run, f"`{id_col}` long, n_bytes long, n_tokens long, over_limit boolean")
