"""Suffix-array dedup: remove every byte that a string of ``length`` bytes covers which also starts anywhere else.

The suffixes of all texts are dealt into shards such that suffixes alike on ``length`` bytes always share one:

1. Every window of ``length`` bytes picks an anchor, the place of the smallest hash among the ``gram``-byte strings in it.
   The pick depends on the window's bytes alone, so equal windows have equal anchors at equal distances. A run of windows
   with one anchor is an occurrence (about one for each 170 bytes of text). The anchor's hash is the shard.
2. Shards with one occurrence hold no repetition; a count drops them. In the others, occurrences with the same bytes are
   one context with a count (partial aggregation: a text copied into a third of all documents is one context of each
   task). A context seen twice or more is repeated as a whole.
3. In a shard with several contexts the suffixes are ordered: the parts from the anchor on, and the parts before it read
   backwards, are sorted by deep-shallow sorting (all contexts of a shard agree on the anchor's bytes, so both are sorts
   of strings with long common prefixes). The common prefixes of neighbours in these two orders tell for every suffix of
   every context whether another one agrees with it on ``length`` bytes.
4. A shard of more than ``max_contexts`` contexts is dealt once more. The distances from a window's start to its anchor are
   parted into ``PARTS`` ranges; all windows of a range hold one longer string around the anchor, which is the finer shard.
   These are sorted in the same way. A finer shard that is still too large is dealt by single distances: there the string
   is the whole window, all suffixes of a shard agree on ``length`` bytes, and nothing is left to sort.

Texts are hashed in slices of ``SLICE`` bytes that overlap by a window; a run of windows that a slice's edge cuts is joined
again. So a task's memory does not grow with a text beyond the text itself.

Null and empty texts lose nothing. Documents are told apart by id and a hash of their text; rows alike in both are copies
of each other, and so repeat each other. Empty tables give empty results; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, texts_of, utf8
from .deep_shallow import common_prefix, deep_shallow_sort

NO_ID = -(1 << 63)
_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_KEY = ("id", "text_hash")
#: Bytes of text that are hashed together in a task.
SLICE = 256 << 10
#: Ranges of anchor distances that a crowded shard is parted into.
PARTS = 8
#: Bytes of contexts in a batch.
BATCH = 4 << 20


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def gram_hashes(raw: np.ndarray, gram: int, powers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each place on."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(raw * powers[0][: len(raw)], out=sums[1:])
        h = (sums[gram:] - sums[:-gram]) * powers[1][: len(raw) - gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return h


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbouring values."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def picked_anchors(data: bytes, length: int, gram: int, powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The place of the anchor of every window of the data, and the hash of the string at every place."""
    h = gram_hashes(np.frombuffer(data, np.uint8).astype(np.uint64), gram, powers)
    ranked = h & np.uint64(0xFFFFFFFF00000000)
    ranked |= np.arange(len(h), dtype=np.uint64)
    least = sliding_least(ranked, length - gram + 1)
    least &= np.uint64(0xFFFFFFFF)
    return least.astype(np.int64), h


def _runs(starts: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each run of neighbouring windows with one anchor, and the run's number of windows."""
    first = np.flatnonzero(np.concatenate(([True], (np.diff(starts) != 1) | (np.diff(picked) != 0))))
    return first, np.diff(np.append(first, len(starts)))


def _of_many(texts: list[bytes], length: int, gram: int, powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...] | None:
    lengths = np.array([len(t) for t in texts], np.int64)
    if not (lengths >= length).any():
        return None
    anchor, h = picked_anchors(b"".join(texts), length, gram, powers)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    inside = np.zeros(len(anchor) + 1, np.int32)
    long = np.flatnonzero(lengths >= length)
    np.add.at(inside, offsets[long], 1)
    np.add.at(inside, offsets[long + 1] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[:-1]))
    first, windows = _runs(starts, anchor[starts])
    low, at = starts[first], anchor[starts[first]]
    text = np.searchsorted(offsets, low, side="right") - 1
    return text, low - offsets[text], windows, at - low, h[at]


def _of_one(text: bytes, length: int, gram: int, powers: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """The same for a long text, slice by slice; the last run of a slice waits for the next one's windows."""
    held = None
    total = len(text) - length + 1
    for a in range(0, total, SLICE):
        anchor, h = picked_anchors(text[a : a + SLICE + length - 1], length, gram, powers)
        first, windows = _runs(np.arange(len(anchor)), anchor)
        own = [first + a, windows, anchor[first] + a, h[anchor[first]]]
        if held is not None:
            if held[2][0] == own[2][0]:
                own[0][0], own[1][0] = held[0][0], own[1][0] + held[1][0]
            else:
                own = [np.concatenate(c) for c in zip(held, own, strict=True)]
        if a + SLICE < total:
            held, own = [c[-1:] for c in own], [c[:-1] for c in own]
        low, windows, at, marks = own
        yield np.zeros(len(low), np.int64), low, windows, at - low, marks


def occurrences(texts: list[bytes], length: int, gram: int, powers: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, first start, windows, anchor's distance from the first start, anchor's hash) of every occurrence, in parts."""
    a, size = 0, 0
    for k in range(len(texts) + 1):
        n = len(texts[k]) if k < len(texts) else 0
        if k == len(texts) or size + n > SLICE:
            if a < k and (found := _of_many(texts[a:k], length, gram, powers)) is not None:
                yield found[0] + a, *found[1:]
            a, size = k, 0
        if n > SLICE:
            for found in _of_one(texts[k], length, gram, powers):
                yield found[0] + k, *found[1:]
            a, size = k + 1, 0
        else:
            size += n


def all_occurrences(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(anchor, c1, c2, id, text_hash, start, windows, ahead): c1 and c2 are a 128-bit hash of the context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = (_powers(_BASE, SLICE + length + 1), _powers(_INVERSE, SLICE + length + 1))
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            texts = utf8(batch.column("text"))
            ids, marks = (batch.column(c).to_numpy() for c in _KEY)
            for text, start, windows, ahead, h in occurrences(texts, length, gram, powers):
                c = b"".join([digest(texts[t][a : a + w + length - 1]) for t, a, w in zip(text.tolist(), start.tolist(), windows.tolist(), strict=True)])
                c = np.frombuffer(c, ">i8").astype(np.int64).reshape(-1, 2)
                # the anchor's place is part of the context: the same bytes always have it at the same place
                yield pa.RecordBatch.from_pydict({"anchor": pa.array(h.view(np.int64)), "c1": pa.array(np.ascontiguousarray(c[:, 0])), "c2": pa.array(np.ascontiguousarray(c[:, 1])), "id": pa.array(ids[text]), "text_hash": pa.array(marks[text]), "start": pa.array(start.astype(np.int32)), "windows": pa.array(windows.astype(np.int32)), "ahead": pa.array(ahead.astype(np.int32))})

    return docs.mapInArrow(run, "anchor long, c1 long, c2 long, id long, text_hash long, start int, windows int, ahead int")


def _pair(a: tuple[bytes, bytes], b: tuple[bytes, bytes], gram: int, length: int) -> tuple[int, int]:
    """The distances before the anchor from which two contexts agree on ``length`` bytes: from, to."""
    return length - common_prefix(a[1], b[1], gram), common_prefix(a[0], b[0])


def repeated_suffixes(contexts: list[tuple[bytes, bytes]], length: int, gram: int) -> list[list[tuple[int, int]]]:
    """contexts: (bytes before the anchor backwards, bytes from the anchor on). For each one the distances before the
    anchor, as (from, to), at which its suffix agrees with another context's on ``length`` bytes."""
    n = len(contexts)
    found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    if n == 2:
        low, high = _pair(*contexts, gram, length)
        if low <= high:
            found = [[(max(low, 0), high)], [(max(low, 0), high)]]
        return found
    right, right_prefix = deep_shallow_sort([c[1] for c in contexts], gram)
    left, left_prefix = deep_shallow_sort([c[0] for c in contexts])
    rank = np.empty(n, np.int64)
    rank[right] = np.arange(n)
    prefixes = np.array(right_prefix, np.int64)
    left_at, left_prefixes = np.array(left), np.array(left_prefix, np.int64)
    stack = [(0, n, -1)]
    while stack:
        # the contexts a..b of the left order agree on ``depth`` bytes before the anchor, and no longer on more
        a, b, above = stack.pop()
        inner = left_prefixes[a + 1 : b]
        depth = int(inner.min())
        members = left_at[a:b]
        ranks = np.sort(rank[members])
        near = np.minimum.reduceat(prefixes, ranks[:-1] + 1)
        # reduceat's last segment runs to the end of the array
        near[-1] = prefixes[ranks[-2] + 1 : ranks[-1] + 1].min()
        best = np.maximum(np.concatenate(([0], near)), np.concatenate((near, [0])))
        low = np.maximum(length - best, above + 1)
        for k in np.flatnonzero(low <= depth).tolist():
            found[right[ranks[k]]].append((int(low[k]), depth))
        cuts = [a, *(np.flatnonzero(inner == depth) + a + 1).tolist(), b]
        stack += [(x, y, depth) for x, y in zip(cuts, cuts[1:], strict=False) if y - x > 1]
    return found


_CONTEXT = ("shard", "anchor", "c1", "c2", "n", "ahead", "windows", "low", "high", "data")


def _sorted_shards(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """_CONTEXT to (anchor, c1, c2, spans) of contexts seen once: starts of their repeated windows, of distances low to high."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, at = [], set(), None
        out: list[tuple] = []

        def done() -> None:
            if len(held) < 2:
                return
            parts = [(data[:ahead][::-1], data[ahead:]) for *_, ahead, _, _, _, data in held]
            for (_, anchor, c1, c2, n, ahead, windows, low, high, _), spans in zip(held, repeated_suffixes(parts, length, gram), strict=True):
                if n > 1 or not spans:
                    continue
                # distances before the anchor become starts from the context's first
                own = [(max(0, ahead - min(y, high)), min(windows - 1, ahead - max(x, low))) for x, y in spans]
                out.append((anchor, c1, c2, [{"a": a, "b": b} for a, b in own if a <= b]))

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["anchor", "c1", "c2", "spans"])
            out.clear()
            return batch

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in _CONTEXT), strict=True):
                if row[0] != at:
                    done()
                    held, seen, at = [], set(), row[0]
                if row[1:4] not in seen:
                    seen.add(row[1:4])
                    held.append(row)
            if len(out) > 1000:
                yield flush()
        done()
        if out:
            yield flush()

    ordered = rows.repartition("shard").sortWithinPartitions("shard").select(*_CONTEXT)
    return ordered.mapInArrow(run, "anchor long, c1 long, c2 long, spans array<struct<a int, b int>>")


def _context_bytes(docs: DataFrame, contexts: DataFrame, length: int) -> DataFrame:
    """contexts with the bytes of their first occurrence; rows of docs that are alike give a context again."""
    wanted = contexts.groupBy(*(F.col(f"seen.{c}").alias(c) for c in _KEY)).agg(F.collect_list(F.struct("anchor", "c1", "c2", "n", "seen.start", "seen.ahead", "seen.windows")).alias("wanted"))
    names = ("anchor", "c1", "c2", "n", "ahead", "windows")

    def packed(rows: list[tuple], data: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), pa.array(data, pa.binary())], names=[*names, "data"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, data, seen, size = [], [], set(), 0
            for text, places, *key in zip(utf8(batch.column("text")), batch.column("wanted").to_pylist(), *(batch.column(c).to_pylist() for c in _KEY), strict=True):
                if tuple(key) in seen:
                    continue
                for p in places:
                    rows.append(tuple(p[c] for c in names))
                    data.append(text[p["start"] : p["start"] + p["windows"] + length - 1])
                    size += p["windows"] + length
                    if size > BATCH:
                        yield packed(rows, data)
                        rows, data, size = [], [], 0
            if rows:
                yield packed(rows, data)

    return docs.join(wanted, [*_KEY]).select(*_KEY, "text", "wanted").mapInArrow(cut, "anchor long, c1 long, c2 long, n long, ahead long, windows long, data binary")


def _parted(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Contexts under a finer shard for each range of distances that they have windows of."""
    most = length - gram
    width = -(-(most + 1) // PARTS)
    ranges = [(low, min(low + width - 1, most)) for low in range(0, most + 1, width)]
    table = F.array(*(F.struct(F.lit(x).cast("long").alias("low"), F.lit(y).cast("long").alias("high")) for x, y in ranges))
    each = rows.withColumn("r", F.explode(table)).where("r.low <= ahead AND r.high > ahead - windows")
    # every window of the range holds the bytes from ``low`` before the anchor to ``length - high`` behind it
    shared = F.substring("data", (F.col("ahead") - F.col("r.low") + 1).cast("int"), (F.col("r.low") - F.col("r.high") + length).cast("int"))
    return each.withColumn("shard", F.xxhash64("anchor", "r.low", shared)).withColumn("low", F.col("r.low")).withColumn("high", F.col("r.high")).select(*_CONTEXT)


def _single_distances(rows: DataFrame, length: int) -> DataFrame:
    """The same result for finer shards that are still crowded: each window is a shard of its own."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, anchor, c1, c2, n, ahead, windows, low, high, data in zip(*(batch.column(c).to_pylist() for c in _CONTEXT), strict=True):
                starts = range(max(0, ahead - high), min(windows - 1, ahead - low) + 1)
                h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[k : k + length]) for k in starts), ">i8").astype(np.int64).reshape(-1, 2)
                columns = (h[:, 0].copy(), h[:, 1].copy(), *(np.full(len(h), v) for v in (anchor, c1, c2, n)), np.array(starts))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["h1", "h2", "anchor", "c1", "c2", "n", "k"])

    each = rows.mapInArrow(cut, "h1 long, h2 long, anchor long, c1 long, c2 long, n long, k long")
    twice = each.groupBy("h1", "h2").agg(F.count("*").alias("all")).where("all > 1").select("h1", "h2")
    hit = each.where("n = 1").join(twice, ["h1", "h2"], "left_semi")
    span = F.struct(F.col("k").cast("int").alias("a"), F.col("k").cast("int").alias("b"))
    return hit.groupBy("anchor", "c1", "c2").agg(F.collect_list(span).alias("spans"))


def _crowded_shards(bytes_of: DataFrame, length: int, gram: int, max_contexts: int) -> DataFrame:
    rows = durable(_parted(bytes_of.dropDuplicates(["anchor", "c1", "c2"]), length, gram))
    sizes = rows.groupBy("shard").agg(F.count("*").alias("contexts"), F.min("n").alias("least")).where("contexts > 1 AND least = 1").select("shard", "contexts")
    rows = rows.join(sizes, "shard")
    out = _sorted_shards(rows.where(F.col("contexts") <= max_contexts), length, gram)
    crowded = rows.where(F.col("contexts") > max_contexts)
    return out if crowded.isEmpty() else out.unionByName(_single_distances(crowded.select(*_CONTEXT), length))


def repeated_spans(docs: DataFrame, length: int, gram: int, max_contexts: int) -> DataFrame:
    """docs(id, text_hash, text) to (id, text_hash, spans): the starts of repeated windows, as (first, last)."""
    every = all_occurrences(docs, length, gram)
    # as a table of its own, so that the join below shuffles both sides and Spark may split a hot anchor's rows
    twice = durable(every.groupBy("anchor").count().where("count > 1").select("anchor"))
    shared = durable(every.join(twice, "anchor", "left_semi"))
    contexts = shared.groupBy("anchor", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct(*_KEY, "start", "windows", "ahead")).alias("seen"))
    contexts = durable(contexts)
    shards = contexts.groupBy("anchor").agg(F.count("*").alias("contexts"), F.min("n").alias("least"))
    mixed = contexts.join(shards.where("contexts > 1 AND least = 1").select("anchor", "contexts"), "anchor")
    bytes_of = _context_bytes(docs, mixed.where(F.col("contexts") <= max_contexts), length)
    bytes_of = bytes_of.select(F.col("anchor").alias("shard"), "*", F.lit(0).cast("long").alias("low"), F.lit(length - gram).cast("long").alias("high"))
    whole = contexts.where("n > 1").select("anchor", "c1", "c2", F.array(F.struct(F.lit(0).alias("a"), (F.col("seen.windows") - 1).alias("b"))).alias("spans"))
    verdicts = whole.unionByName(_sorted_shards(bytes_of, length, gram))
    if not (crowded := mixed.where(F.col("contexts") > max_contexts)).isEmpty():
        verdicts = verdicts.unionByName(_crowded_shards(_context_bytes(docs, crowded, length), length, gram, max_contexts))
    hits = shared.join(verdicts, ["anchor", "c1", "c2"])
    moved = F.transform("spans", lambda s: F.struct((s["a"] + F.col("start")).alias("a"), (s["b"] + F.col("start")).alias("b")))
    return hits.select(*_KEY, moved.alias("spans")).groupBy(*_KEY).agg(F.flatten(F.collect_list("spans")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs, as half-open byte ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def dedup_suffixes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 64, max_contexts: int = 8192) -> DataFrame:
    """(id, n_bytes, removed, kept) per row: the removed runs as half-open byte ranges, and the bytes that are left.

    Cuts fall at any byte, so ``kept`` is binary: it need not be valid UTF-8.
    """
    docs = texts_of(df, id_col, text_col)
    docs = docs.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text")).select(*_KEY, "text")
    spans = repeated_spans(docs, length, gram, max_contexts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, removed, kept = [], [], []
            for text, own in zip(utf8(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                runs = merged([(s["a"], s["b"] + length) for s in own or ()])
                edges = [0, *(x for run in runs for x in run), len(text)]
                sizes.append(len(text))
                removed.append([{"a": a, "b": b} for a, b in runs])
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            ids = [None if i == NO_ID else i for i in batch.column("id").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())], names=[id_col, "n_bytes", "removed", "kept"])

    return docs.join(spans, [*_KEY], "left").select("id", "text", "spans").mapInArrow(cut, f"`{id_col}` long, n_bytes long, removed array<struct<a long, b long>>, kept binary")


def digest(cleaned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    n = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, r: acc + r["b"] - r["a"])
    return cleaned.select(id_col, "n_bytes", n.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """The removed runs of every text, by counting all windows: for tests."""
    count: dict[bytes, int] = {}
    for t in texts:
        for k in range(len(t) - length + 1):
            h = hashlib.md5(t[k : k + length]).digest()
            count[h] = count.get(h, 0) + 1
    return [merged([(k, k + length) for k in range(len(t) - length + 1) if count[hashlib.md5(t[k : k + length]).digest()] > 1]) for t in texts]
