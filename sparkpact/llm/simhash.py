"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint of 64 bits is cut into ``blocks`` blocks. Two fingerprints that differ in at most d bits agree on at least
``blocks - d`` whole blocks, so each choice of that many blocks is a join key: close pairs share one of the keys. Each
distinct fingerprint is entered once under each key (copies of a text cost nothing) and those that meet under a key are compared bit by bit. A key hands on the links of a spanning forest of its
close pairs, not all pairs; their components are the same.

A key that more than ``max_bucket`` fingerprints share is cut once more: of the blocks outside the key, the differing bits
leave all but d of 16 finer pieces alike, and every choice of them is a finer key. A finer key fixes all but
a few bits, so it is small by construction. No fingerprint is left out.

``drop_similar`` asks for texts of a given Jaccard similarity instead of fingerprints of a given distance. At similarity 0.8
some 15 % of the bits differ, too many for whole blocks to be promised alike, so it takes a longer fingerprint (``SPAN``
words of 64 bits) of the set of shingles, samples many keys from its bits, and verifies every link that a key proposes by
the exact similarity of the two sets. Texts with equal sets are one node. A search by sampled bits misses some links, and
stands in for the pairs of a crowded key by some of them; so an exact search between the components it found follows: two
sets of the similarity hold a common shingle among the first of each in any one order of all shingles (the prefix filter),
and every pair that meets there, of two components, is verified unless a bound of its overlap rules it out.

Null and empty texts have fingerprint 0, which links like any other. Rows with a null id take part; a group of only such
rows has a null component. Repeated rows, empty tables and further columns are handled without special cases.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, map_texts, texts_of
from .components import connected_components

SEED = 42
#: Words of 64 bits in the long fingerprint.
SPAN = 8
#: Words of eight counts in the tally of a set, and in the finer one that is made for pairs which pass the first.
TALLY, FINER = 16, 128
#: Rows up to which the names of wanted texts are broadcast to where the texts are.
BROADCAST = 200_000
#: One text in so many is counted to tell common shingles, and so many of these are put last in the order.
SAMPLE, COMMON = 32, 50_000


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """The XXH64 of all shingles, in the text's order."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    shingles = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles], "<u8")


def fingerprint(text: bytes, width: int = 3) -> int:
    """The majority of the bits of the XXH64 of all shingles; a tie is 0."""
    h = shingle_hashes(text, width)
    if not len(h):
        return 0
    votes = np.zeros(64, np.int64)
    for a in range(0, len(h), 65_536):
        votes += np.unpackbits(h[a : a + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, print): the fingerprint as a signed long."""

    def each(ids: pa.Array, texts: list[bytes]) -> dict:
        prints = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
        return {"id": ids, "print": pa.array(prints)}

    return map_texts(texts_of(df, id_col, text_col), "id long, print long", each)


def block_masks(blocks: int, bits: int = 64, at: list[int] | None = None) -> list[int]:
    """Masks of ``blocks`` nearly equal runs of the given bit places (all 64 by default)."""
    at = [*range(bits)] if at is None else at
    cuts = [round(k * len(at) / blocks) for k in range(blocks + 1)]
    return [sum(1 << b for b in at[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]


def key_masks(blocks: int, distance: int) -> list[int]:
    return [sum(c) for c in combinations(block_masks(blocks), blocks - distance)]


def forest(prints: np.ndarray, distance: int, block: int = 256) -> list[tuple[int, int]]:
    """Links that join the components of the close pairs among distinct fingerprints, one fewer than each component has members."""
    label, links = np.arange(len(prints)), []
    for a in range(0, len(prints), block):
        near = np.bitwise_count(prints[a : a + block, None] ^ prints[None, a:]) <= distance
        for i in np.flatnonzero(near.sum(1) > 1).tolist():
            close = np.flatnonzero(near[i]) + a
            own = label[close]
            if (own != own[0]).any():
                labels, first = np.unique(own, return_index=True)
                links += [(a + i, j) for j in close[first].tolist() if label[j] != label[a + i]]
                label[np.isin(label, labels)] = labels[0]
    return links


def _buckets(keyed: DataFrame, distance: int, max_bucket: int | None) -> DataFrame:
    """keyed(k, key, print) to rows (k, key, a, b): links, or with a null b the members of a key above max_bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, at = 0, None

        def rows(k: int, key: int, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
            n = len(a)
            other = pa.nulls(n, pa.int64()) if b is None else pa.array(b.view(np.int64))
            return pa.RecordBatch.from_pydict({"k": pa.array(np.full(n, k, np.int32)), "key": pa.array(np.full(n, key, np.int64)), "a": pa.array(a.view(np.int64)), "b": other})

        def done() -> Iterator[pa.RecordBatch]:
            if size > 1 and (max_bucket is None or size <= max_bucket):
                prints = np.unique(np.concatenate(held).view(np.uint64))
                links = forest(prints, distance)
                if links:
                    left, right = np.array(links).T
                    yield rows(*at, prints[left], prints[right])

        for batch in batches:
            k, key, prints = (batch.column(c).to_numpy() for c in ("k", "key", "print"))
            if not len(k):
                continue
            cuts = np.concatenate(([0], np.flatnonzero((np.diff(k) != 0) | (np.diff(key) != 0)) + 1, [len(k)]))
            many = np.diff(cuts) > 1
            many[[0, -1]] = True  # these may go on in the batches beside; other keys with one fingerprint are passed over
            for x, y in zip(cuts[:-1][many].tolist(), cuts[1:][many].tolist(), strict=True):
                if (k[x], key[x]) != at:
                    yield from done()
                    held, size, at = [], 0, (k[x], key[x])
                held.append(prints[x:y])
                size += y - x
                if max_bucket is not None and size > max_bucket:
                    yield rows(*at, np.concatenate(held).view(np.uint64), None)
                    held = []
        yield from done()

    return keyed.repartition("k", "key").sortWithinPartitions("k", "key").select("k", "key", "print").mapInArrow(work, "k int, key long, a long, b long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def links(prints: DataFrame, distance: int = 3, blocks: int = 6, max_bucket: int = 20_000) -> DataFrame:
    """Distinct fingerprints (print) to links (a, b) between fingerprints at ``distance`` or fewer bits."""
    masks = key_masks(blocks, distance)
    table = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(_signed(m)).alias("mask")) for k, m in enumerate(masks)))
    keyed = prints.withColumn("m", F.explode(table)).select(F.col("m.k").alias("k"), F.col("print").bitwiseAND(F.col("m.mask")).alias("key"), "print")
    met = durable(_buckets(keyed, distance, max_bucket))
    found = met.where("b IS NOT NULL").select("a", "b")
    crowded = met.where("b IS NULL")
    if crowded.isEmpty():
        return found
    finer = []
    for k, mask in enumerate(masks):
        free = [b for b in range(64) if not mask >> b & 1]
        pieces = block_masks(16, at=free)
        finer += [(k, _signed(sum(c))) for c in combinations(pieces, 16 - distance)]
    finer = prints.sparkSession.createDataFrame([(k, f, m) for f, (k, m) in enumerate(finer)], "k int, f int, mask long")
    again = crowded.join(F.broadcast(finer), "k")  # a fixed table, of len(masks) * C(16, distance) rows
    again = again.select(F.col("f").alias("k"), F.xxhash64("key", F.col("a").bitwiseAND(F.col("mask"))).alias("key"), F.col("a").alias("print"))
    return found.unionAll(_buckets(again, distance, None).select("a", "b"))


def set_node(hashes: np.ndarray) -> int:
    """One name for all texts with the same set of shingles (their sorted hashes); 0 for the empty set."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64)) if len(hashes) else 0


def long_print(hashes: np.ndarray) -> np.ndarray:
    """The majority of ``SPAN`` words of bits made of each hash of a set; of a tie the smallest hash decides."""
    votes, first = np.zeros(64 * SPAN, np.int64), np.zeros(64 * SPAN, np.uint8)
    salts = (np.arange(1, SPAN + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    for a in range(0, len(hashes), 255):  # sums of 255 bits fit in a byte
        with np.errstate(over="ignore"):
            h = hashes[a : a + 255, None] + salts
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
        bits = np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little")
        if not a:
            first = bits[0]
        votes += bits.sum(0, dtype=np.uint8)
    return np.packbits(2 * votes + first > len(hashes), bitorder="little").view("<u8")


def sampled_places(bands: int, bits: int) -> np.ndarray:
    """(bands, bits) places of the long fingerprint: none in word band % SPAN, which checks those that meet under the key."""
    rng = np.random.default_rng(SEED)
    return np.array([rng.permutation([b for b in range(64 * SPAN) if b // 64 != band % SPAN])[:bits] for band in range(bands)])


def close_pairs(keys: np.ndarray, checks: np.ndarray, nodes: np.ndarray, distance: int, small: int = 8, window: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places with equal keys whose checks differ in at most ``distance`` bits. keys are sorted, checks sorted within a key.

    Of a key that more than ``small`` share, a spanning forest of its close pairs and the nearest of each member stand for
    all pairs, within overlapping runs of ``window`` neighbours: their number grows with the members, not their square. The
    forest starts from the smallest node, so that it takes much the same pairs under all keys. Links lost by that (the
    checks are no proof) are found by ``_missed``.
    """
    cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    sizes = np.diff(cuts)
    left, right = [], []
    at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= small), sizes))
    for step in range(1, small):
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        near = at[np.bitwise_count(checks[at] ^ checks[at + step]) <= distance]
        left.append(near)
        right.append(near + step)
    for k in np.flatnonzero(sizes > small).tolist():
        for x in range(int(cuts[k]), int(cuts[k + 1]), window // 2):
            own = checks[x : min(x + window, int(cuts[k + 1]))]
            if len(own) < 2:
                continue
            order = np.argsort(nodes[x : x + len(own)], kind="stable")
            i, j = np.array(forest(own[order], distance), np.int64).reshape(-1, 2).T
            left.append(order[i] + x)
            right.append(order[j] + x)
            for a in range(0, len(own), 256):
                apart = np.bitwise_count(own[a : a + 256, None] ^ own[None, :])
                apart[np.arange(len(apart)), np.arange(a, a + len(apart))] = 255
                best = apart.argmin(1)
                i = np.flatnonzero(apart[np.arange(len(apart)), best] <= distance)
                left.append(i + a + x)
                right.append(best[i] + x)
            if x + window >= cuts[k + 1]:
                break
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _candidates(nodes: DataFrame, bands: int, bits: int, distance: int) -> DataFrame:
    """nodes(print, w0, w1, ...) to distinct pairs (a, b) of nodes that meet under a key and pass its check."""
    places, powers = sampled_places(bands, bits), 1 << np.arange(bits)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                words = np.stack([batch.column(f"w{k}").to_numpy() for k in range(SPAN)], axis=1)
                on = np.unpackbits(words.astype("<i8").view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")
                keys = np.stack([on[:, own] @ powers for own in places], axis=1) + (np.arange(bands) << bits)
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys.ravel()), "check": pa.array(words[:, np.arange(bands) % SPAN].ravel()), "node": pa.array(np.repeat(batch.column("print").to_numpy(), bands))})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3

        def done(key: np.ndarray, check: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(key):
                i, j = close_pairs(key, check.view(np.uint64), node, distance)
                if len(i):
                    yield pa.RecordBatch.from_pydict({"a": pa.array(np.maximum(node[i], node[j])), "b": pa.array(np.minimum(node[i], node[j]))})

        for batch in batches:
            if batch.num_rows:
                held = [np.concatenate((h, batch.column(k).to_numpy())) for k, h in enumerate(held)]
                cut = int(np.searchsorted(held[0], held[0][-1]))  # the last key may go on in the next batch
                yield from done(*(h[:cut] for h in held))
                held = [h[cut:] for h in held]
        yield from done(*held)

    keyed = nodes.select("print", *(f"w{k}" for k in range(SPAN))).mapInArrow(enter, "key long, check long, node long")
    return keyed.repartition("key").sortWithinPartitions("key", "check").mapInArrow(meet, "a long, b long").distinct()


def tally(hashes: np.ndarray, words: int = TALLY) -> np.ndarray:
    """How many of the set's hashes have each of 8 * ``words`` residues, 255 at most: the differences of two sets' counts add
    up to no more than there are hashes in only one of them."""
    counts = np.bincount((hashes % np.uint64(8 * words)).astype(np.int64), minlength=8 * words)
    return np.minimum(counts, 255).astype(np.uint8).view("<u8")


def head(hashes: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first hashes of a set (sorted), common ones coming last: sets of the similarity share one of their heads."""
    if len(common) and len(hashes):
        often = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
        hashes = np.concatenate((hashes[~often], hashes[often]))
    return hashes[: len(hashes) - math.ceil(similarity * len(hashes) - 1e-6) + 1]


def crossing_pairs(keys: np.ndarray, nodes: np.ndarray, parts: np.ndarray, sizes: np.ndarray, places: np.ndarray, similarity: float, small: int = 8, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of nodes that hold a key in common and lie in different parts, but for those whose overlap is too small if
    the key is the first they share. Rows are sorted by key and node; sizes are those of the sets, places those of the key."""
    fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])))
    keys, nodes, parts, sizes, rest = (c[fresh] for c in (keys, nodes, parts, sizes, sizes - places))
    cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    counts = np.diff(cuts)
    mixed = np.minimum.reduceat(parts, cuts[:-1]) != np.maximum.reduceat(parts, cuts[:-1])
    share = similarity / (1 + similarity)

    def able(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (parts[i] != parts[j]) & (np.minimum(rest[i], rest[j]) >= share * (sizes[i] + sizes[j]) - 1e-6)

    at = np.flatnonzero(np.repeat(mixed & (counts <= small), counts))
    for step in range(1, small):
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        left = at[able(at, at + step)]
        yield nodes[left], nodes[left + step]
    for k in np.flatnonzero(mixed & (counts > small)).tolist():
        own = np.arange(cuts[k], cuts[k + 1])
        for a in range(0, len(own), block):
            i, j = np.nonzero(able(own[a : a + block, None], own[None, a:]))
            up = i < j
            yield nodes[own[a:][i[up]]], nodes[own[a:][j[up]]]


def _common_shingles(texts: DataFrame, width: int) -> np.ndarray:
    """Hashes of shingles that several of the counted texts hold, sorted. Which they are changes the work, not the result."""

    def each(ids: pa.Array, texts: list[bytes]) -> dict:
        return {"hash": pa.array(np.concatenate([np.unique(shingle_hashes(t, width)) for t in texts]).view(np.int64))}

    counted = texts.where(F.pmod("mark", F.lit(SAMPLE)) == 0).dropDuplicates(["mark"]).select("id", "text")
    often = map_texts(counted, "hash long", each).groupBy("hash").count().where("count > 3")
    return np.unique(np.array([r[0] for r in often.orderBy(F.desc("count"), "hash").limit(COMMON).select("hash").collect()], np.int64).view(np.uint64))


def _missed(texts: DataFrame, linked: DataFrame, width: int, similarity: float) -> DataFrame:
    """linked(print, first, component, size, x0, x1, ...) to distinct pairs (a, b) of nodes of different components, among
    them all of the similarity."""
    common = _common_shingles(texts, width)

    def each(ids: pa.Array, texts: list[bytes]) -> dict:
        heads = [head(np.unique(shingle_hashes(t, width)), common, similarity) for t in texts]
        marks = np.array([xxhash.xxh64_intdigest(t, SEED) for t in texts], np.uint64).view(np.int64)
        ends = pa.array(np.cumsum([0, *map(len, heads)]), pa.int32())
        return {"id": ids, "mark": pa.array(marks), "head": pa.ListArray.from_arrays(ends, pa.array(np.concatenate(heads).view(np.int64)))}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 5

        def done(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for a, b in crossing_pairs(*columns, similarity) if len(columns[0]) else ():
                if len(a):
                    yield pa.RecordBatch.from_pydict({"a": pa.array(np.maximum(a, b)), "b": pa.array(np.minimum(a, b))})

        for batch in batches:
            if batch.num_rows:
                held = [np.concatenate((h, batch.column(k).to_numpy())) for k, h in enumerate(held)]
                cut = int(np.searchsorted(held[0], held[0][-1]))  # the last key may go on in the next batch
                yield from done([h[:cut] for h in held])
                held = [h[cut:] for h in held]
        yield from done(held)

    own = linked.select(F.col("first.id").alias("own_id"), F.col("first.mark").alias("own_mark"), "print", "component", "size")
    heads = map_texts(texts.select("id", "text"), "id long, mark long, head array<long>", each)
    heads = heads.join(own, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("mark") == F.col("own_mark")))
    entered = heads.select("print", "component", "size", F.posexplode("head").alias("place", "key"))
    entered = entered.select("key", "print", "component", "size", F.col("place").cast("long").alias("place"))
    met = entered.repartition("key").sortWithinPartitions("key", "print").mapInArrow(meet, "a long, b long").distinct()
    tallies = [f"x{k}" for k in range(TALLY)]
    for side in "ab":
        met = met.join(linked.select(F.col("print").alias(side), F.struct("size", *tallies).alias(f"of_{side}")), side)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sides = [dict(zip(["size", *tallies], part.column(f"of_{c}").flatten(), strict=True)) for c in "ab"]
                counts = [np.stack([own[x].to_numpy() for x in tallies], axis=1).view(np.uint8).astype(np.int32) for own in sides]
                most = (sides[0]["size"].to_numpy() + sides[1]["size"].to_numpy()) * ((1 - similarity) / (1 + similarity)) + 1e-6
                yield part.select(["a", "b"]).filter(pa.array(np.abs(counts[0] - counts[1]).sum(1) <= most))

    return met.select("a", "b", "of_a", "of_b").mapInArrow(near, "a long, b long")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two sets of hashes, each without repeats; that of two empty sets is 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _held(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(print, text) of the nodes in pairs (a, b)."""
    wanted = pairs.select(F.col("a").alias("print")).unionAll(pairs.select("b")).distinct()
    wanted = durable(nodes.join(wanted, "print", "left_semi").select("print", F.col("first.id").alias("own_id"), F.col("first.mark").alias("own_mark")))
    if wanted.count() <= BROADCAST:
        wanted = F.broadcast(wanted)
    held = texts.join(wanted, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("mark") == F.col("own_mark")))
    return held.groupBy("print").agg(F.min("text").alias("text"))


def _near_by_finer_tallies(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose finer tallies leave room for the similarity; so only few texts are brought together."""

    def each(ids: pa.Array, texts: list[bytes]) -> dict:
        sets = [np.unique(shingle_hashes(t, width)) for t in texts]
        return {"id": ids, "size": pa.array([len(h) for h in sets], pa.int64()), "counts": pa.array([tally(h, FINER).tobytes() for h in sets], pa.binary())}

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                a, b = (np.frombuffer(b"".join(part.column(f"counts_{c}").to_pylist()), np.uint8).reshape(part.num_rows, -1).astype(np.int16) for c in "ab")
                most = (part.column("size_a").to_numpy() + part.column("size_b").to_numpy()) * ((1 - similarity) / (1 + similarity)) + 1e-6
                yield part.select(["a", "b"]).filter(pa.array(np.abs(a - b).sum(1, dtype=np.int64) <= most))

    finer = durable(map_texts(_held(pairs, nodes, texts).select(F.col("print").alias("id"), "text"), "id long, size long, counts binary", each))
    for side in "ab":
        pairs = pairs.join(finer.select(F.col("id").alias(side), F.col("size").alias(f"size_{side}"), F.col("counts").alias(f"counts_{side}")), side)
    return pairs.mapInArrow(near, "a long, b long")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts have at least the similarity. nodes name one row (id, mark) of texts each."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[int, np.ndarray] = {}
            ends = [batch.column(c).to_pylist() for c in "ab"]
            for c, own in zip(("left", "right"), ends, strict=True):
                for k, node in enumerate(own):
                    if node not in sets:
                        sets[node] = np.unique(shingle_hashes((batch.column(c)[k].as_py() or "").encode(), width))
            alike = [jaccard(sets[a], sets[b]) >= similarity for a, b in zip(*ends, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    held = durable(_held(pairs, nodes, texts))
    both = pairs.join(held.select(F.col("print").alias("a"), F.col("text").alias("left")), "a").join(held.select(F.col("print").alias("b"), F.col("text").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInArrow(verify, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3, blocks: int = 6) -> DataFrame:
    """(id, print, component_id): one row per input row. component_id is the smallest id of the component."""
    docs = durable(fingerprints(df, id_col, text_col, width))
    prints = durable(docs.groupBy("print").agg(F.min("id").alias("first_id")))
    parts = connected_components(links(prints.select("print"), distance, blocks))
    named = prints.join(parts, prints["print"] == parts["node"], "left").withColumn("component", F.coalesce("component", "print"))
    named = named.join(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "component")
    return docs.join(named.select("print", "component_id"), "print").select(F.col("id").alias(id_col), "print", "component_id")


def drop_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, bands: int = 128, bits: int = 18, distance: int = 17) -> DataFrame:
    """The rows of df, one for each component of texts whose shingle sets have the Jaccard similarity: the one with the smallest id.

    The defaults of the search are made for similarities of 0.8 and more: bands keys of ``bits`` bits, ``distance`` of 64
    bits for the check. Every link is verified, and those that the search misses are found by an exact one: the components
    are those of all links. Rows without an id come last in their component; of rows alike in id and
    text one stays. Each text is fingerprinted once, and hashed once more for the exact search; rows are told apart by id and a hash of their text.
    """

    def each(ids: pa.Array, texts: list[bytes]) -> dict:
        sets = [np.unique(shingle_hashes(t, width)) for t in texts]
        words = np.stack([long_print(h) for h in sets]).view(np.int64)
        tallies = np.stack([tally(h) for h in sets]).view(np.int64)
        marks = np.array([xxhash.xxh64_intdigest(t, SEED) for t in texts], np.uint64).view(np.int64)  # as Spark's xxhash64
        named = {"id": ids, "mark": pa.array(marks), "print": pa.array([set_node(h) for h in sets], pa.int64()), "size": pa.array([len(h) for h in sets], pa.int64())}
        return named | {f"w{k}": pa.array(words[:, k]) for k in range(SPAN)} | {f"x{k}": pa.array(tallies[:, k]) for k in range(TALLY)}

    apart = ["size", *(f"x{k}" for k in range(TALLY))]
    extra = [*(f"w{k}" for k in range(SPAN)), *apart]
    docs = map_texts(texts_of(df, id_col, text_col), "id long, mark long, print long, size long, " + ", ".join(f"{c} long" for c in extra if c != "size"), each)
    docs = durable(docs.groupBy("print", "id", "mark").agg(F.count("*").alias("copies"), *(F.min(c).alias(c) for c in extra)))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("first")
    nodes = durable(docs.groupBy("print").agg(first, *(F.min(c).alias(c) for c in extra)))
    texts = texts_of(df, id_col, text_col).withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    # texts without words have equal sets, and are like no others
    pairs = durable(_candidates(nodes.where("print <> 0"), bands, bits, distance))
    parts = connected_components(_verified(pairs, nodes, texts, width, similarity))
    linked = durable(nodes.join(parts, nodes["print"] == parts["node"], "left").select("print", "first", F.coalesce("component", "print").alias("component"), *apart))
    missed = durable(_missed(texts, linked.where("print <> 0"), width, similarity))
    named = linked.select("print", "first", "component")
    if not missed.isEmpty():
        missed = durable(_near_by_finer_tallies(missed, nodes, texts, width, similarity))
        ends = _verified(missed, nodes, texts, width, similarity)
        for side in "ab":
            ends = ends.join(linked.select(F.col("print").alias(side), F.col("component").alias(f"{side}_part")), side)
        joined = connected_components(ends.select(F.col("a_part").alias("a"), F.col("b_part").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("whole"))
        named = named.join(joined, "component", "left").select("print", "first", F.coalesce("whole", "component").alias("component"))
    best = named.groupBy("component").agg(F.min("first").alias("best"))
    rows = docs.join(named.join(best, "component").select("print", "best"), "print")
    kept = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("mark") == F.col("best.mark"))
    dropped = durable(rows.where(~kept).select(F.col("id").alias("gone_id"), F.col("mark").alias("gone_mark")))
    # df's columns may have any names: each side's are named by its frame
    own_mark = F.xxhash64(F.coalesce(df[f"`{text_col}`"].cast("string"), F.lit("")))
    out = df.join(dropped, df[f"`{id_col}`"].cast("long").eqNullSafe(dropped["gone_id"]) & (own_mark == dropped["gone_mark"]), "left_anti")
    again = rows.where(kept & (F.col("copies") > 1)).select("id", "mark")
    if again.isEmpty():
        return out
    own = F.struct(F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
    one = out.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), own.alias("own"))
    return one.dropDuplicates(["own"]).select("row.*")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
