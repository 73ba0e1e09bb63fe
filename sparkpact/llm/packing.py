"""Best-fit packing of documents into fixed-size sequences by a grouping genetic algorithm on islands.

1. Documents become token ids (plus id 0 at the end) and are cut into pieces only where they exceed the sequence length.
   Full-length pieces fill a sequence each.
2. The other pieces are dealt by hash into shards of about ``shard_items`` pieces. Each shard is packed on its own, so a
   shard wastes less than one sequence against a packing of all pieces together.
3. Each shard is evolved on several islands, ``task_islands`` of all shards' to a Spark task. An individual is a list of bins. Crossover injects whole
   well-filled bins of one parent into another, removes the duplicates by dissolving the bins that held the injected
   pieces, and puts the displaced pieces back by best fit. Between epochs every island receives its neighbour's elite, and
   the best individual of all islands is the shard's packing. The first island starts with best fit decreasing among
   its individuals, so no shard is packed worse than by that; the others start from random orders alone.

Null and empty texts are one token (id 0). Rows that repeat, share an id or have a null id are packed one by one. Empty
tables give empty results; further columns are not read.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import coded_chunks, durable, slices, texts_of

#: Bytes of memory that a Python worker's cache of chunks takes, about. What half of it was filled with goes, if it was
#: not asked for again, when the other half is full.
CACHE_BYTES = 64 << 20
#: What a chunk in the cache takes besides its own bytes and those of its ids.
ENTRY = 160
#: Longer chunks are not cached.
LONG_CHUNK = 256
END = b"\0\0\0\0"
PIECE = "id long, piece int, start long, length long, ids_crc32 long, origin long"


class ChunkIds:
    """Token ids (32 bit, in the byte order of the machine, which is little-endian) of chunks between white space, as the tokenizers library gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.before, self.held = Tokenizer.from_file(path), {}, {}, 0
        vocabulary, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if suffix:
            self.ends[[k for w, k in vocabulary.items() if w.endswith(suffix)]] = True

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, parts: list[bytes], group: int = 1024) -> list[bytes]:
        """The ids of each part. Plain words go to the tokenizer many at a time: each is one pre-token and so ends with the
        only token that carries the end-of-word suffix. Where the count of such tokens says otherwise, one by one."""
        out: list[bytes] = [b""] * len(parts)
        texts = [p.decode() for p in parts]
        plain = [k for k, t in enumerate(texts) if t.isalpha()]
        single = [k for k, t in enumerate(texts) if not t.isalpha()]
        for a in range(0, len(plain), group):
            own = plain[a : a + group]
            (ids,) = self._encoded([" ".join([texts[k] for k in own])])
            cuts = (np.flatnonzero(self.ends[np.frombuffer(ids, "<u4")]) + 1) * 4
            if len(cuts) == len(own) and len(ids) == cuts[-1]:
                start = 0
                for k, end in zip(own, cuts.tolist(), strict=True):
                    out[k] = ids[start:end]
                    start = end
            else:
                single += own
        for a in range(0, len(single), 4096):
            own = single[a : a + 4096]
            for k, ids in zip(own, self._encoded([texts[k] for k in own]), strict=True):
                out[k] = ids
        return out

    def _hold(self, found: dict[bytes, bytes]) -> None:
        keep = {c: ids for c, ids in found.items() if len(c) <= LONG_CHUNK}
        size = sum(map(len, keep)) + sum(map(len, keep.values())) + ENTRY * len(keep)
        if 2 * (self.held + size) > CACHE_BYTES:
            self.before, self.known, self.held = self.known, {}, 0
        if 2 * size <= CACHE_BYTES:
            self.known.update(keep)
            self.held += size

    def look_up(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of distinct chunks, from the cache or newly encoded."""
        out = [*map(self.known.get, chunks)]
        missing = [k for k, ids in enumerate(out) if ids is None]
        if missing:
            again = [*map(self.before.get, [chunks[k] for k in missing])]
            new = [k for k, ids in zip(missing, again, strict=True) if ids is None]
            found = {chunks[k]: ids for k, ids in zip(missing, again, strict=True) if ids is not None}
            found.update(zip([chunks[k] for k in new], self.encode([chunks[k] for k in new]), strict=True))
            for k in missing:
                out[k] = found[chunks[k]]
            self._hold(found)
        return out

    def token_ids(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, with id 0 behind them."""
        distinct, codes, ends = coded_chunks(texts)
        ids, ends = self.look_up(distinct), ends.tolist()
        for a, b in zip(ends, ends[1:], strict=False):
            yield b"".join(map(ids.__getitem__, codes[a:b].tolist())) + END


@cache
def chunk_ids(path: str) -> ChunkIds:
    """One for each Python worker, which Spark reuses for many tasks."""
    return ChunkIds(path)


def document_pieces(df: DataFrame, path: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, origin): origin is another number for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = chunk_ids(path)
        origin = TaskContext.get().partitionId() << 36
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), batch.column("text")
            for a, b in slices(texts):
                rows = []
                for doc, tokens in zip(ids[a:b], chunks.token_ids(texts.slice(a, b - a)), strict=True):
                    data = memoryview(tokens)
                    n = len(data) // 4
                    for k, start in enumerate(range(0, n, size)):
                        end = min(n, start + size)
                        rows.append((doc, k, start, end - start, zlib.crc32(data[4 * start : 4 * end]), origin))
                        origin += 1
                kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "piece", "start", "length", "ids_crc32", "origin"])

    return texts_of(df, id_col, text_col).mapInArrow(run, PIECE)


class Bins:
    """A packing that grows by best fit: each piece goes where the least room is left."""

    def __init__(self, size: int):
        self.size, self.bins, self.room, self.by_room, self.rooms = size, [], [], [[] for _ in range(size + 1)], 0

    def add_bin(self, pieces: list[int], used: int) -> None:
        self.bins.append(pieces)
        self.room.append(self.size - used)
        self.by_room[self.size - used].append(len(self.bins) - 1)
        self.rooms |= 1 << (self.size - used)

    def add(self, piece: int, length: int) -> None:
        fits = self.rooms >> length
        if not fits:
            self.add_bin([piece], length)
            return
        room = length + (fits & -fits).bit_length() - 1
        k = self.by_room[room].pop()
        if not self.by_room[room]:
            self.rooms ^= 1 << room
        self.bins[k].append(piece)
        self.room[k] = room - length
        self.by_room[room - length].append(k)
        self.rooms |= 1 << (room - length)

    def bin_of(self, n: int) -> np.ndarray:
        out = np.zeros(n, np.int32)
        for k, pieces in enumerate(self.bins):
            out[pieces] = k
        return out


def best_fit(order: list[int], lengths: list[int], size: int, bins: Bins | None = None) -> Bins:
    bins = bins or Bins(size)
    for piece in order:
        bins.add(piece, lengths[piece])
    return bins


def fitness(bin_of: np.ndarray, lengths: np.ndarray, size: int) -> tuple[int, float]:
    """Fewer bins first, then the mean square of their filling."""
    fill = np.bincount(bin_of, lengths) / size
    return -len(fill), float((fill**2).mean())


def crossover(first: np.ndarray, second: np.ndarray, lengths: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """Whole well-filled bins of the second parent enter the first; displaced pieces return by best fit, long ones first."""
    fill = np.bincount(second, lengths)
    good = np.flatnonzero(fill >= size * 0.995)
    if not len(good):
        good = np.flatnonzero(fill >= np.quantile(fill, 0.75))
    chosen = good[rng.random(len(good)) < rng.uniform(0.3, 0.7)]
    injected = np.isin(second, chosen)
    torn = np.zeros(int(first.max()) + 1, bool)
    torn[first[injected]] = True
    # also open the first parent's worst bins, so that there is room to improve
    own = np.bincount(first, lengths)
    torn[np.argsort(own, kind="stable")[: max(1, len(own) // 50)]] = True
    displaced = torn[first] & ~injected
    kept = ~torn[first] & ~injected
    bins, lens = Bins(size), lengths.tolist()
    for which, labels in ((injected, second), (kept, first)):
        at = np.flatnonzero(which)
        at = at[np.argsort(labels[at], kind="stable")]
        cuts = [0, *(np.flatnonzero(np.diff(labels[at])) + 1).tolist(), len(at)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                bins.add_bin(at[a:b].tolist(), int(lengths[at[a:b]].sum()))
    # lengths fall with the piece number
    return best_fit(np.flatnonzero(displaced).tolist(), lens, size, bins).bin_of(len(lens))


def evolve(lengths: np.ndarray, size: int, seed: int, elites: list[np.ndarray], seeded: bool = True, population: int = 5, generations: int = 12, at_least: int = 3) -> np.ndarray:
    """One epoch on one island: the best individual (the bin of each piece). lengths fall; elites come from other epochs and islands.

    seeded: without an elite the first individual is best fit decreasing; all others are best fit in random order. After
    ``at_least`` generations an island is done once it has no more bins than all pieces' total length needs.
    """
    rng, lens, n = np.random.default_rng(seed), lengths.tolist(), len(lengths)
    least = -(-int(lengths.sum()) // size)
    people = [*elites]
    while len(people) < population:
        order = range(n) if seeded and not people else rng.permutation(n).tolist()
        people.append(best_fit(order, lens, size).bin_of(n))
    ranked = sorted(((fitness(p, lengths, size), p) for p in people), key=lambda x: x[0], reverse=True)
    for generation in range(generations):
        if generation >= at_least and -ranked[0][0][0] <= least:
            break
        a, b = rng.choice(len(ranked), 2, replace=False)
        child = crossover(ranked[min(a, b)][1], ranked[max(a, b)][1], lengths, size, rng)
        ranked.append((fitness(child, lengths, size), child))
        ranked = sorted(ranked, key=lambda x: x[0], reverse=True)[:population]
    return ranked[0][1]


def _shard_lengths(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "lengths": [np.sort(pdf["length"].to_numpy(np.int32))[::-1].astype("<i4").tobytes()]})


def pack(df: DataFrame, path: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", shard_items: int = 4096, islands: int = 2, epochs: int = 2, task_islands: int = 8) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece."""
    pieces = durable(document_pieces(df, path, size, id_col, text_col))
    full, rest = pieces.where(F.col("length") == size), pieces.where(F.col("length") < size)
    shards = max(1, -(-rest.count() // shard_items))
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("origin", "ids_crc32"), F.lit(shards)))

    def epoch(number: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            chunk_ids.cache_clear()  # the worker has done with texts
            for pdf in batches:
                out = []
                for shard, island, lengths, *elites in pdf[["shard", "island", "lengths", "elite", "guest"]].itertuples(index=False):
                    n = np.frombuffer(lengths, "<i4").astype(np.int64)
                    own = [np.frombuffer(e, "<i4") for e in elites if e is not None]
                    best = evolve(n, size, hash((number, shard, island)) & 0x7FFFFFFF, own, island == 0)
                    bins, filled = fitness(best, n, size)
                    out.append((shard, island, lengths, best.astype("<i4").tobytes(), bins, filled))
                yield pd.DataFrame(out, columns=["shard", "island", "lengths", "elite", "bins", "filled"])

        return run

    # a given number of partitions, which Spark doesn't merge: islands take time, not bytes
    tasks = -(-shards * islands // task_islands)
    state = rest.select("shard", "length").groupBy("shard").applyInPandas(_shard_lengths, "shard long, lengths binary")
    state = state.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("elite", F.lit(None).cast("binary"))
    for number in range(epochs):
        if number:  # each island's elite goes on to the next island
            guests = state.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("elite").alias("guest"))
            state = state.join(guests, ["shard", "island"])
        else:
            state = state.withColumn("guest", F.lit(None).cast("binary"))
        state = durable(state.repartition(tasks, "shard", "island").mapInPandas(epoch(number), "shard long, island int, lengths binary, elite binary, bins long, filled double"))
    best = state.groupBy("shard").agg(F.max_by("elite", F.struct("bins", "filled", "island")).alias("elite"))

    def place(items: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["length", "origin"], ascending=[False, True], kind="stable", ignore_index=True)
        bin_of = np.frombuffer(chosen["elite"].iloc[0], "<i4").astype(np.int64)
        items["sequence_id"] = (items["shard"].to_numpy(np.int64) << 24) + bin_of
        items["offset"] = items.groupby("sequence_id")["length"].cumsum() - items["length"]
        return items.drop(columns=["shard", "origin"])

    columns = "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = rest.groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(place, columns)
    whole = full.select("id", "piece", "start", "length", "ids_crc32", (-F.col("origin") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(whole).withColumnRenamed("id", id_col)
