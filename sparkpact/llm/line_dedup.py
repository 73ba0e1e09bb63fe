"""Line dedup: lines found in several documents stay only in the smallest document that holds them.

1. Every document sends one 128-bit hash for each of its distinct line keys; Spark keeps the smallest and largest
   document id of each hash (with map-side partial aggregation, so a line that a third of all documents hold costs each
   task one row). A hash with two different ids belongs to a repeated line.
2. The repeated hashes are dealt into shards of bounded size. Each shard becomes a minimal perfect hash that indexes three
   compact arrays: a fingerprint, the smallest document id and the number of sightings.
3. Documents probe these arrays; no line text and no line table is joined. If all shards together are below
   ``broadcast_bytes``, they are broadcast and each document is cleaned where it is read. Otherwise the documents' line
   hashes are routed to copies of the shards, as many as a shard's sightings ask for, and only the numbers of the dropped
   lines come back.

Null and empty texts are one empty line. Rows that share an id are one document, and each such row is cleaned alike. A
null id counts as one document that is larger than all others. Keys shorter than ``min_chars`` code points are never
dropped. Empty tables give empty results, further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, map_texts, texts_of, utf8
from .perfect_hash import PerfectHash, mix

WHITE = b" \t\n\r\x0b\x0c"
NO_ID = (1 << 63) - 1
_CONTINUES = bytes(range(0x80, 0xC0))


def line_keys(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text and their keys: stripped of white space at both ends, A-Z lower-cased."""
    lines = text.split(b"\n")
    return lines, [line.strip(WHITE).lower() for line in lines]


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.translate(None, _CONTINUES)) >= min_chars)


def _hashes(keys: list[bytes]) -> np.ndarray:
    """An array (n, 2) of 128-bit hashes."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").astype(np.uint64).reshape(-1, 2)


def _signed(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64).view(np.int64)


def repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(high, low, first_id, sightings) of every line hash that at least two documents hold."""

    def each(ids: pa.Array, texts: list[bytes]) -> dict | None:
        high, low, doc = [], [], []
        for i, text in zip(ids.to_pylist(), texts, strict=True):
            keys = [k for k in {*line_keys(text)[1]} if long_enough(k, min_chars)]
            if keys:
                h = _hashes(keys)
                high.append(h[:, 0])
                low.append(h[:, 1])
                doc.append(np.full(len(keys), NO_ID if i is None else i))
        if not doc:
            return None
        return {"high": pa.array(_signed(np.concatenate(high))), "low": pa.array(_signed(np.concatenate(low))), "id": pa.array(np.concatenate(doc))}

    seen = map_texts(texts_of(df, id_col, text_col), "high long, low long, id long", each)
    both = seen.groupBy("high", "low").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("sightings"))
    return both.where("first_id <> last_id").select("high", "low", "first_id", "sightings")


def shard_of(high: np.ndarray, shards: int) -> np.ndarray:
    return (high.view(np.uint64) >> np.uint64(20)) % np.uint64(shards)


def mixed(high: np.ndarray, low: np.ndarray, seed: int) -> np.ndarray:
    """One 64-bit key for a 128-bit hash: two different lines may share the high half, so the low half is mixed in."""
    with np.errstate(over="ignore"):
        return high.view(np.uint64) ^ (low.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ mix(low.view(np.uint64), seed)


def build_index(repeated: DataFrame, shards: int) -> DataFrame:
    """One row for each shard: its perfect hash and its arrays, as binary."""
    shard = F.pmod(F.shiftrightunsigned("high", 20), F.lit(shards)).alias("shard")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        high, low = pdf["high"].to_numpy(np.int64), pdf["low"].to_numpy(np.int64)
        # of different hashes two may have one key under a seed: then the next seed
        seed = next(k for k in range(1000) if len(np.unique(mixed(high, low, k))) == len(high))
        keys = mixed(high, low, seed)
        table = PerfectHash.build(keys)
        at = table.index(keys)
        n = len(keys)
        prints, firsts, counts = np.zeros(n, "<u8"), np.zeros(n, "<i8"), np.zeros(n, "<u4")
        prints[at] = low.view(np.uint64)
        firsts[at] = pdf["first_id"].to_numpy(np.int64)
        counts[at] = np.minimum(pdf["sightings"].to_numpy(np.int64), (1 << 32) - 1)
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "seed": [seed], "hash": [table.to_bytes()], "prints": [prints.tobytes()], "firsts": [firsts.tobytes()], "counts": [counts.tobytes()]})

    return repeated.select(shard, "high", "low", "first_id", "sightings").groupBy("shard").applyInPandas(build, "shard long, seed long, hash binary, prints binary, firsts binary, counts binary")


class Shard:
    def __init__(self, seed: int, table: bytes, prints: bytes, firsts: bytes, counts: bytes):
        self.seed, self.table, self.prints = seed, PerfectHash.from_bytes(table), np.frombuffer(prints, "<u8")
        self.firsts, self.counts = np.frombuffer(firsts, "<i8"), np.frombuffer(counts, "<u4")

    def probe(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each line is a repeated one, the id that keeps it, and how many rows hold it."""
        at = self.table.index(mixed(high, low, self.seed))
        found = at >= 0
        found[found] = self.prints[at[found]] == low.view(np.uint64)[found]
        at = np.where(found, at, 0)
        return found, np.where(found, self.firsts[at], 0), np.where(found, self.counts[at], 0).astype(np.int64)


#: Bytes of the arrays for a line: fingerprint, keeper, count, and about 3 bits of the perfect hash.
ARRAY_BYTES = 21
ARRAYS = ("seed", "hash", "prints", "firsts", "counts")


def _clean(text: bytes, drop: set[int]) -> bytes:
    return b"\n".join(line for k, line in enumerate(text.split(b"\n")) if k not in drop) if drop else text


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, shard_keys: int = 65_536, broadcast_bytes: int = 64 << 20, salt_rows: int = 1_000_000) -> DataFrame:
    """(id, text, n_lines, n_dropped, top_sightings, row): one row per input row, with the cleaned text.

    top_sightings tells how many rows hold the most frequent of its dropped lines. row holds df's other columns.
    """
    spark = df.sparkSession
    others = [F.col(f"`{c}`") for c in df.columns if c not in (id_col, text_col)] or [F.lit(None).cast("int").alias("none")]
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.struct(*others).alias("row"))
    repeated = durable(repeated_lines(df, id_col, text_col, min_chars))
    n = repeated.count()
    shards = max(1, -(-n // shard_keys))
    index = build_index(repeated, shards)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("top_sightings", T.LongType()), docs.schema["row"]])
    if n * ARRAY_BYTES > broadcast_bytes:
        shard = F.pmod(F.shiftrightunsigned("high", 20), F.lit(shards)).alias("shard")
        # as many copies of a shard as its lines' sightings ask for: a hot line is spread over all of its shard's
        salts = repeated.groupBy(shard).agg(F.ceil(F.sum("sightings") / salt_rows).alias("salts"))
        return _routed(docs, index, durable(salts), shards, min_chars, schema, shards * 24 <= broadcast_bytes).withColumnsRenamed({"id": id_col, "text": text_col})
    # at most broadcast_bytes, as just checked
    tables = spark.sparkContext.broadcast([(r["shard"], *(r[c] for c in ARRAYS)) for r in index.collect()])
    opened: dict[int, Shard] = {}

    def each(ids: pa.Array, texts: list[bytes]) -> list:
        if not opened:
            opened.update({s: Shard(*arrays) for s, *arrays in tables.value})
        out, lines_of, dropped, ids = [], [], [], ids.to_pylist()
        doc, line, keys = [], [], []
        for d, text in enumerate(texts):
            own = line_keys(text)[1]
            lines_of.append(len(own))
            for k, key in enumerate(own):
                if long_enough(key, min_chars):
                    doc.append(d)
                    line.append(k)
                    keys.append(key)
        drop: dict[int, set[int]] = {}
        top = np.zeros(len(texts), np.int64)
        if keys and opened:
            h = _hashes(keys)
            doc_at, line_at = np.array(doc), np.array(line)
            own_id = np.array([NO_ID if i is None else i for i in ids])[doc_at]
            shard = shard_of(h[:, 0], shards)
            for s in np.unique(shard):
                if int(s) in opened:
                    mine = np.flatnonzero(shard == s)
                    found, first, sightings = opened[int(s)].probe(np.ascontiguousarray(h[mine, 0]), np.ascontiguousarray(h[mine, 1]))
                    lost = found & (first != own_id[mine])
                    gone = mine[lost]
                    np.maximum.at(top, doc_at[gone], sightings[lost])
                    for d, k in zip(doc_at[gone].tolist(), line_at[gone].tolist(), strict=True):
                        drop.setdefault(d, set()).add(k)
        for d, text in enumerate(texts):
            out.append(_clean(text, drop.get(d, ())))
            dropped.append(len(drop.get(d, ())))
        return [pa.array(ids, pa.int64()), pa.array(out, pa.binary()).cast(pa.string()), pa.array(lines_of, pa.int64()), pa.array(dropped, pa.int64()), pa.array(top)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*each(batch.column("id"), utf8(batch.column("text"))), batch.column("row")], names=schema.names)

    return docs.mapInArrow(run, schema).withColumnsRenamed({"id": id_col, "text": text_col})


def _routed(docs: DataFrame, index: DataFrame, salts: DataFrame, shards: int, min_chars: int, schema: T.StructType, small: bool) -> DataFrame:
    """The same by routing line hashes to the shards, for indexes that are too large to broadcast.

    Documents meet their dropped line numbers by id and text hash; the documents are shuffled once.
    """
    docs = docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("key", F.coalesce("id", F.lit(NO_ID)))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for key, text_hash, text in zip(batch.column("key").to_pylist(), batch.column("text_hash").to_pylist(), utf8(batch.column("text")), strict=True):
                own = [(k, x) for k, x in enumerate(line_keys(text)[1]) if long_enough(x, min_chars)]
                if own:
                    h = _hashes([x for _, x in own])
                    for column, values in zip(out, (np.full(len(own), key), np.full(len(own), text_hash), [k for k, _ in own], _signed(h[:, 0]), _signed(h[:, 1])), strict=True):
                        column.append(np.asarray(values, np.int64))
            if out[0]:
                yield pa.RecordBatch.from_pydict(dict(zip(("key", "text_hash", "line", "high", "low"), map(pa.array, map(np.concatenate, out)), strict=True)))

    lines = docs.select("key", "text_hash", "text").mapInArrow(hashes, "key long, text_hash long, line long, high long, low long")
    salts = F.broadcast(salts) if small else salts  # a row for each shard; shards without a repeated line drop out
    lines = lines.withColumn("shard", F.pmod(F.shiftrightunsigned("high", 20), F.lit(shards))).join(salts, "shard")
    lines = lines.withColumn("salt", F.pmod(F.xxhash64("key", "line"), F.col("salts")))
    copies = index.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    probes, kinds = ("key", "text_hash", "line", "high", "low"), dict(zip(ARRAYS, ("long", *["binary"] * 4), strict=True))
    one = lines.select("shard", "salt", F.lit(1).alias("kind"), *probes, *(F.lit(None).cast(k).alias(c) for c, k in kinds.items()))
    two = copies.select("shard", "salt", F.lit(0).alias("kind"), *(F.lit(None).cast("long").alias(c) for c in probes), *ARRAYS)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, table = None, None
        for batch in batches:
            shard, salt, kind = (batch.column(c).to_numpy() for c in ("shard", "salt", "kind"))
            cuts = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(salt) != 0) | (np.diff(kind) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    at, table = (shard[a], salt[a]), Shard(*(part.column(c)[0].as_py() for c in ARRAYS))
                elif at == (shard[a], salt[a]):
                    high, low, key = (part.column(c).to_numpy() for c in ("high", "low", "key"))
                    found, first, sightings = table.probe(high, low)
                    gone = np.flatnonzero(found & (first != key))
                    if len(gone):
                        yield pa.RecordBatch.from_pydict({c: part.column(c).take(pa.array(gone)) for c in ("key", "text_hash", "line")} | {"sightings": pa.array(sightings[gone])})

    both = one.unionByName(two).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    gone = both.mapInArrow(probe, "key long, text_hash long, line long, sightings long")
    gone = gone.groupBy("key", "text_hash").agg(F.collect_set("line").alias("gone"), F.max("sightings").alias("top"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, drops = utf8(batch.column("text")), [set(x or ()) for x in batch.column("gone").to_pylist()]
            out = [_clean(t, d) for t, d in zip(texts, drops, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary()).cast(pa.string()), pa.array([t.count(b"\n") + 1 for t in texts], pa.int64()), pa.array([len(d) for d in drops], pa.int64()), batch.column("top"), batch.column("row")], names=schema.names)

    return docs.join(gone, ["key", "text_hash"], "left").select("id", "text", "row", "gone", F.coalesce("top", F.lit(0).cast("long")).alias("top")).mapInArrow(clean, schema)


def drop_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", **options) -> DataFrame:
    """df with cleaned texts; chars_col, if df has it, counts their code points anew."""
    cleaned = dedup_lines(df, id_col, text_col, **options)
    fresh = {id_col: F.col(f"`{id_col}`").cast(df.schema[id_col].dataType), text_col: F.col(f"`{text_col}`"), chars_col: F.length(F.col(f"`{text_col}`")).cast("long")}
    return cleaned.select(*((fresh.get(c) if c in fresh else F.col("row").getField(c)).alias(c) for c in df.columns))


def digest(cleaned: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return cleaned.select(id_col, "n_lines", "n_dropped", F.sha2(F.col(text_col).cast("binary"), 256).alias("kept_sha256"))


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


ORACLE = r"""
WITH l AS (
  SELECT doc_id, i, lines[i] AS line,
         translate(regexp_replace(lines[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), d AS (
  SELECT k, min(doc_id) AS keeper FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), f AS (
  SELECT l.doc_id, l.i, l.line, d.keeper IS NULL OR d.keeper = l.doc_id AS kept FROM l LEFT JOIN d USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT kept) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (kept), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
