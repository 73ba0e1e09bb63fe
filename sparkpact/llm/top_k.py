"""Exact top-k search by inner product, by distributed histogram selection.

Vectors are turned into integers, floor(scale * x). Queries and candidates are dealt by hash into a grid of cells of some
thousands of either, so that a cell costs far more arithmetic than it costs to ship. Every pass scores all cells. Its tasks
count, for each query, the scores in ``bins`` equal parts of the interval that holds the kth best score; the counts of all
tasks are added up, and the part in which the kth lies is the next interval. A query is settled once its part holds few rows or
is one score wide. Then a last pass keeps what reaches the interval's lower end, of each cell the k best, and ranks it. Scores
are never stored, and what a task sends grows with its queries and k alone: of a cell's histogram only the upper parts that hold
its first k scores can matter.

Null ids, null vectors and vectors with null or non-finite components take no part. Of rows that share an id, the smallest vector
counts (in the order of arrays). Vectors of different lengths are compared over the places that both have, so an empty vector
scores 0. Products are exact; those beyond the range of a long count as its end. Equal scores are ranked by id. Tables without
queries give no rows, queries without other rows none either, and columns that aren't named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable

#: Queries and candidates in a cell of the grid, parts of a histogram, and scores that need no further pass.
QUERIES, CANDIDATES, BINS, ENOUGH = 2048, 4096, 512, 32
#: Candidates that are scored at a time.
STRIP = 512
LEAST, MOST = -(2**63) + 1, 2**63 - 1


def _integers(x: np.ndarray, scale: int, exact: bool) -> np.ndarray:
    """floor(scale * x): doubles where these are exact, else Python's integers."""
    if not exact:
        return np.floor(x * scale)
    whole = np.frompyfunc(lambda v: int(v) * scale if abs(v) >= 2**52 else math.floor(v * scale), 1, 1)
    return whole(x) if x.size else x.astype(object)


def _matrix(column: pa.Array, scale: int, exact: bool) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    ends = column.offsets.to_numpy()
    flat = _integers(column.values.slice(ends[0], ends[-1] - ends[0]).cast(pa.float64()).to_numpy(zero_copy_only=False), scale, exact)
    sizes = np.diff(ends)
    wide = int(sizes.max(initial=0))
    if (sizes == wide).all():
        return flat.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide), flat.dtype)
    out[np.arange(wide) < sizes[:, None]] = flat
    return out


def _scores(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as 64-bit integers, candidates in rows and queries in columns."""
    wide = min(a.shape[1], b.shape[1])
    found = a[:, :wide] @ b[:, :wide].T
    if not exact:
        return found.astype(np.int64)
    found = np.array(found, object).reshape(len(a), len(b)) if wide else np.zeros((len(a), len(b)), object)
    return np.clip(found, LEAST, MOST).astype(np.int64)


class _Cell:
    """The queries of a cell, its candidates as they come, and what is gathered from their scores."""

    def __init__(self, batch: pa.RecordBatch, scale: int, exact: bool):
        self.exact, self.scale = exact, scale
        self.ids = batch.column("id").to_numpy()
        self.vectors = _matrix(batch.column("vector"), scale, exact)
        self.low, self.high, self.need = (batch.column(n).to_numpy() for n in ("low", "high", "need"))

    def joined(self, other: "_Cell") -> "_Cell":
        wide = max(self.vectors.shape[1], other.vectors.shape[1])
        self.vectors = np.concatenate([np.pad(x.vectors, ((0, 0), (0, wide - x.vectors.shape[1]))) for x in (self, other)])
        for n in ("ids", "low", "high", "need"):
            setattr(self, n, np.concatenate([getattr(self, n), getattr(other, n)]))
        return self

    def strips(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, scores, which of them count): a query's own row doesn't."""
        ids, vectors = batch.column("id").to_numpy(), _matrix(batch.column("vector"), self.scale, self.exact)
        for k in range(0, len(ids), STRIP):
            own = ids[k : k + STRIP]
            yield own, _scores(vectors[k : k + STRIP], self.vectors, self.exact), own[:, None] != self.ids


class _Histogram(_Cell):
    """Counts of scores by part of each query's interval, the highest part last. The last parts may be shorter, or empty."""

    def __init__(self, batch: pa.RecordBatch, scale: int, exact: bool, bins: int):
        super().__init__(batch, scale, exact)
        self.bins, self.counts = bins, None

    def take(self, batch: pa.RecordBatch) -> None:
        if self.counts is None:
            self.counts = np.zeros(len(self.ids) * self.bins, np.int64)
        rows = np.arange(len(self.ids)) * self.bins
        # from the lower end as an unsigned number: an interval may be wider than half the range of a long
        low, width = self.low.astype(np.uint64), self._width()
        for _, scores, counts in self.strips(batch):
            part = (scores.astype(np.uint64) - low) // width
            places = (part.astype(np.int64) + rows)[counts & (scores >= self.low) & (scores <= self.high)]
            self.counts += np.bincount(places, minlength=len(self.counts))

    def _width(self) -> np.ndarray:
        return (self.high.astype(np.uint64) - self.low.astype(np.uint64)) // np.uint64(self.bins) + np.uint64(1)

    def given(self) -> dict | None:
        if self.counts is None:
            return None
        down = self.counts.reshape(-1, self.bins)[:, ::-1]
        higher = np.cumsum(down, axis=1) - down
        q, part = np.nonzero((down > 0) & (higher < self.need[:, None]))
        width = self._width()[q]
        edges = self.low[q].astype(np.uint64) + (self.bins - 1 - part).astype(np.uint64) * width
        upper = edges + np.minimum(width - np.uint64(1), self.high[q].astype(np.uint64) - edges)
        return {"query_id": self.ids[q], "edge": edges.astype(np.int64), "upper": upper.astype(np.int64), "n": down[q, part]}


class _Best(_Cell):
    """Of each query the k best that reach its interval's lower end."""

    def __init__(self, batch: pa.RecordBatch, scale: int, exact: bool, k: int):
        super().__init__(batch, scale, exact)
        self.k, self.held = k, [np.zeros(0, np.int64)] * 3

    def take(self, batch: pa.RecordBatch) -> None:
        for ids, scores, counts in self.strips(batch):
            c, q = np.nonzero(counts & (scores >= self.low))
            found = [np.concatenate(x) for x in zip(self.held, (q, scores[c, q], ids[c]), strict=True)]
            order = np.lexsort((found[2], ~found[1], found[0]))
            q = found[0][order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            self.held = [x[order][place < self.k] for x in found]

    def given(self) -> dict:
        return {"query_id": self.ids[self.held[0]], "vec_id": self.held[2], "score": self.held[1]}


def _over_cells(make: Callable[[pa.RecordBatch], _Cell]) -> Callable:
    """Runs over sorted cells: each one's queries come first, then its candidates, in as many batches as they fill."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cell = None, None

        def ended() -> Iterator[pa.RecordBatch]:
            if cell is not None and (out := cell.given()):
                yield pa.RecordBatch.from_pydict(out)

        for batch in batches:
            r, c, role = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("r", "c", "role"))
            cuts = np.flatnonzero((np.diff(r) != 0) | (np.diff(c) != 0) | (np.diff(role) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(r)], strict=True):
                if a == b:
                    continue
                part, key = batch.slice(a, b - a), (int(r[a]), int(c[a]))
                if key != at:
                    yield from ended()
                    at, cell = key, None
                if role[a] == 0:
                    cell = make(part) if cell is None else cell.joined(make(part))
                elif cell is not None:  # else no query was dealt to this row of the grid
                    cell.take(part)
        yield from ended()

    return run


def _grid(queries: DataFrame, candidates: DataFrame, n_queries: int, n_candidates: int) -> DataFrame:
    """Both dealt to the cells of a grid: a query to one row's cells, a candidate to one column's. Ids are unique, so hashes
    deal evenly whatever the vectors are."""
    high, wide = max(1, -(-n_queries // QUERIES)), max(1, -(-n_candidates // CANDIDATES))
    of = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(of(1, high).alias("r"), every(wide).alias("c"), F.lit(0).alias("role"), "id", "vector", "low", "high", "need")
    nothing = F.lit(None).cast("long")
    other = candidates.select(every(high).alias("r"), of(2, wide).alias("c"), F.lit(1).alias("role"), "id", "vector", nothing.alias("low"), nothing.alias("high"), nothing.alias("need"))
    session = queries.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), min(2 * high * wide, 32 * session.sparkContext.defaultParallelism))
    return asked.unionAll(other).repartition(parts, "r", "c").sortWithinPartitions("r", "c", "role")


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows that take part, one for each id."""
    v = F.col(f"`{vector_col}`")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    rows = rows.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))))
    if rows.groupBy("id").count().where("count > 1").isEmpty():
        return rows
    return durable(rows.groupBy("id").agg(F.min("vector").alias("vector")))


def exact_top_k(df: DataFrame, k: int = 5, is_query: Column | None = None, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, bins: int = BINS, enough: int = ENOUGH) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query the k best among all other rows. is_query: a condition on ``id``."""
    rows = usable(df, id_col, vector_col)
    asks = F.col("id") % 50 == 0 if is_query is None else is_query
    size = F.aggregate("vector", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))
    n, n_queries, length, largest = rows.agg(F.count("*"), F.count_if(asks), F.max(F.size("vector")), F.max(size)).first()
    reach = int(largest or 0.0) * scale + scale + 1  # above every component's size
    bound = reach * reach * max(1, length or 0)
    exact = bound >= 2**53  # doubles hold all products and sums below
    state = rows.where(asks).select("id", F.lit(max(-bound, LEAST)).alias("low"), F.lit(min(bound, MOST)).alias("high"), F.lit(k).cast("long").alias("need"), F.lit(False).alias("settled"))
    while n_queries:
        open_ones = state.where("NOT settled")
        left = open_ones.count()
        if not left:
            break
        asked = rows.join(open_ones.drop("settled"), "id")
        counted = _grid(asked, rows, left, n).mapInArrow(_over_cells(lambda b: _Histogram(b, scale, exact, bins)), "query_id long, edge long, upper long, n long")
        counted = counted.groupBy("query_id", "edge").agg(F.first("upper").alias("upper"), F.sum("n").alias("n"))
        higher = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("edge"))) - F.col("n")  # at most ``bins`` rows
        counted = counted.withColumn("higher", higher).withColumnRenamed("query_id", "id")
        found = open_ones.select("id", "need").join(counted, "id").where("higher < need AND higher + n >= need")
        found = durable(found.select("id", F.col("edge").alias("low"), F.col("upper").alias("high"), (F.col("need") - F.col("higher")).alias("need"), ((F.col("n") <= enough) | (F.col("edge") == F.col("upper"))).alias("settled")))
        # a query with fewer than k other rows keeps them all
        short = open_ones.join(found.select("id"), "id", "left_anti").withColumns({"low": F.lit(LEAST), "settled": F.lit(True)})
        state = durable(state.where("settled").unionByName(found).unionByName(short))
    asked = rows.join(state.select("id", "low", "high", "need"), "id")
    best = _grid(asked, rows, n_queries, n).mapInArrow(_over_cells(lambda b: _Best(b, scale, exact, k)), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
