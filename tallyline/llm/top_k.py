"""Exact top-k by inner product of integer vectors, over an impact-ordered index.

The index of a block of rows has a posting segment for each dimension and value:
the rows that have this value there. A segment's impact on a query is the query's
component times the value, so a row's score is the sum over its segments. Segments
are added to the rows' accumulators by descending quantised impact: first the level of
all positive ones above a floor and all negative ones below a multiple of it. Within a
dimension values are in order, so these are a run of postings at either end. A dimension
of which a row got no segment raises it by no more than the largest impact left there.
With the k-th best exact score among some rows as a bound, rows that cannot reach it
are out. If too many remain, the sums are made again down to a lower floor; else those
are scored exactly. A row is dropped on proof only, so the result is exact, ties
included.

The first floor is one at which rows can be out: what all dimensions may still give is
well below the bound of a sample of rows.

Every block of rows meets every chunk of queries in a task of bounded size; each
gives k rows per query, which are ranked at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.graph import stored

BLOCK_CELLS = 1 << 21  # components of a block's vectors; a block has 1,024 rows at least
CHUNK_QUERIES = 1024
FEW = 256  # rows scored exactly without going on
STRIDE = 16  # a sample has every 16th row
_SHARE = 4  # one of so many rows may be scored exactly, which costs less than a level
_FALL = 4  # from floor to floor, and from the negative floor to the positive one
_DIMS = 8  # dimensions whose postings are added at once
_EXACT = 1 << 51  # doubles are exact for whole numbers up to four times this
_LONG = (-(1 << 63), (1 << 63) - 1)


def quantised(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component, a long (the nearest one, if it has none);
    null where the vector is null or has a null, infinite or undefined component."""
    doubles = vector.cast("array<double>")
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    floors = F.transform(doubles, lambda x: F.floor(x * F.lit(float(scale))))
    return F.when(vector.isNotNull() & ~bad, floors)


class ImpactIndex:
    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.doubles = rows.astype(np.float64)
        n, dims = rows.shape
        # In floating point, as the least long has no counterpart.
        self.largest = float(np.abs(self.doubles).max()) if rows.size else 0.0
        order = np.argsort(rows, axis=0, kind="stable").T
        values = np.take_along_axis(rows, order.T, axis=0).T
        fresh = np.ones((dims, n), bool)
        fresh[:, 1:] = values[:, 1:] != values[:, :-1]
        self.postings = order.ravel().astype(np.int32)
        self.values = values.ravel().astype(np.float64)
        self.start = np.flatnonzero(fresh.ravel())
        self.dim = self.start // n if n else self.start
        self.value = self.values[self.start]
        self.first = np.searchsorted(self.dim, np.arange(dims))
        # Used again by every query, as new memory costs as much as the work in it.
        self._hits = np.empty(_DIMS * n, np.int64)
        self._gains = np.empty(_DIMS * n)

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (score, then smaller id) of the rows with other ids."""
        weights = query.astype(np.float64)
        reach = self.largest * np.abs(weights).max(initial=0.0) * len(query)
        if reach >= _EXACT:
            return self._best_of_large(query_id, query, k)
        own = self.ids == query_id
        others = len(own) - int(own.sum())
        k = min(k, others)
        if not k:
            return self.ids[:0], self.ids[:0]
        impact = weights[self.dim] * self.value
        bound = self._bound(slice(None, None, max(1, min(STRIDE, others // FEW))), own, weights, k)
        floor, able = self._first_floor(impact, bound), np.flatnonzero(~own)
        while len(able) > max(FEW, len(own) // _SHARE):
            highest = self._accumulate(weights, impact, floor)
            highest[own] = -np.inf
            bound = max(bound, self._bound(self._leading(highest, k), own, weights, k))
            able = np.flatnonzero((highest >= bound) & ~own)
            if floor < 1:
                break
            floor /= _FALL
        scores = self.doubles[able] @ weights
        high = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        able, scores = able[high], scores[high].astype(np.int64)
        order = np.lexsort((self.ids[able], -scores))[:k]
        return self.ids[able][order], scores[order]

    def _bound(self, some, own: np.ndarray, weights: np.ndarray, k: int) -> float:
        """The k-th best exact score of some rows; the k-th best of all is no lower."""
        scores = (self.doubles[some] @ weights)[~own[some]]
        return np.partition(scores, -k)[-k] if len(scores) >= k else -np.inf

    def _first_floor(self, impact: np.ndarray, bound: float) -> float:
        """The largest impact, halved until rows may be out, or until it is below 1, when
        only impacts of zero and below are left."""
        highest = np.maximum.reduceat(impact, self.first)
        floor = max(float(highest.max()), 0.0)
        while floor >= 1 and np.minimum(highest, floor).sum() > bound * 3 / 4:
            floor /= 2
        return floor

    def _leading(self, highest: np.ndarray, k: int) -> np.ndarray:
        """About FEW rows with the highest sums, as a sample tells where those begin."""
        sample = highest[::STRIDE]
        n = min(len(sample), max(k, FEW) // STRIDE + 1)
        return np.flatnonzero(highest >= np.partition(sample, -n)[-n])[: 4 * max(k, FEW)]

    def _accumulate(self, weights: np.ndarray, impact: np.ndarray, floor: float) -> np.ndarray:
        """The highest score that each row can have, by the segments of impacts beyond the
        floors: their sum, and for the other dimensions the largest impact left there."""
        n, dims = self.rows.shape
        left = (impact <= floor) & (impact >= -_FALL * floor)
        many = np.add.reduceat(left, self.first, dtype=np.int64)
        largest = np.maximum.reduceat(np.where(left, impact, -np.inf), self.first)
        largest = np.where(many > 0, largest, 0.0)
        # Values rise within a dimension, so what is left is one run of segments.
        below = np.where(weights[self.dim] > 0, impact < -_FALL * floor, impact > floor)
        begin = self.first + np.add.reduceat(below, self.first, dtype=np.int64)
        edges = np.append(self.start, dims * n)
        low, high = edges[begin].tolist(), edges[begin + many].tolist()
        highest = np.full(n, largest.sum())
        for first in range(0, dims, _DIMS):
            runs, at = [], 0
            for d in range(first, min(first + _DIMS, dims)):
                for a, b in ((d * n, low[d]), (high[d], d * n + n)):
                    if a < b:
                        runs.append(self.postings[a:b])
                        gains = self._gains[at : at + b - a]
                        np.multiply(self.values[a:b], weights[d], out=gains)
                        gains -= largest[d]
                        at += b - a
            if runs:
                hits = np.concatenate(runs, out=self._hits[:at])
                highest += np.bincount(hits, self._gains[:at], minlength=n)
        return highest

    def _best_of_large(self, query_id: int, query: np.ndarray, k: int):
        """The same where sums may leave the whole numbers that doubles hold: all rows
        are scored with whole numbers of any size. A score that is no long is the
        nearest one, after the order is known."""
        others = np.flatnonzero(self.ids != query_id)
        scores = self.rows[others].astype(object) @ query.astype(object)
        ids = self.ids[others]
        order = sorted(range(len(others)), key=lambda i: (-scores[i], ids[i]))[:k]
        held = [min(max(scores[i], _LONG[0]), _LONG[1]) for i in order]
        return ids[order], np.array(held, np.int64)


def _table(group: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a group; shorter vectors are filled up with zeros."""
    group = group.combine_chunks()
    ids = group.column("id").to_numpy()
    lists = group.column("vector").combine_chunks()
    sizes = lists.value_lengths().to_numpy()
    rows = np.zeros((len(ids), dims), np.int64)
    rows[np.arange(dims) < sizes[:, None]] = lists.flatten().to_numpy()
    return ids, rows


def exact_top_k(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score`` for each query: a row of ``vectors``
    (``id`` long, ``vector`` array of whole numbers) for which ``is_query`` holds,
    against all rows with other ids; ties go to the smaller id.

    Rows with a null id or vector take no part. Every row is a candidate by itself, so
    an id that is given several times can take several ranks; as a query it is asked
    once, with its least vector. Where vectors differ in length, what is missing counts
    as zero; an empty vector scores 0 with all. Scores beyond a long are the nearest
    long; in this order ties between them go to the smaller id. With fewer than k other
    rows all are returned; an empty table gives no rows."""
    rows = vectors.select(
        F.col("id").cast("long").alias("id"),
        F.col("vector").cast("array<bigint>").alias("vector"),
        is_query.alias("asks"),
    )
    rows = rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull())
    rows = stored(rows, "vectors")
    asked = rows.filter("asks").groupBy("id").agg(F.min("vector").alias("vector"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dims")).first()
    dims = max(1, size["dims"] or 0)
    blocks = max(1, -(-size["n"] // max(1024, BLOCK_CELLS // dims)))
    chunks = max(1, -(-asked.count() // CHUNK_QUERIES))

    def search(key, own: pa.Table, asked: pa.Table) -> pa.Table:
        found = {"query_id": [], "vec_id": [], "score": []}
        if own.num_rows and asked.num_rows:
            index = ImpactIndex(*_table(own, dims))
            for query_id, query in zip(*_table(asked, dims)):
                ids, scores = index.best(query_id, query, k)
                found["query_id"].append(np.full(len(ids), query_id))
                found["vec_id"].append(ids)
                found["score"].append(scores)
        empty = [np.zeros(0, np.int64)]
        return pa.table({name: np.concatenate(empty + parts) for name, parts in found.items()})

    def numbered(n: int) -> Column:
        return F.sequence(F.lit(0), F.lit(n - 1))

    # By place, so that many rows of one id do not share a block.
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    index = rows.select(
        spread.alias("block"), F.explode(numbered(chunks)).alias("chunk"), "id", "vector"
    )
    spread = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(chunks)).cast("int")
    queries = asked.select(
        F.explode(numbered(blocks)).alias("block"), spread.alias("chunk"), "id", "vector"
    )
    keys = ["block", "chunk"]
    found = (
        index.groupBy(*keys)
        .cogroup(queries.groupBy(*keys))
        .applyInArrow(search, "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
