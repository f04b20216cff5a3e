from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm import top_k


def brute(rows, k):
    found = []
    for q, x in rows:
        if q % 20:
            continue
        scores = sorted((-int(x @ y), i) for i, y in rows if i != q)[:k]
        found += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(found)


@pytest.mark.parametrize("cells, chunk, few", [(1 << 22, 512, 256), (1, 3, 1)])
def test_equals_brute_force(spark, monkeypatch, cells, chunk, few):
    monkeypatch.setattr(top_k, "BLOCK_CELLS", cells)
    monkeypatch.setattr(top_k, "CHUNK_QUERIES", chunk)
    monkeypatch.setattr(top_k, "FEW", few)
    rng = np.random.default_rng(1)
    data = np.round(rng.normal(size=(240, 8)) * 2) / 8  # many ties
    data[50:90] = data[50]
    rows = [(i, data[i]) for i in range(240)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in rows], "id long, e array<float>")
    df = df.select("id", top_k.quantised(F.col("e"), 64).alias("vector"), F.lit(1).alias("rank"))
    found = top_k.exact_top_k(df, F.col("id") % 20 == 0, 20).collect()
    whole = [(i, np.floor(64 * x).astype(int)) for i, x in rows]
    assert sorted(tuple(r) for r in found) == brute(whole, 20)


def test_edge_vectors(spark):
    rows = [
        (0, [1.0, 0.5]), (0, [1.0, 0.5]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]),
        (4, [float("inf"), 1.0]), (5, []), (6, [-1.0]), (None, [1.0, 1.0]), (7, [1e300, 0.0]),
        (20, [0.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "id long, e array<double>")
    df = df.select("id", top_k.quantised(F.col("e"), 64).alias("vector"))
    found = top_k.exact_top_k(df, F.col("id") % 20 == 0, 3).collect()
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in found}
    assert got[(0, 1)] == (7, 2**63 - 1) and got[(0, 2)] == (5, 0) and got[(0, 3)] == (20, 0)
    # Both rows with id 0 are candidates.
    assert [got[(20, n)] for n in (1, 2, 3)] == [(0, 0), (0, 0), (5, 0)]
    assert top_k.exact_top_k(df.limit(0), F.col("id") % 20 == 0, 3).count() == 0


def test_blocks_of_large_and_small_vectors(spark, monkeypatch):
    """Several blocks; components of all sizes up to 2^50 against whole numbers of Python."""
    monkeypatch.setattr(top_k, "CHUNK_QUERIES", 7)
    rng = np.random.default_rng(5)
    data = rng.normal(size=(2600, 3)) * 2.0 ** rng.integers(0, 25, (2600, 1))
    rows = [(i, x.tolist()) for i, x in enumerate(data)]
    monkeypatch.setattr(top_k, "BLOCK_CELLS", 1)
    df = spark.createDataFrame(rows, "id long, e array<double>")
    df = df.select("id", top_k.quantised(F.col("e"), 64).alias("vector"))
    found = top_k.exact_top_k(df, F.col("id") % 20 == 0, 5).collect()
    whole = [(i, np.array([int(v) for v in np.floor(64 * x)], object)) for i, x in enumerate(data)]
    assert sorted(tuple(r) for r in found) == brute(whole, 5)


def test_components_beyond_a_million(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0**21]), (2, [-(2.0**40)])], "id long, e array<double>")
    df = df.select("id", top_k.quantised(F.col("e"), 64).alias("vector"))
    found = top_k.exact_top_k(df, F.col("id") == 0, 3).collect()
    assert [(r.vec_id, r.score) for r in found] == [(1, 64 * 64 * 2**21), (2, -64 * 64 * 2**40)]


def test_every_row_of_an_id_is_a_candidate(spark):
    rows = [(0, [1.0]), (5, [3.0]), (5, [2.0]), (5, [3.0]), (6, [2.5]), (40, [9.0]), (40, [1.0])]
    df = spark.createDataFrame(rows, "id long, e array<double>").repartition(3)
    df = df.select("id", top_k.quantised(F.col("e"), 1).alias("vector"))
    found = top_k.exact_top_k(df, F.col("id") % 20 == 0, 10).collect()
    got = {q: [(r.vec_id, r.score) for r in found if r.query_id == q] for q in (0, 40)}
    assert got[0] == [(40, 9), (5, 3), (5, 3), (5, 2), (6, 2), (40, 1)]
    # Asked with its least vector, against all rows of other ids.
    assert got[40] == [(5, 3), (5, 3), (5, 2), (6, 2), (0, 1)]


def _index_best(ids, rows, query_id, query, k):
    scores = rows.astype(object) @ query.astype(object)
    order = sorted((-s, i) for s, i in zip(scores, ids.tolist()) if i != query_id)[:k]
    return [(i, -s) for s, i in order]


@pytest.mark.parametrize("kind", ["normal", "positive", "negative", "few values", "copies", "zeros"])
def test_index_equals_brute_force(kind):
    rng = np.random.default_rng(7)
    for n, dims, k in [(1, 1, 20), (19, 3, 20), (300, 9, 20), (700, 17, 400), (5000, 24, 20)]:
        rows = np.floor(rng.normal(size=(n, dims)) * 9).astype(np.int64)
        if kind == "positive":
            rows = np.abs(rows)
        elif kind == "negative":
            rows[1:] = -np.abs(rows[1:])
        elif kind == "few values":
            rows = np.sign(rows)
        elif kind == "copies":
            rows[n // 3 :] = rows[n // 3]
        elif kind == "zeros":
            rows[:, ::2] = 0
            rows[: n // 2] = 0
        ids = rng.permutation(n)
        ids[-(n // 10) :] = ids[0]  # some rows share an id
        index = top_k.ImpactIndex(ids, rows)
        for at in (0, n // 2, n - 1):
            for query in (rows[at], np.abs(rows[at]), -rows[at], rows[at] * 1000):
                found, scores = index.best(ids[at], query, k)
                expected = _index_best(ids, rows, ids[at], query, k)
                assert list(zip(found.tolist(), scores.tolist())) == expected


def test_index_up_to_the_limit_of_doubles():
    rng = np.random.default_rng(8)
    rows = rng.integers(-(1 << 23), 1 << 23, size=(3000, 4))
    index = top_k.ImpactIndex(np.arange(3000), rows)
    query = rng.integers(-(1 << 25), 1 << 25, size=4)
    assert index.largest * np.abs(query).max() * 4 < top_k._EXACT
    found, scores = index.best(5, query, 20)
    assert list(zip(found.tolist(), scores.tolist())) == _index_best(
        index.ids, rows, 5, query, 20
    )


def test_a_query_orders_few_rows(monkeypatch):
    """On vectors without clusters; ordering the rows once per level took most of the time."""
    ordered = []
    for name in ("argpartition", "partition", "argsort", "lexsort"):

        def counted(values, *args, plain=getattr(np, name), **named):
            ordered.append(np.shape(values)[-1])
            return plain(values, *args, **named)

        monkeypatch.setattr(np, name, counted)
    rng = np.random.default_rng(9)
    rows = np.floor(rng.normal(size=(20000, 64)) * 8).astype(np.int64)
    index = top_k.ImpactIndex(np.arange(20000), rows)
    ordered.clear()
    for at in range(10):
        index.best(at, rows[at], 20)
    assert sum(ordered) < 10 * 20000 / 2
