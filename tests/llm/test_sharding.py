from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest
from edge_rows import SCHEMA, clashing, edge_docs, edge_rows, prose
from pyspark.sql import functions as F

from tallyline.llm import sharding


def check_law(found, rows, shards):
    assert len(found) == len(rows)
    counts = Counter(r.shard for r in found)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    expected = Counter(
        (i, len((t or "").encode()) + 16, None if t is None else zlib.crc32(t.encode()))
        for i, t, *_ in rows
    )
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == expected


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_edge_rows(spark, shards):
    docs = clashing(edge_docs(spark))
    check_law(sharding.balanced_shards(docs, shards).collect(), edge_rows(), shards)


def test_empty_table(spark):
    assert sharding.balanced_shards(edge_docs(spark).limit(0), 4).count() == 0


def test_links_are_kept_together(spark):
    rows = [(i, prose(i % 200 if i < 500 else i, 5), "en", "s", 1) for i in range(1000)]
    found = sharding.balanced_shards(spark.createDataFrame(rows, SCHEMA), 10).collect()
    check_law(found, rows, 10)
    groups = defaultdict(Counter)
    for r in found:
        if r.doc_id < 500:
            groups[r.text_crc32][r.shard] += 1
    cut = sum(sum(g.values()) - max(g.values()) for g in groups.values())
    assert cut <= 15  # of 500; placed at random nearly 300 would be


@pytest.mark.parametrize("null_texts", [False, True])
def test_one_text_of_most_rows(spark, null_texts):
    """A group far larger than a shard is cut into pieces, and sizes stay even."""
    hot = None if null_texts else "hot"
    rows = [(i, hot if i % 3 else prose(i, 4), "en", "s", 1) for i in range(600)]
    check_law(
        sharding.balanced_shards(spark.createDataFrame(rows, SCHEMA), 7).collect(), rows, 7
    )


def test_each_round_lowers_the_cut(spark):
    rows = [(i, i // 4, i % 5, i) for i in range(200)]
    nodes = spark.createDataFrame(rows, "id long, piece long, shard int, mark long")
    nodes = nodes.withColumn("mark", F.xxhash64("mark"))
    before = sharding.cut_rows(nodes)
    moved = sharding._placed(nodes, 5, 200, 64)
    assert sharding.cut_rows(moved) < before // 4
    assert {r["count"] for r in moved.groupBy("shard").count().collect()} == {40}


def test_unlinked_rows_are_spread_over_blocks(spark):
    rows = spark.range(2000).selectExpr("CAST(null AS bigint) AS piece", "xxhash64(id) AS mark")
    found = rows.groupBy(sharding._block(64).alias("block")).count()
    assert found.count() == 64 and found.agg({"count": "max"}).first()[0] < 100
    pieces = spark.range(2000).selectExpr("7L AS piece", "xxhash64(id) AS mark")
    assert pieces.select(sharding._block(64)).distinct().count() == 1


def test_large_groups_stay_together(spark):
    """Groups above an eighth of a shard stay in one; a third of all rows fills a third
    of the shards, give or take one."""
    texts = ["hot"] * 400 + [f"big {i % 5}" for i in range(250)]
    rows = [(i, texts[i] if i < 650 else prose(i, 6, 0), "en", "s", 1) for i in range(1200)]
    found = sharding.balanced_shards(spark.createDataFrame(rows, SCHEMA), 12).collect()
    check_law(found, rows, 12)
    where = defaultdict(Counter)
    for r in found:
        where[rows[r.doc_id][1]][r.shard] += 1
    assert all(len(where[f"big {i}"]) == 1 for i in range(5))
    assert len(where["hot"]) <= 5


def test_cut_is_measured_over_groups(spark):
    rows = [(7, p, s) for p, s in ((1, 0), (1, 0), (2, 1), (2, 1))]
    nodes = spark.createDataFrame(rows, "group long, piece long, shard int")
    assert sharding.cut_rows(nodes.drop("group"), 4) == 0
    assert sharding.cut_rows(nodes, 4) == 2 and sharding.cut_rows(nodes, 2) == 0
