from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from edge_rows import SCHEMA, clashing, edge_docs, edge_rows, prose

import corpus_pipeline
from tallyline.llm import minhash
from tallyline.llm.arrow_text import SPACES, Words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if 0 < len(words) < size:
        return {tuple(words)}
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute_groups(rows, size, percent):
    """Component of each row by all pairs; rows with null ids apart."""
    sets = [shingles(text, size) for _, text, *_ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if not sets[i] or not sets[j] or rows[i][0] is None or rows[j][0] is None:
                continue
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault(find(i), []).append(row[0])
    return [
        (row[0], len(sets[i]), None if row[0] is None else min(groups[find(i)]))
        for i, row in enumerate(rows)
    ]


def near_copies(seed, count, words, change):
    rng = random.Random(seed)
    base = prose(seed, words, 0).split(" ")
    found = []
    for _ in range(count):
        copy = list(base)
        for _ in range(rng.randint(0, change)):
            copy[rng.randrange(words)] = prose(rng.random(), 1, 0)
        found.append(" ".join(copy))
    return found


def compare(spark, rows, size, percent):
    docs = clashing(spark.createDataFrame(rows, SCHEMA))
    found = minhash.near_duplicates(docs, shingle=size, percent=percent).collect()
    expected = brute_groups(rows, size, percent)
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted([tuple(r[:3]) for r in found], key=key) == sorted(expected, key=key)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in found)


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_edge_rows(spark, size, percent):
    compare(spark, edge_rows(), size, percent)


def test_large_clusters_lose_no_link(spark, monkeypatch):
    """Clusters of many blocks, with chains that only some blocks' nodes close."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "LEADERS", 2)
    texts = near_copies(5, 70, 120, 9) + near_copies(6, 30, 40, 2) + [prose(9, 50)]
    rows = [(i * 3 + 1, t, "en", "s", 1) for i, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    compare(spark, rows, 3, 85)


def test_empty_table(spark):
    assert minhash.near_duplicates(edge_docs(spark).limit(0)).count() == 0


def test_pipeline_drops_rows_not_ids(spark):
    """Unlike texts that share an id stay; of each group the least id stays."""
    y, x = prose(1, 80, 0), prose(2, 80, 0)
    near = y + " more"
    rows = [(5, x), (5, y), (3, near), (7, "a b c d e f"), (7, "other words in this row"), (7, x)]
    rows += [(8, "same words in both of them"), (8, "same words in both of them")]
    rows += [(None, y), (9, None), (9, ""), (9, None)]
    rows += [(6, prose(20 + i, 30, 0)) for i in range(20)]
    full = [(i, t, "en", "s", 1) for i, t in rows]
    found = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(full, SCHEMA), "")
    expected = [r for i, r in enumerate(rows) if i not in (1, 5, 7)]
    assert sorted((tuple(r)[:2] for r in found.collect()), key=str) == sorted(expected, key=str)


def test_signatures_estimate_similarity():
    """Equal places of two signatures estimate the similarity of the sets, with less
    spread than independent hashing would have."""
    errors = []
    for seed in range(40):
        rng = np.random.default_rng(seed)
        keys = rng.integers(0, 2**63, 90).astype(np.uint64)
        a, b = np.sort(keys[:70]), np.sort(keys[20:])  # similarity 50 / 90
        flat = np.concatenate([a, b])
        of = np.repeat([0, 1], [len(a), len(b)])
        minima = minhash.superminhash(flat, of, 2, 181)
        errors.append((minima[0] == minima[1]).mean() - 50 / 90)
    spread = np.sqrt(50 / 90 * 40 / 90 / 181)
    assert abs(np.mean(errors)) < spread / 2
    assert np.std(errors) < spread


def test_early_stop_equals_all_rounds(monkeypatch):
    words = Words(pa.array([prose(4, 900), "a b c d e f g h", ""]), SPACES)
    flat, of, _ = minhash.shingle_sets(words, 3)
    whole = minhash.superminhash(flat, of, 3, 61)
    for text in (0, 1):
        alone = minhash.superminhash(flat[of == text], of[of == text] * 0, 1, 61)
        assert (alone[0] == whole[text]).all()
    assert (whole[:2] >> np.uint64(55) < 61).all()


def test_intersections_in_column_steps(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, 120).astype(np.uint64)) for _ in range(9)]
    expected = [[len(set(a.tolist()) & set(b.tolist())) for b in sets[4:]] for a in sets[:4]]
    monkeypatch.setattr(minhash, "_CELLS", 100)
    assert minhash.shared_counts(sets[:4], sets[4:]).tolist() == expected


def test_many_rows_of_one_set(spark, monkeypatch):
    """Equal rows with one id, and equal texts of many ids, beside near copies."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    texts = near_copies(8, 24, 60, 4)
    rows = [(5, texts[0], "en", "s", 1)] * 150
    rows += [(i + 10, t, "en", "s", 1) for i, t in enumerate(texts)]
    rows += [(i + 50, texts[1], "en", "s", 1) for i in range(20)]
    compare(spark, rows, 3, 85)
