from __future__ import annotations

import random
import re

import pytest
from edge_rows import SCHEMA, clashing, edge_docs, edge_rows, prose

from tallyline.llm import decontaminate

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(rows, items, window):
    windows = {}
    for item, text in items:
        found = words(text)
        size = min(window, len(found))
        for i in range(len(found) - size + 1 if found and item is not None else 0):
            windows.setdefault(tuple(found[i : i + size]), set()).add(item)
    sizes = {len(w) for w in windows}
    result = []
    for doc, text, *_ in rows:
        found, hit, names = words(text), set(), set()
        for size in sizes:
            for i in range(len(found) - size + 1):
                if (w := tuple(found[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    names |= windows[w]
        result.append((doc, len(found), len(hit), sorted(names)))
    return result


def compare(spark, rows, items, window=10, gram=6):
    docs = clashing(spark.createDataFrame(rows, SCHEMA))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(docs, bench, window, gram).collect()
    got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in found]
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(got, key=key) == sorted(brute(rows, items, window), key=key)
    assert all(r.contaminated == (r.n_hit > 0) for r in found)


def planted(seed):
    rng = random.Random(seed)
    items = [(i, prose(1000 + i, rng.randint(8, 40), 30)) for i in range(20)]
    rows = []
    for i in range(60):
        text = prose(i, rng.randint(0, 200), 30).split(" ")
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(items)[1].split(" ")
            a = rng.randrange(len(part))
            at = rng.randint(0, len(text))
            text[at:at] = part[a : a + rng.randint(5, 30)]
        rows.append((i, " ".join(text), "en", "s", 1))
    return rows, items


@pytest.mark.parametrize("few", [500_000, 0])
def test_planted_passages(spark, monkeypatch, few):
    """Also without any broadcast."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", few)
    compare(spark, *planted(few))


def test_edge_rows_and_short_items(spark):
    items = [(1, "word word word"), (2, "ONE"), (3, None), (4, ""), (5, "?!"), (None, "two words")]
    items += [(6, "x" * 3000), (7, " ".join(["word"] * 30)), (2, "two"), (8, prose(1, 60)[:90])]
    compare(spark, edge_rows(), items)


def test_runs_longer_than_a_mark(spark):
    """One repeated word makes equal minima over a whole text."""
    rows = [(1, "same " * 700 + "other", "en", "s", 1), (2, "same " * 9, "en", "s", 1)]
    compare(spark, rows, [(1, "same " * 12)])


@pytest.mark.parametrize("window, gram", [(4, 4), (5, 2), (10, 6)])
def test_other_sizes(spark, window, gram):
    compare(spark, *planted(7), window, gram)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(edge_docs(spark).limit(0), none).count() == 0
    found = decontaminate.contamination(edge_docs(spark), none).collect()
    assert len(found) == len(edge_rows()) and not any(r.contaminated for r in found)
