from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from edge_rows import SCHEMA, clashing, edge_docs, edge_rows, prose

from tallyline.llm import filter_audit

FIELDS = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def filters():
    return {
        "A": filter_audit.under_words(200),
        "B": filter_audit.repeats_words(50),
        "C": filter_audit.many_capitals(2),
        "D": filter_audit.matches("[#$%&*|]"),
        "E": None,
    }


def failed(rows):
    """One document at a time."""
    for i, text, _, part, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        bits = ""
        if len(words) < 200:
            bits += "A"
        if 100 * len(set(words)) < 50 * len(words):
            bits += "B"
        if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
            bits += "C"
        if re.search("[#$%&*|]", text):
            bits += "D"
        if any(
            i is not None and j is not None and j < i and (t or "") == text for j, t, *_ in rows
        ):
            bits += "E"
        yield i, part or "", bits


def brute(rows, labels):
    """Every order applied to the documents, one filter after the other."""
    found = {}
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = defaultdict(list)
    for i, part, bits in failed(rows):
        parts[part].append((i, bits))
    for part, docs in parts.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                failing = sum(f in b for _, b in docs)
                found[part, "".join(order), step] = [
                    len(left), len(gone), failing - len(gone), sum(b == f for _, b in docs),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), f,
                ]
        for (p, *_), row in found.items():
            if p == part:
                row[6] = shapley[row[6]]
    return found


def check(spark, docs, rows, labels):
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(docs, table, filters()).collect()
    got = {(r.part, r.filter_order, r.step): [r[f] for f in FIELDS] for r in found}
    assert len(got) == len(found)
    assert got == brute(rows, labels)


def more_rows():
    rows = []
    for i in range(60):
        text = prose(i % 17, 150 + 10 * (i % 17)) + (" #" if i % 3 == 0 else "")
        rows.append((100 + i, text.upper() if i % 5 == 0 else text, "en", f"s{i % 3}", 1))
    rows += [(200 + i, "same same", "en", "s0", 1) for i in range(40)]
    rows += [(90, "same same", "en", "s1", 1), (None, "same same", "en", None, 1)]
    rows += [(300, "%" * 10, "en", "s2", 1), (301, "|" * 10, "en", "s2", 1)]
    return rows + [(250, " \n one\x0btwo\x85three " * 100, "en", "s2", 1)]


@pytest.mark.parametrize("salt, few", [(5_000, 200_000), (7, 0)])
def test_equals_every_order_applied(spark, monkeypatch, salt, few):
    monkeypatch.setattr(filter_audit, "COPIES_PER_TASK", salt)
    monkeypatch.setattr(filter_audit, "BROADCAST_ROWS", few)
    rows = more_rows()
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(90, 260, 3)]
    labels += [(93, None, 1), (93, 0, None), (None, 1, 1), (5000, 1, 1)]
    check(spark, spark.createDataFrame(rows, SCHEMA), rows, labels)


def test_edge_rows(spark):
    labels = [(0, 1, 0), (5, 1, 1), (6, 0, 1)]
    check(spark, clashing(edge_docs(spark)), edge_rows(), labels)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    none = filter_audit.audit(edge_docs(spark).limit(0), table, filters())
    assert none.count() == 0 and none.columns == ["part", "filter_order", "step", *FIELDS]
    docs = edge_docs(spark)
    assert filter_audit.audit(docs, table.limit(0), filters()).filter("good_lost > 0").count() == 0


def test_long_texts(spark):
    """Five million spaces, one word of a million letters, a million lines."""
    texts = [" " * 5_000_000, "x" * 1_000_000, "a b\n" * 1_000_000, " " * 5_000_000]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    table = spark.createDataFrame([(0, 1, 1)], "doc_id long, quality int, toxic int")
    found = filter_audit.combinations(spark.createDataFrame(rows, SCHEMA), table, filters())
    assert {(r.bits, r.n) for r in found.collect()} == {(1, 2), (2, 1), (17, 1)}


def test_other_filters(spark):
    rows = [(1, "a|b", "en", "s", 1), (2, None, "en", "s", 1), (3, "a", "en", "s", 1)]
    table = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, SCHEMA)
    named = {"X": filter_audit.holds("|"), "Y": filter_audit.under_words(1)}
    found = filter_audit.audit(docs, table, named).collect()
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.shapley) for r in found}
    assert got[("XY", 1)] == (2, 1, 2) and got[("XY", 2)] == (1, 1, 2) and len(got) == 4
