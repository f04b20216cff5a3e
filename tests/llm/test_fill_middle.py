from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from edge_rows import SCHEMA, clashing, edge_docs, edge_rows, prose
from pyspark.sql import functions as F

from tallyline.llm import fill_middle
from tallyline.llm.arrow_text import flat_bytes


def brute(doc_id, text, seed, rate=100, spm_rate=50):
    """Straight from the definition, with string slices."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    name = "" if doc_id is None else doc_id
    h = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    x = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(lines)
    a, b = sorted((x[0] % (n + 1), x[1] % (n + 1)))
    marked = any(m in text for m in ("<P>", "<S>", "<M>"))
    if not text or marked or x[2] % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    spm = x[3] % 100 < spm_rate
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if spm else "psm", len(p), len(m), out


def check(spark, rows, docs=None, seed=7, **rates):
    docs = spark.createDataFrame(rows, SCHEMA) if docs is None else docs
    made = fill_middle.transform(docs, seed, keep=("doc_id", "text"), **rates)
    made = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    found = made.collect()
    assert len(found) == len(rows)
    for r in found:
        expected = brute(r.doc_id, r.text, seed, **rates)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == expected
        assert r.back == (r.text or "")
    return found


def odd_texts():
    rng = random.Random(4)
    parts = ["\n", "\n\n", "a", "é", "漢", "\U0001f600", "<", "<S", "P>", ">", "\r\n", " ", "\x0b"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    texts += ["<P>", "x<S>y", "a\n<M>", "<<P", "\n", "a", "a\n", "\na", "<S\n>", "P>\n<S\nM>"]
    return texts + ["".join(f"line {i} é\n" for i in range(n)) for n in (7, 8, 9, 63, 64, 65, 700)]


@pytest.mark.parametrize("rate, spm_rate", [(100, 50), (40, 100), (0, 0)])
def test_equals_slices(spark, rate, spm_rate):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(odd_texts())]
    found = check(spark, rows, rate=rate, spm_rate=spm_rate)
    forms = {r.form for r in found}
    assert forms == {100: {"plain", "psm", "spm"}, 40: {"plain", "spm"}, 0: {"plain"}}[rate]


def test_edge_rows(spark):
    check(spark, edge_rows(), clashing(edge_docs(spark)))
    assert fill_middle.transform(edge_docs(spark).limit(0), 7).count() == 0


def test_long_texts(spark):
    texts = [" " * 5_000_000, "x" * 1_000_000, "a b\n" * 1_000_000, "\n" * 1_000_000]
    check(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])


def test_every_rank_of_a_list():
    """All ranks of lists of all sizes, in lanes of their own."""
    rng = np.random.default_rng(3)
    counts = np.array([0, 1, 2, 7, 8, 9, 0, 64, 65, 513, 1], np.int64)
    points = rng.integers(1, 9, counts.sum())
    lists = fill_middle.SkipLists(points, counts)
    first = np.cumsum(counts) - counts
    for i, n in enumerate(counts.tolist()):
        ranks = np.arange(n + 1)
        found = lists.descend(np.full(n + 1, i), ranks)
        own = points[first[i] : first[i] + n]
        assert found.tolist() == np.concatenate([[0], np.cumsum(own)]).tolist()


def test_lanes_are_short():
    """Each lane has an eighth of the nodes below and spans the same units."""
    lists = fill_middle.SkipLists(np.ones(10_000, np.int64), np.array([10_000]))
    assert [len(u) for u in lists.units] == [10_000, 1250, 157, 20, 3, 1]
    assert all(u.sum() == 10_000 for u in lists.units)


def test_lines():
    data, borders = flat_bytes(pa.array(["a\nb", "", "\n", None, "x\n\n", "é"]))
    first, counts = fill_middle.line_units(data, borders)
    assert counts.tolist() == [2, 0, 1, 0, 2, 1] and len(first) == 6
    assert prose(1, 3) and fill_middle.draws([None], 7).tolist() == fill_middle.draws([""], 7).tolist()
