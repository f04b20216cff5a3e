"""Each stage by itself on edge rows, and the run of all of them."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
from edge_rows import SCHEMA, clashing, edge_docs, edge_rows, prose
from tokenizers import Tokenizer

import corpus_pipeline
from tallyline.llm import secret_scan

ITEM = "the quick brown fox jumps over one lazy dog while seven more foxes sleep"
SECRET = 'api_key = "abcd1234efgh5678"'


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Labels that call insults toxic, and a benchmark of one long and one short item."""
    at = tmp_path_factory.mktemp("tables")
    labels = [(i, 1, int(i % 3 == 0)) for i in range(2000, 2090)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{at}/labels.parquet"
    )
    items = [(1, ITEM), (2, "a short item"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(
        f"{at}/benchmark.parquet"
    )
    return str(at)


def learned():
    """Documents behind the labels: every third holds an insult."""
    rows = []
    for i in range(2000, 2090):
        text = prose(i, 30) + (" you vile worthless scum" * 2 if i % 3 == 0 else "")
        rows.append((i, text, "en", "src1", len(text)))
    return rows


def rows_of(df):
    return sorted(tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()
                  if r.doc_id is not None)


def test_empty_tables_keep_their_columns(spark, tables):
    docs = clashing(edge_docs(spark)).limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, tables).columns == docs.columns
        assert stage(spark, docs, tables).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, tables).count() == 0


def test_toxicity(spark, tables):
    docs = clashing(spark.createDataFrame(learned() + edge_rows(), SCHEMA))
    kept = corpus_pipeline.drop_toxic(spark, docs, tables)
    assert kept.columns == docs.columns
    gone = {r[0] for r in learned()} - {r.doc_id for r in kept.collect()}
    assert gone == {r[0] for r in learned() if "scum" in r[1]}
    assert kept.filter("doc_id < 100 OR doc_id IS NULL").count() == len(edge_rows())


def test_decontamination(spark, tables):
    rows = edge_rows() + [
        (500, f"{prose(1, 20)} {ITEM.upper()}", "en", "s", 1), (501, ITEM[:30], "en", "s", 1),
        (502, "this is a short item too", "en", "s", 1), (500, "clean " + prose(2, 20), "en", "s", 1),
    ]
    docs = clashing(spark.createDataFrame(rows, SCHEMA))
    kept = corpus_pipeline.drop_contaminated(spark, docs, tables)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    assert len(texts) == len(rows) - 2
    assert not any(t and ("SEVEN" in t or "short item" in t) for t in texts)


def test_secrets(spark, tables):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t, *_ in edge_rows()]
    rows += [(900, f"é {SECRET}, then plain words", "en", "s", 99)]
    docs = clashing(spark.createDataFrame(rows, SCHEMA))
    found = corpus_pipeline.redact_secrets(spark, docs, tables)
    assert found.columns == docs.columns and found.count() == len(rows)
    for r in found.collect():
        assert r.text is None or not secret_scan.base_spans(r.text)
        assert r.n_chars == (None if r.text is None else len(r.text))
    one = found.filter("doc_id = 900").first()
    assert one.text.startswith("é ") and one.text.endswith("then plain words")


def test_encoding(spark, tables):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = corpus_pipeline.encode_texts(spark, clashing(edge_docs(spark)), tables).collect()
    expected = []
    for i, text, *_ in edge_rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.append((i, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.ids_sha256) for r in found), key=key) == sorted(expected, key=key)


def test_run_applies_all_stages(spark, tables, tmp_path):
    """Every stage takes out what is planted for it, and nothing else."""
    copy = prose(77, 60)
    planted = [
        (3000, copy, "en", "s", 1), (3001, copy, "en", "s", 1), (3002, f"{copy} more", "en", "s", 1),
        (3003, f"{prose(5, 30)} {ITEM}", "en", "s", 1), (3004, f"{prose(6, 30)} {SECRET}", "en", "s", 1),
        (3005, None, "en", "s", None), (3006, "", "en", "s", 0),
    ]
    rows = learned() + planted
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    toxic = {r[0] for r in learned() if "scum" in r[1]}
    assert set(found) == {r[0] for r in rows} - toxic - {3001, 3002, 3003}
    assert found[3005].n_tokens == 0 and found[3006].n_tokens == 0
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    shown = library.decode(list(found[3004].ids), skip_special_tokens=False)
    assert "abcd1234" not in shown
    plain = library.encode(learned()[0][1], add_special_tokens=False).ids
    assert list(found[2000].ids) == plain
