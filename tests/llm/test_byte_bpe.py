from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from edge_rows import SCHEMA, clashing, edge_docs, edge_rows, prose

from tallyline.llm import byte_bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={}
    )


def check(found, library):
    for r in found:
        ids = library.encode_ordinary(r.text or "")
        assert (list(r.ids), r.n_tokens) == (ids, len(ids))
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def hard_texts():
    rng = random.Random(2)
    letters = "abc ABC 019 ''s't're\n\t\x1c\x85\xa0 ​éé́ΣσςİıK 漢字かな한글\U0001f600!!..,½²Ⅷ٣ǅﬁßẞ͸"
    texts = ["".join(rng.choice(letters) for _ in range(60)) for _ in range(600)]
    return texts + ["a" * 1000, "ab" * 3000, "<|endoftext|>", " 's 't", "x\r\n  y", prose(1, 400, 0)]


def test_latin_texts_split_alike():
    rng = random.Random(6)
    letters = [chr(i) for i in range(byte_bpe.LATIN)] + list(" \n'st  ae19!\xa0\x85" * 20)
    whole, latin = regex.compile(PATTERN), byte_bpe.latin_pattern(PATTERN)
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(80))
        assert latin.findall(text) == whole.findall(text)
    for point in range(byte_bpe.LATIN):
        text = f"a{chr(point)}1{chr(point)} {chr(point)}! {chr(point) * 2}a"
        assert latin.findall(text) == whole.findall(text)
    split = byte_bpe.splitter(PATTERN)
    assert split("aɏ ɐb 漢\u3000 字") == whole.findall("aɏ ɐb 漢\u3000 字")
    assert byte_bpe.latin_pattern(r"\w+") is None
    assert byte_bpe.splitter(r"\w+|\W")("ab c") == ["ab", " ", "c"]


# All words by the table, a few, and none.
@pytest.mark.parametrize("frequent", [1 << 19, 40, 0])
def test_equals_the_library(spark, library, frequent):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(hard_texts() * 2)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    kept = ("doc_id", "text")
    found = byte_bpe.encode(docs, RANKS, PATTERN, keep=kept, frequent=frequent).collect()
    assert sorted(r.doc_id for r in found) == list(range(len(rows)))
    check(found, library)


@pytest.mark.parametrize("frequent", [1 << 19, 0])
def test_edge_rows(spark, library, frequent):
    docs = clashing(edge_docs(spark)).toDF(*[
        {"id": "key", "node": "fills", "shard": "stream", "slot": "ids"}.get(c, c)
        for c in clashing(edge_docs(spark)).columns
    ])
    coded = byte_bpe.encode(docs, RANKS, PATTERN, keep=("doc_id", "text"), frequent=frequent)
    found = coded.collect()
    assert len(found) == len(edge_rows())
    check(found, library)
    plain = byte_bpe.decode(coded, RANKS).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in plain)
    assert byte_bpe.encode(edge_docs(spark).limit(0), RANKS, PATTERN).count() == 0


def test_long_texts(spark, library):
    texts = ["x" * 1_000_000, "a b\n" * 1_000_000, " " * 5_000_000, " " * 3_000_000 + "x"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = byte_bpe.encode(docs, RANKS, PATTERN, keep=("doc_id", "text")).collect()
    check([r for r in found if r.doc_id < 2], library)
    # The library's own split overflows its stack on these; its merges do not.
    whole = byte_bpe.word_encoder(byte_bpe.read_ranks(RANKS))
    spaces = {2: whole(texts[2]), 3: whole(" " * 2_999_999) + whole(" x")}
    for r in found:
        if r.doc_id in spaces:
            assert list(r.ids) == spaces[r.doc_id]
            assert r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_a_hot_text_is_spread(spark, library):
    """Copies without rare words do not share a key; those with one share few."""
    text = prose(1, 50)
    docs = spark.createDataFrame([(i, text, "en", "s", 1) for i in range(500)], SCHEMA)
    texts = docs.selectExpr("text AS _text")
    words = byte_bpe.frequent_words(texts, PATTERN, byte_bpe.read_ranks(RANKS), 1 << 10)
    numbers = spark.sparkContext.broadcast({w: i + 1 for i, (w, _) in enumerate(words)})
    assert byte_bpe.rare_places(texts, PATTERN, numbers).count() == 0
    streams = byte_bpe.numbered_texts(texts, ["_text"], PATTERN, numbers)
    assert streams.select("key").distinct().count() == 500


def test_each_rare_word_is_encoded_once(spark):
    places = [("word", b"k%d" % i, i) for i in range(300)] + [("other", b"k", 1)]
    df = spark.createDataFrame(places, "word string, key binary, pos int").repartition(7)
    shared = spark.sparkContext.broadcast(byte_bpe.read_ranks(RANKS))
    found = byte_bpe.encoded_once(df, shared).collect()
    assert len(found) == 301 and len({bytes(r.ids) for r in found}) == 2
    plan = byte_bpe.encoded_once(df, shared)._jdf.queryExecution().toString()
    assert "hashpartitioning(word" in plan


def test_most_frequent_first(spark):
    docs = spark.createDataFrame([("b b b a a a c",), ("a a b",)], "_text string").coalesce(1)
    ranks = byte_bpe.read_ranks(RANKS)
    assert [w for w, _ in byte_bpe.frequent_words(docs, PATTERN, ranks, 2)] == [" a", " b"]
    assert byte_bpe.frequent_words(docs.limit(0), PATTERN, ranks, 2) == []


def test_streams_keep_numbers():
    for numbers in ([], [0], [1, 0, (1 << 24) - 1, 5] * 9):
        assert byte_bpe.unpacked(byte_bpe.packed(np.array(numbers, np.int64))).tolist() == numbers


def test_a_gap_without_ids_is_an_error():
    table = byte_bpe.WordTable([np.array([7, 8], "<u4").tobytes()])
    fills = [{"pos": 1, "ids": np.array([5], "<u4").tobytes()}]
    assert table.ids_of(np.array([1, 0, 1]), fills).tolist() == [7, 8, 5, 7, 8]
    with pytest.raises(KeyError):
        table.ids_of(np.array([0, 1]), fills)
