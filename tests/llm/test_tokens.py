from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from edge_rows import clashing, edge_docs, edge_rows, prose
from tokenizers import Tokenizer

from tallyline.llm import bpe, token_counts

WORD = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(WORD))


def hard_texts():
    rng = random.Random(2)
    letters = "abc ABC 019 ''s't're\n\t\x1c\x85\xa0 ​éé́ΣσςİıK 漢字かな한글\U0001f600!!..,½²Ⅷ٣ǅﬁßẞ"
    parts = ["<|startoftext|>", "<|endoftext|>", "<|end", "ΑΣ ", "aaaaaaa", "don't", "we'll", "'S", "''re"]
    texts = [
        "".join(rng.choice(letters) if rng.random() < 0.9 else rng.choice(parts) for _ in range(40))
        for _ in range(1500)
    ]
    texts += ["", " \n ", "a" * 1000, "ab" * 3000, "the" * 500, prose(1, 400, 0)]
    return texts + ["".join(rng.choice("etaoinshr") for _ in range(4000)), "é" * 700]


def test_ids_equal_the_library(encoder, library):
    texts = hard_texts()
    flat, counts = encoder.encode(texts)
    ends = np.cumsum(counts)
    for i, found in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        ids = flat[ends[i] - counts[i] : ends[i]]
        assert ids.tolist() == found.ids, texts[i][:80]
        shown = encoder.vocabulary.decode_bytes(ids).decode()
        assert shown == library.decode(found.ids, skip_special_tokens=False)


def test_forgetting_and_full_tables_change_nothing(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "TABLE", 7)
    monkeypatch.setattr(bpe, "CACHE_SYMBOLS", 50)
    small = bpe.Encoder(encoder.vocabulary)
    for text in hard_texts()[:200]:
        flat, _ = small.encode([text])
        assert flat.tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_words_merge_as_short_ones(encoder, monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choice("thean") for _ in range(rng.randint(2, 200))).encode() for _ in range(200)]
    ids, sizes = encoder.vocabulary.merge(words)
    monkeypatch.setattr(bpe, "LONG_WORD", 1)
    again, more = encoder.vocabulary.merge(words)
    assert ids.tolist() == again.tolist() and sizes.tolist() == more.tolist()


def test_encode_edge_rows(spark, library):
    found = bpe.encode(clashing(edge_docs(spark)), WORD, keep=("doc_id", "text")).collect()
    assert len(found) == len(edge_rows())
    for r in found:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        shown = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, list(r.ids)) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(shown.encode()).hexdigest()
    decoded = bpe.decode(bpe.encode(edge_docs(spark), WORD), WORD).collect()
    assert all(
        r.decoded == library.decode(list(r.ids), skip_special_tokens=False) for r in decoded
    )
    assert bpe.encode(edge_docs(spark).limit(0), WORD).count() == 0


def sections_by_character(text, coder, rule):
    """Section, start, end, tokens and crossing tokens, one character at a time."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text) or [""]
    line_of = [i for i, line in enumerate(lines) for _ in line]
    char_of = [i for i, c in enumerate(text) for _ in c.encode()]
    counts, crossing = [0.0] * len(lines), [0] * len(lines)
    at = 0
    for token in coder.encode_ordinary(text):
        size = len(coder.decode_single_token_bytes(token))
        chars = sorted({char_of[b] for b in range(at, at + size)})
        at += size
        where = [line_of[c] for c in chars]
        touched = sorted(set(where))
        for i in touched:
            crossing[i] += len(touched) > 1
        if rule == "split":
            for i in where:
                counts[i] += 1 / len(where)
        else:
            most = max(touched, key=lambda i: (where.count(i), -i))
            counts[most if rule == "most" else where[0]] += 1
    ends = np.cumsum([len(line) for line in lines])
    return [
        (i, int(e) - len(line), int(e), round(n, 6), x)
        for i, (line, e, n, x) in enumerate(zip(lines, ends, counts, crossing))
    ]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_equal_one_character_at_a_time(spark, rule):
    rng = random.Random(9)
    letters = ["\n", "\n\n", " ", "a", "the", "é", "漢", "\U0001f600", "!!\n", ".\n\n", "x\ny", "\r\n"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    texts += [t for _, t, *_ in edge_rows()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for r in token_counts.section_token_counts(df, RANKS, rule).collect():
        row = (r.section, r.start, r.end, round(r.n_tokens, 6), r.n_crossing)
        found.setdefault(r.doc_id, []).append(row)
    coder = tiktoken.Encoding(
        "t", pat_str=token_counts.PATTERN, mergeable_ranks=token_counts.read_ranks(RANKS),
        special_tokens={},
    )
    for i, text in enumerate(texts):
        assert sorted(found[i]) == sections_by_character(text, coder, rule), text[:60]


def test_sections_of_long_texts(spark):
    """White space, a word and lines of millions of characters."""
    texts = [" " * 5_000_000, " " * 3_000_000 + "x", "x" * 1_000_000, "a b\n" * 1_000_000, "!" * 1_000_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = token_counts.section_token_counts(df, RANKS).groupBy("doc_id").agg(
        {"section": "count", "end": "max", "n_tokens": "sum"}
    )
    rows = {r.doc_id: r for r in found.collect()}
    assert [rows[i]["count(section)"] for i in range(5)] == [1, 1, 1, 1_000_000, 1]
    assert [rows[i]["max(end)"] for i in range(5)] == [len(t) for t in texts]
    assert rows[3]["sum(n_tokens)"] == 3_000_000 and rows[0]["sum(n_tokens)"] > 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_counts(spark, rule):
    """The tokens of the sections are those of the texts."""
    found = token_counts.section_token_counts(clashing(edge_docs(spark)), RANKS, rule)
    rows = found.collect()
    coder = tiktoken.Encoding(
        "t", pat_str=token_counts.PATTERN, mergeable_ranks=token_counts.read_ranks(RANKS),
        special_tokens={},
    )
    total = sum(len(coder.encode_ordinary(t or "")) for _, t, *_ in edge_rows())
    assert abs(sum(r.n_tokens for r in rows) - total) < 1e-6
    empty = [r for r in rows if r.end == 0]
    assert len(empty) == 3 and all(r.n_tokens == 0 and r.start == 0 for r in empty)


def test_rules_at_borders():
    starts, ends = np.array([0, 2, 6]), np.array([2, 6, 7])
    borders = np.array([0, 3, 5, 7])  # the second token: 1, 2 and 1 characters
    counts = {r: token_counts.allocate(starts, ends, borders, r) for r in token_counts.RULES}
    assert counts["start"][0].tolist() == [2, 0, 1]
    assert counts["most"][0].tolist() == [1, 1, 1]
    assert counts["split"][0].tolist() == [1.25, 0.5, 1.25]
    assert counts["most"][1].tolist() == [1, 1, 1]
    tie = token_counts.allocate(np.array([0]), np.array([4]), np.array([0, 2, 4]), "most")
    assert tie[0].tolist() == [1, 0]
