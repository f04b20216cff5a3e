"""Token counts by section, from one encoding of each whole document.

A document is encoded once. Tokens cover its bytes without gaps, so running sums
of their sizes give every token's span of characters. Sections are spans of the
same text (lines here); spans of tokens and sections are joined as intervals. A
token over a border is allocated by a rule:

``start``  to the section in which its first character stands;
``most``   to the section that has most of its characters, the first if equal;
``split``  to every section it touches, in proportion to its characters there.

A token that holds part of a character belongs to that whole character.
"""

from __future__ import annotations

import base64
import re
from functools import partial

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.llm.arrow_text import flat_bytes, pieces

# Fixed value of the vocabulary: how text is split before merging.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
RULES = ("start", "most", "split")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, file)}


_LONG_SPACE = re.compile(r"\s{1000}")


class TextEncoder:
    """Ids of whole texts. The library's split overflows its stack on very long white
    space; such texts are split apart from it, and their words encoded one by one."""

    def __init__(self, ranks: dict[bytes, int]):
        coder = partial(tiktoken.Encoding, mergeable_ranks=ranks, special_tokens={})
        self.whole = coder("tokens", pat_str=PATTERN).encode_ordinary
        self.word = coder("words", pat_str=r"(?s:.+)").encode_ordinary
        self.split = regex.compile(PATTERN).findall

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        if _LONG_SPACE.search(text) is None:
            return self.whole(text)
        return [i for word in self.split(text) for i in self.word(word)]


def token_spans(sizes: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last character + 1 of each token, from the tokens' byte sizes."""
    head = (data & 0xC0) != 0x80  # bytes that begin a character
    chars = np.concatenate([[0], np.cumsum(head)])
    ends = np.cumsum(sizes)
    return chars[ends - sizes + 1] - 1, chars[ends]


def line_borders(data: np.ndarray) -> np.ndarray:
    """Character borders of the lines; a line keeps its end."""
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    at = np.flatnonzero(data == ord("\n")) + 1
    borders = np.concatenate([[0], chars[at], [chars[-1]]])
    return np.unique(borders)


def allocate(starts, ends, borders, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section (a count, or a sum of parts), and how many tokens
    that touch a section also touch another."""
    n = len(borders) - 1
    low = np.searchsorted(borders, starts, "right") - 1
    high = np.searchsorted(borders, ends, "left") - 1
    crossing = low < high
    touched = np.zeros(n + 1, np.int64)
    np.add.at(touched, low[crossing], 1)
    np.add.at(touched, high[crossing] + 1, -1)
    touched = np.cumsum(touched)[:n]
    counts = np.bincount(low[~crossing], minlength=n).astype(np.float64)
    a, b, low, high = starts[crossing], ends[crossing], low[crossing], high[crossing]
    if rule == "start":
        np.add.at(counts, low, 1)
        return counts, touched
    parts = high - low + 1
    token = np.repeat(np.arange(len(low)), parts)
    within = np.arange(len(token)) - np.repeat(np.cumsum(parts) - parts, parts)
    section = low[token] + within
    shared = np.minimum(b[token], borders[section + 1]) - np.maximum(a[token], borders[section])
    if rule == "split":
        np.add.at(counts, section, shared / (b - a)[token])
    else:
        order = np.lexsort((section, -shared, token))
        best = order[np.concatenate([[0], np.cumsum(parts)[:-1]])] if len(parts) else order
        np.add.at(counts, section[best], 1)
    return counts, touched


def section_token_counts(
    docs: DataFrame,
    path: str,
    rule: str = "most",
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per section (line) of each document: its id, ``section`` (from 0),
    ``start`` and ``end`` (characters, end exclusive), ``n_tokens`` (a double, whole
    but for ``split``) and ``n_crossing`` (tokens that also touch another section).
    Over a document ``n_tokens`` sums to the tokens of its whole text.

    Null and empty texts have one section from 0 to 0 without tokens. Every row is a
    document of its own, also with a repeated or null id. Long texts are encoded whole,
    also long white space and words of any length. Only the two named columns
    are read, so clashing names of others do no harm. ``path`` is a rank file, read by
    the driver and sent to all executors."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    given = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches):
        ranks = shared.value
        coder = TextEncoder(ranks)
        size_of = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            size_of[rank] = len(token)
        for batch in batches:
            for part in pieces(batch, "text"):
                flat, edges = flat_bytes(part.column("text"))
                columns = [[], [], [], [], []]
                for i, text in enumerate(part.column("text").to_pylist()):
                    data = flat[edges[i] : edges[i + 1]]
                    ids = np.array(coder.ids(text), np.int64)
                    borders = line_borders(data) if len(data) else np.zeros(2, np.int64)
                    starts, ends = token_spans(size_of[ids], data)
                    counts, touched = allocate(starts, ends, borders, rule)
                    n = len(counts)
                    for column, values in zip(
                        columns,
                        (np.full(n, i), np.arange(n), borders[:-1], borders[1:], counts),
                    ):
                        column.append(values)
                    columns[4][-1] = np.stack([counts, touched])
                row = pa.array(np.concatenate(columns[0]))
                both = np.concatenate(columns[4], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(row),
                        *(pa.array(np.concatenate(c).astype(np.int64)) for c in columns[1:4]),
                        pa.array(both[0]),
                        pa.array(both[1].astype(np.int64)),
                    ],
                    names=["id", "section", "start", "end", "n_tokens", "n_crossing"],
                )

    schema = T.StructType([given.schema["id"]])
    for name in ("section", "start", "end"):
        schema = schema.add(name, "long")
    schema = schema.add("n_tokens", "double").add("n_crossing", "long")
    return given.mapInArrow(run, schema).withColumnRenamed("id", id_column)
