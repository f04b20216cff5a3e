"""Passages that documents share, found as runs of whole sentences or of words.

Runs of three kinds are hashed over their words, so case A-Z and white space do not
matter, and joined over all documents: of every sentence the fewest sentences from it
on, two at least, that have ``min_words`` words together; every sentence of ``min_words``
words by itself; and ``min_words`` words from places that the words themselves decide
(the least hash of two words in each window of ``WINDOW`` places) and from where a long
sentence starts. Of each run that occurs more than once the first place stays (the
document with the least id, and there the first word); words covered by any other
place are removed.

A sentence ends at a line's end or after a word that ends in ``.``, ``!`` or
``?``. A repeated passage of ``min_words + WINDOW - 1`` words (and so one of twice
``min_words``) is found wherever it stands, even if its ends run into other sentences
or it has none; all of it is removed but fewer than ``WINDOW`` words at each end. Whole
sentences in it that have a run of their own are removed whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.llm.arrow_text import GOLDEN, SPACES, Words, mix, pieces

LONGEST = 30  # a longer sentence has a run of words from its start
MIN_SENTENCES = 2
WINDOW = 16  # places of which one starts a run of words; at most min_words
_STEP = 0x2545F4914F6CDD1D


class Sentences:
    """The sentences of some texts, and the runs (first word, number of words)."""

    def __init__(self, texts: pa.Array, min_words: int):
        words = Words(texts, SPACES)
        n, self.texts = len(words.start), len(words.count)
        data = words.data
        lines = np.zeros(len(data) + 1, np.int32)
        np.cumsum(data == ord("\n"), out=lines[1:])
        begins = np.ones(n, bool)
        if n:
            begins[1:] = np.isin(data[words.end[:-1] - 1], np.frombuffer(b".!?", np.uint8))
            begins[1:] |= lines[words.start[1:]] > lines[words.end[:-1]]
            begins[words.first[:-1][words.count > 0]] = True
        self.word = np.flatnonzero(begins)  # the first word of each sentence
        self.sentence = np.cumsum(begins) - 1  # of each word
        self.text, self.first, self.count = words.text, words.first, words.count
        # A word reaches up to the next one; the first takes what stands before.
        self.byte = words.start
        self.data, self.borders = data, words.borders
        starts, stops = self._places(words, max(min_words, 1))
        self.run, self.length = starts, stops - starts
        self.hash = [self._run_hashes(words.hash, salt) for salt in (11, 29)]

    def _places(self, words: Words, min_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Where runs start and stop."""
        n, total = len(words.start), len(self.word)
        if not n:
            return np.zeros((2, 0), np.int64)
        before = np.append(self.word, n)  # words before each sentence
        of_text = self.text[self.word]
        last = np.searchsorted(of_text, of_text, "right")  # the sentence after the text's last
        stop = np.searchsorted(before, self.word + min_words, "left")
        stop = np.maximum(stop, np.arange(total) + MIN_SENTENCES)
        good = stop <= last
        size = np.diff(before)
        alone = size >= min_words
        # Places decided by two words; none reaches over the end of its text.
        two = mix(words.hash ^ mix(np.append(words.hash[1:], GOLDEN)))
        two[words.first[1:][words.count > 0] - 1] = np.iinfo(np.uint64).max
        window = min(WINDOW, min_words)
        chosen = np.zeros(0, np.int64)
        if n >= window:
            least = np.lib.stride_tricks.sliding_window_view(two, window).argmin(axis=1)
            inside = self.text[: n - window + 1] == self.text[window - 1 :]
            chosen = (np.arange(len(least)) + least)[inside]
        chosen = np.union1d(chosen, self.word[size > LONGEST])
        chosen = chosen[chosen + min_words <= self.first[1:][self.text[chosen]]]
        starts = np.concatenate([self.word[good], self.word[alone], chosen])
        stops = np.concatenate([before[stop[good]], before[1:][alone], chosen + min_words])
        order = np.lexsort((stops, starts))
        starts, stops = starts[order], stops[order]
        new = np.ones(len(starts), bool)
        new[1:] = (np.diff(starts) > 0) | (np.diff(stops) > 0)
        return starts[new], stops[new]

    def _run_hashes(self, own: np.ndarray, salt: int) -> np.ndarray:
        steps = np.full(len(own) + 1, _STEP, np.uint64)
        steps[0] = 1
        powers = np.cumprod(steps)
        steps[1:] = pow(_STEP, -1, 1 << 64)
        inverse = np.cumprod(steps)
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(mix(own + np.uint64(salt)) * powers[:-1], out=sums[1:])
        spans = (sums[self.run + self.length] - sums[self.run]) * inverse[self.run]
        return mix(spans + self.length.astype(np.uint64) * GOLDEN)

    def repeated_inside(self) -> np.ndarray:
        """Which runs stood in the same text before."""
        text = self.text[self.run]
        order = np.lexsort((self.run, self.hash[1], self.hash[0], text))
        again = np.zeros(len(order), bool)
        if len(order):
            a, b = order[1:], order[:-1]
            same = (text[a] == text[b]) & (self.hash[0][a] == self.hash[0][b])
            again[a] = same & (self.hash[1][a] == self.hash[1][b])
        return again


def _runs(batches, min_words: int):
    for batch in batches:
        for part in pieces(batch, "text"):
            found = Sentences(part.column("text"), min_words)
            once = np.flatnonzero(~found.repeated_inside())
            text = found.text[found.run[once]]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id").take(pa.array(text)),
                    part.column("key").take(pa.array(text)),
                    pa.array((found.run[once] - found.first[text]).astype(np.int32)),
                    pa.array(found.length[once].astype(np.int32)),
                    pa.array(found.hash[0][once].view(np.int64)),
                    pa.array((found.hash[1][once] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                ],
                names=["id", "key", "at", "length", "hash", "more"],
            )


def _cover(marks: np.ndarray, at: np.ndarray, length: np.ndarray) -> None:
    np.add.at(marks, at, 1)
    np.add.at(marks, at + length, -1)


def _cleaned(batches, min_words: int):
    for batch in batches:
        for part in pieces(batch, "text"):
            found = Sentences(part.column("text"), min_words)
            marks = np.zeros(len(found.text) + 1, np.int64)
            again = found.repeated_inside()
            _cover(marks, found.run[again], found.length[again])
            spans = part.column("spans")
            sizes = np.nan_to_num(spans.value_lengths().to_numpy(zero_copy_only=False)).astype(int)
            flat = spans.flatten()
            if len(flat):
                base = np.repeat(found.first[:-1], sizes)
                at = flat.field("at").to_numpy() + base
                _cover(marks, at, flat.field("length").to_numpy())
            gone = np.cumsum(marks[:-1]) > 0
            of_text = found.text[found.word]
            sentences = np.bincount(of_text, minlength=found.texts)
            lost = np.unique(found.sentence[gone])
            removed = np.bincount(of_text[lost], minlength=found.texts)
            # Keep bytes by word.
            keep = np.zeros(len(found.data) + 1, np.int32)
            start = found.byte.copy()
            heads = found.first[:-1][found.count > 0]
            start[heads] = found.borders[:-1][found.count > 0]
            change = np.diff(gone.astype(np.int32), prepend=0)
            change[heads] = gone[heads]
            np.add.at(keep, start, change)
            ends = found.borders[1:][found.count > 0]
            tails = found.first[1:][found.count > 0] - 1
            np.add.at(keep, ends, -gone[tails].astype(np.int32))
            kept = np.cumsum(keep[:-1]) == 0
            sums = np.concatenate([[0], np.cumsum(kept)])[found.borders].astype(np.int32)
            given = part.column("text")
            texts = pa.StringArray.from_buffers(
                part.num_rows,
                pa.py_buffer(sums.tobytes()),
                pa.py_buffer(found.data[kept].tobytes()),
                given.is_valid().buffers()[1] if given.null_count else None,
            )
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    pa.array(sentences, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(removed > 0),
                    texts,
                ],
                names=["id", "n_sentences", "n_removed", "repeated", "text"],
            )


def without_repeats(
    docs: DataFrame, min_words: int = 25, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_sentences``, ``n_removed`` (sentences
    that lost words), ``repeated`` (something was removed) and the text without it.

    Null texts stay null, empty texts empty, both without sentences. Texts of fewer
    than ``min_words`` words are left alone, also if they are
    equal. Rows with one id count as one document: what they share with each other
    stays. Rows with a null id come after all others and do not repeat each other.
    Only the two named columns are read, so clashing names of others do no harm."""
    text = F.col(text_column)
    given = docs.select(
        F.col(id_column).alias("id"), F.xxhash64(text).alias("key"), text.alias("text")
    )
    kind = given.schema["id"].dataType
    runs = given.mapInArrow(
        lambda batches: _runs(batches, min_words),
        T.StructType([T.StructField("id", kind)]).add("key", "long").add("at", "integer")
        .add("length", "integer").add("hash", "long").add("more", "integer"),
    )
    first = runs.groupBy("hash", "more").agg(
        F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")
    )
    first = first.filter((F.col("n") > 1) & F.col("first_id").isNotNull())
    later = F.coalesce(F.col("id") != F.col("first_id"), F.lit(True))
    spans = (
        runs.join(first.select("hash", "more", "first_id"), ["hash", "more"])
        .filter(later)
        .groupBy(F.col("id").alias("of"), F.col("key").alias("of_key"))
        .agg(F.collect_set(F.struct("at", "length")).alias("spans"))
    )
    same = F.col("id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key"))
    joined = given.join(spans, same, "left").select("id", "text", "spans")
    cleaned = joined.mapInArrow(
        lambda batches: _cleaned(batches, min_words),
        T.StructType([T.StructField("id", kind)]).add("n_sentences", "long")
        .add("n_removed", "long").add("repeated", "boolean").add("text", "string"),
    )
    return cleaned.withColumnRenamed("id", id_column)
