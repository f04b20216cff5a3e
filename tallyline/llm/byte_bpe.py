"""Byte-level BPE by a global shuffle of distinct words.

A text is split into pre-tokens ("words") by a fixed pattern; a word's ids depend on
its bytes alone. Words are taken out of the texts with their positions, each distinct
word is encoded once, and its ids are joined back to all places where it stands.

The join back comes in two parts, as for any skewed key:

* Frequent words, up to ``FREQUENT`` of at most ``WORD_BYTES`` bytes, are encoded as a
  table of bounded size that goes to all tasks. They make up nearly all places.
* All other words go through the shuffle: each place is a row of its own (word, text,
  position), dealt out and sorted by word, so equal words stand together and are
  encoded once; their ids go back to the texts by a second shuffle. As every frequent
  word is in the table, no word is a hot key.

A text's frequent words travel as one compressed row of numbers with gaps, not as a row
per word. There the ids of the other words are filled in by position, and the whole is
checked: a gap without ids is an error, never a shorter text.

Decoding joins ids with the table of the tokens' bytes, which has a fixed size.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.llm.arrow_text import pieces
from tallyline.llm.graph import stored

FREQUENT = 1 << 19  # words sent to all tasks
WORD_BYTES = 48  # longest of them
COUNTED = 1 << 19  # distinct words that a task counts before it hands them on
ROWS_OUT = 1 << 14  # rows of an Arrow batch of words

_WHOLE = r"(?s:.+)"  # a pattern by which the library takes a word as it is


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ids; a file of fixed size."""
    with open(path, "rb") as file:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, file)}


def word_encoder(ranks: dict[bytes, int]):
    """Ids of one word: the merges of the lowest rank first."""
    coder = tiktoken.Encoding("words", pat_str=_WHOLE, mergeable_ranks=ranks, special_tokens={})
    return coder.encode_ordinary


LATIN = 0x250  # code points below are the Latin letters and what stands among them
_ESCAPE = re.compile(r"\\(p\{\w+\}|.)")


def _latin_class(escape: str) -> str:
    """The code points below ``LATIN`` of a class, as the full pattern knows them."""
    member = regex.compile(escape).fullmatch
    ranges = []
    for point in range(LATIN):
        if member(chr(point)):
            if ranges and ranges[-1][1] == point - 1:
                ranges[-1][1] = point
            else:
                ranges.append([point, point])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges)


def latin_pattern(pattern: str) -> re.Pattern | None:
    """The same pattern for texts of Latin letters, with its classes written out, which
    the standard library matches in less than half the time. None if the pattern has
    escapes other than classes by property and white space."""
    made, inside, at = [], False, 0
    while at < len(pattern):
        escape = _ESCAPE.match(pattern, at)
        if escape is None:
            inside = (inside or pattern[at] == "[") and pattern[at] != "]"
            made.append(pattern[at])
            at += 1
            continue
        at, name = escape.end(), escape.group()
        if name == r"\S" and not inside:
            made.append(f"[^{_latin_class(chr(92) + 's')}]")
        elif name == r"\s" or name.startswith(r"\p{"):
            ranges = _latin_class(name)
            made.append(ranges if inside else f"[{ranges}]")
        else:
            return None
    return re.compile("".join(made))


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Pre-tokens of a text, in order."""
    whole, latin = regex.compile(pattern).findall, latin_pattern(pattern)
    if latin is None:
        return whole
    other = re.compile(f"[^\x00-{chr(LATIN - 1)}]").search
    few = latin.findall
    return lambda text: few(text) if other(text) is None else whole(text)


def _texts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return pieces(batch, "_text")


# Which words are frequent -------------------------------------------------------


def word_counts(texts: DataFrame, pattern: str) -> DataFrame:
    """``word`` and ``n``, for the choice of the frequent words alone. A task hands on
    the words that it has seen twice; one seen once in every task is never a hot key."""

    def run(batches):
        split = splitter(pattern)
        seen = Counter()

        def rows():
            found = [(w, n) for w, n in seen.items() if n > 1 and len(w.encode()) <= WORD_BYTES]
            seen.clear()
            for at in range(0, len(found), ROWS_OUT):
                words, counts = zip(*found[at : at + ROWS_OUT])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "n"]
                )

        for batch in batches:
            for part in _texts(batch):
                for text in part.column("_text").to_pylist():
                    if text:
                        seen.update(split(text))
                if len(seen) > COUNTED:
                    yield from rows()
        yield from rows()

    found = texts.select("_text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(texts: DataFrame, pattern: str, ranks, most: int) -> list[tuple[str, bytes]]:
    """At most ``most`` words with their ids (little-endian 32 bits), the more frequent
    ones first. The least count that is taken comes from a table of counts by size
    class and by count, not from a sort of all words."""
    counts = stored(word_counts(texts, pattern), "words")
    sizes = counts.groupBy(F.least("n", F.lit(1 << 20)).alias("n")).agg(
        F.count(F.lit(1)).alias("words")
    )
    taken, least = 0, None
    # At most 2^20 rows of two numbers, whatever the size of the corpus.
    for row in sizes.orderBy(F.desc("n")).toLocalIterator():
        taken += row["words"]
        if taken > most:
            break
        least = row["n"]
    if least is None:
        return []
    shared = texts.sparkSession.sparkContext.broadcast(ranks)

    def encode(batches):
        ids = word_encoder(shared.value)
        for batch in batches:
            coded = [np.array(ids(w), "<u4").tobytes() for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("n"), pa.array(coded, pa.binary())],
                ["word", "n", "ids"],
            )

    chosen = counts.filter(F.col("n") >= least)
    chosen = chosen.mapInArrow(encode, "word string, n long, ids binary").toArrow()
    chosen = chosen.sort_by([("n", "descending"), ("word", "ascending")])
    return list(zip(chosen.column("word").to_pylist(), chosen.column("ids").to_pylist()))


# Texts as numbers of words ----------------------------------------------------------


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^24, the bytes of equal weight side by side, compressed."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T
    return zlib.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(3, -1).astype(np.int64)
    return planes[0] | planes[1] << 8 | planes[2] << 16


def text_key(text: str) -> bytes:
    """Stands for a text in the shuffles; equal texts may share one."""
    return hashlib.md5(text.encode()).digest()[:12]


def rare_places(texts: DataFrame, pattern: str, numbers) -> DataFrame:
    """``word``, ``key`` of the text and ``pos``, for the words that have no number."""

    def run(batches):
        split, known = splitter(pattern), numbers.value
        for batch in batches:
            for part in _texts(batch):
                words, keys, places = [], [], []
                for text in part.column("_text").to_pylist():
                    if not text:
                        continue
                    found = split(text)
                    rare = [i for i, w in enumerate(found) if w not in known]
                    if rare:
                        words += [found[i] for i in rare]
                        keys += [text_key(text)] * len(rare)
                        places += rare
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(words, pa.string()),
                        pa.array(keys, pa.binary()),
                        pa.array(places, pa.int32()),
                    ],
                    ["word", "key", "pos"],
                )

    return texts.select("_text").mapInArrow(run, "word string, key binary, pos int")


def encoded_once(places: DataFrame, ranks) -> DataFrame:
    """``key``, ``pos`` and ``ids`` for every place; equal words of all texts meet in one
    run of one task and are encoded once."""

    def run(batches):
        ids = word_encoder(ranks.value)
        last, coded = None, b""
        for batch in batches:
            out = []
            for word in batch.column("word").to_pylist():
                if word != last:
                    last, coded = word, np.array(ids(word), "<u4").tobytes()
                out.append(coded)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("pos"), pa.array(out, pa.binary())],
                ["key", "pos", "ids"],
            )

    dealt = places.repartition("word").sortWithinPartitions("word")
    return dealt.mapInArrow(run, "key binary, pos int, ids binary")


def numbered_texts(given: DataFrame, names: list[str], pattern: str, numbers) -> DataFrame:
    """Kept columns, ``key`` and ``stream``: the number of each word from 1, 0 for a gap.
    A text without gaps needs no ids from elsewhere; its key is its place, so that many
    copies of one text do not meet in one task."""

    def run(batches):
        from pyspark import TaskContext

        split, known = splitter(pattern), numbers.value
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in _texts(batch):
                keys, streams = [], []
                for text in part.column("_text").to_pylist():
                    row += 1
                    found = [known.get(w, 0) for w in split(text)] if text else []
                    stream = np.array(found, np.int64)
                    whole = len(stream) == 0 or stream.min() > 0
                    place = hashlib.md5(b"%d:%d" % (task, row)).digest()[:11]
                    keys.append(place if whole else text_key(text))
                    streams.append(packed(stream))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(n) for n in names),
                        pa.array(keys, pa.binary()),
                        pa.array(streams, pa.binary()),
                    ],
                    names=[*names, "key", "stream"],
                )

    schema = T.StructType([given.schema[n] for n in names])
    return given.mapInArrow(run, schema.add("key", "binary").add("stream", "binary"))


class WordTable:
    """Ids of numbered words, flat; number 0 is a gap."""

    def __init__(self, coded: list[bytes]):
        sizes = np.array([len(c) // 4 for c in coded], np.int64)
        # One id more, so that there is something to take for a gap.
        self.ids = np.frombuffer(b"".join(coded) + bytes(4), "<u4").astype(np.int64)
        self.sizes = np.concatenate([[0], sizes])
        self.starts = np.concatenate([[0], np.cumsum(sizes) - sizes])

    def ids_of(self, stream: np.ndarray, fills: list[dict] | None) -> np.ndarray:
        sizes, starts = self.sizes[stream], self.starts[stream]
        gaps = np.flatnonzero(stream == 0)
        if len(gaps):
            # Copies of a text bring the same fills; of each position one counts.
            known = {f["pos"]: f["ids"] for f in fills or ()}
            lists = [np.frombuffer(known[pos], "<u4") for pos in gaps.tolist()]
            sizes[gaps] = [len(x) for x in lists]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(starts - (ends - sizes), sizes)
        found = self.ids.take(at, mode="clip")
        if len(gaps):
            found[np.repeat(stream == 0, sizes)] = np.concatenate(lists)
        return found


class TokenBytes:
    """Bytes of each token, flat."""

    def __init__(self, ranks: dict[bytes, int]):
        parts = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            parts[rank] = token
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.shown = [str(i) for i in range(len(parts))]

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return self.data[at].tobytes()


OUTPUTS = ("ids", "n_tokens", "ids_sha256", "decoded_sha256")


def encode(
    docs: DataFrame,
    path: str,
    pattern: str,
    text_column: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    outputs: tuple[str, ...] = OUTPUTS,
    frequent: int = FREQUENT,
) -> DataFrame:
    """The ``keep`` columns of each row and those of ``outputs``: ``ids`` (int array),
    ``n_tokens``, ``ids_sha256`` (of the decimal ids with a blank between) and
    ``decoded_sha256`` (of the bytes decoded from the ids).

    ``path`` is a rank file, read by the driver and sent to all executors; ``pattern``
    splits texts. Null and empty texts have no ids. Every row is encoded, also with a
    repeated or null id; columns not named are not read, so clashing names do no harm; an
    empty table stays one. A long text is one row, a long word one word: either is
    whole in one task's memory, at some times its size. ``frequent`` bounds the words
    sent to all, and changes no result. ``docs`` is read three times."""
    spark = docs.sparkSession
    ranks = read_ranks(path)
    names = [f"_keep{i}" for i in range(len(keep))]
    given = docs.select(
        *(F.col(k).alias(n) for k, n in zip(keep, names)), F.col(text_column).alias("_text")
    )
    texts = given.select("_text")
    words = frequent_words(texts, pattern, ranks, frequent)
    send = spark.sparkContext.broadcast
    numbers = send({word: i + 1 for i, (word, _) in enumerate(words)})
    coded, shared = send([ids for _, ids in words]), send(ranks)

    fills = encoded_once(rare_places(texts, pattern, numbers), shared)
    fills = fills.groupBy("key").agg(F.collect_list(F.struct("pos", "ids")).alias("fills"))
    streams = numbered_texts(given, names, pattern, numbers)

    def run(batches):
        table, tokens = WordTable(coded.value), TokenBytes(shared.value)
        for batch in batches:
            columns = {name: [] for name in OUTPUTS}
            filled = batch.column("fills")
            for row, data in enumerate(batch.column("stream").to_pylist()):
                ids = table.ids_of(unpacked(data), filled[row].as_py())
                columns["n_tokens"].append(len(ids))
                if "ids" in outputs:
                    columns["ids"].append(ids.astype(np.int32))
                if "ids_sha256" in outputs:
                    shown = " ".join([tokens.shown[i] for i in ids.tolist()])
                    columns["ids_sha256"].append(hashlib.sha256(shown.encode()).hexdigest())
                if "decoded_sha256" in outputs:
                    plain = tokens.decode(ids)
                    columns["decoded_sha256"].append(hashlib.sha256(plain).hexdigest())
            made = [pa.array(columns[name], kinds[name]) for name in outputs]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), *made], names=[*names, *outputs]
            )

    kinds = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}
    kinds |= dict.fromkeys(("ids_sha256", "decoded_sha256"), pa.string())
    types = {"ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType()}
    schema = T.StructType([given.schema[n] for n in names])
    for name in outputs:
        schema = schema.add(name, types.get(name, T.StringType()))
    joined = streams.join(fills, "key", "left").select(*names, "stream", "fills")
    return joined.mapInArrow(run, schema).withColumnsRenamed(dict(zip(names, keep)))


def decode(rows: DataFrame, path: str, ids_column: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the bytes that their ids stand for, joined from the table of tokens.
    Null and empty ids give no bytes; a column of the name ``into`` is replaced. Bytes
    need not be a whole text, as ids may be cut anywhere."""
    shared = rows.sparkSession.sparkContext.broadcast(read_ranks(path))

    @F.pandas_udf("binary")
    def plain(column):
        tokens = TokenBytes(shared.value)
        return column.map(
            lambda ids: tokens.decode(np.asarray(ids, np.int64)) if ids is not None else b""
        )

    return rows.withColumn(into, plain(F.col(ids_column)))
