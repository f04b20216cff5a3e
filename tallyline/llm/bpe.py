"""Byte-pair encoding with word ends, and decoding, for whole texts.

Reads a vocabulary file of the ``tokenizers`` library (byte-level BPE, a suffix at
word ends, a pattern that splits words) and gives its ids and its decoded text.
Merging works on many words at once: their symbols lie in one flat array; in each
round every word's lowest-ranked pair is found by binary search over the sorted
pair keys and merged at all its places in the word. Words already met are looked
up by a 64-bit hash; a very long word is merged with a heap, whose time does not grow with the
square of its length.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.llm.arrow_text import GOLDEN, mix, pieces

LONG_WORD = 256  # symbols above which a word is merged by itself
CACHE_SYMBOLS = 4_000_000  # symbols of known words that a worker keeps
_NONE = np.iinfo(np.int64).max

TABLE = 1 << 19  # places for known words
_WHITE, _LETTER, _NUMBER, _OTHER, _SPECIAL = range(5)

# Fixed values of the vocabulary format: white space, and the short forms that are
# words of their own behind an apostrophe.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029)
WHITE += (0x202F, 0x205F, 0x3000)
SHORT_FORMS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else
    one of those from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


class Vocabulary:
    """What encoding needs from a vocabulary file, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {**{i: t for t, i in ids.items()}, **{i: t for t, i in self.special.items()}}
        self.size = max(names) + 1
        letters = byte_characters()
        self.inner = np.array([ids[c] for c in letters], np.int64)
        self.last = np.array([ids[c + end] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made[order]
        self.classes = character_classes()
        # Decoding joins the names of the tokens with blanks.
        shown = [(names.get(i, "") + " ").encode() for i in range(self.size)]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_end = np.cumsum([len(s) for s in shown])
        self.shown_size = np.diff(self.shown_end, prepend=0)

    def ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair, found among the sorted keys."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], _NONE), self.made[at]

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The first symbols of all words, and the number of symbols of each."""
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.array([len(w) for w in words], np.int64)
        symbols = self.inner[data]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[data[ends]]
        return symbols, sizes

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all (non-empty) words, flat, and how many each has."""
        short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
        done_ids, done_words = [], []
        if short:
            symbol, sizes = self.symbols([words[i] for i in short])
            word = np.repeat(np.array(short, np.int64), sizes)
            while len(symbol):
                first = np.ones(len(word), bool)
                first[1:] = word[1:] != word[:-1]
                rank, made = np.full(len(symbol), _NONE), symbol.copy()
                rank[:-1], made[:-1] = self.ranked(symbol[:-1], symbol[1:])
                rank[:-1][first[1:]] = _NONE
                starts = np.flatnonzero(first)
                best = np.minimum.reduceat(rank, starts)
                best = np.repeat(best, np.diff(starts, append=len(symbol)))
                over = best == _NONE
                done_ids.append(symbol[over])
                done_words.append(word[over])
                pick = (rank == best) & ~over
                # Of overlapping places (a run of one symbol) every second is merged.
                at = np.flatnonzero(pick)
                new_run = np.ones(len(at), bool)
                new_run[1:] = at[1:] != at[:-1] + 1
                run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run_start) % 2 == 0]
                symbol[at] = made[at]
                keep = ~over
                keep[at + 1] = False
                symbol, word = symbol[keep], word[keep]
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                found = self._merge_long(w)
                done_ids.append(found)
                done_words.append(np.full(len(found), i))
        word = np.concatenate(done_words) if done_words else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        ids = np.concatenate(done_ids)[order] if done_ids else np.zeros(0, np.int64)
        return ids, np.bincount(word, minlength=len(words))

    def _merge_long(self, word: bytes) -> np.ndarray:
        symbol, _ = self.symbols([word])
        rank, made = self.ranked(symbol[:-1], symbol[1:])
        heap = [
            (r, i, a, b, m)
            for i, (r, a, b, m) in enumerate(
                zip(rank.tolist(), symbol[:-1].tolist(), symbol[1:].tolist(), made.tolist())
            )
            if r != _NONE
        ]
        heapq.heapify(heap)
        symbol = symbol.tolist()
        after = list(range(1, len(symbol) + 1))
        before = list(range(-1, len(symbol) - 1))
        table = self._table()

        def offer(i: int, j: int) -> None:
            if hit := table.get(symbol[i] * self.size + symbol[j]):
                heapq.heappush(heap, (hit[0], i, symbol[i], symbol[j], hit[1]))

        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j >= len(symbol) or symbol[j] != b:
                continue
            symbol[i], symbol[j] = new, -1
            after[i] = after[j]
            if after[i] < len(symbol):
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return np.array([s for s in symbol if s >= 0], np.int64)

    def _table(self) -> dict[int, tuple[int, int]]:
        if not hasattr(self, "_by_key"):
            rows = zip(self.ranks.tolist(), self.made.tolist())
            self._by_key = dict(zip(self.keys.tolist(), rows))
        return self._by_key

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The names of the ids in UTF-8, joined with blanks."""
        sizes = self.shown_size[ids]
        total = int(sizes.sum())
        shift = self.shown_end[ids] - np.cumsum(sizes)
        return self.shown[np.arange(total) + np.repeat(shift, sizes)].tobytes()[:-1]


def character_classes() -> np.ndarray:
    """Class of every character: white space, letter, number or other; and one
    for the marks that stand for special tokens, whose codes come after all
    characters."""
    table = np.full(0x110000 + 256, _OTHER, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind in "LN":
            table[code] = _LETTER if kind == "L" else _NUMBER
    table[list(WHITE)] = _WHITE
    table[0x110000:] = _SPECIAL
    return table


class Encoder:
    """Encodes texts, keeping the ids of words it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        marks = "|".join(re.escape(t) for t in vocabulary.special)
        self.special = re.compile(f"({marks})") if marks else None
        self.special_ids = np.array(list(vocabulary.special.values()), np.int64)
        self.names = {t: i for i, t in enumerate(vocabulary.special)}
        self.random = mix(np.arange(1, 1 + len(vocabulary.classes), dtype=np.uint64) * GOLDEN)
        self.powers = self.inverse = np.ones(1, np.uint64)
        self.forget()

    def forget(self) -> None:
        """Ids of known words, flat, where each word has a slot; a table by hash,
        in which a later word takes the place of an earlier one."""
        self.ids, self.starts, self.sizes = (np.zeros(0, np.int64) for _ in range(3))
        self.table_hash = np.zeros(TABLE, np.uint64)
        self.table_slot = np.full(TABLE, -1)

    def _codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Characters of all normalised texts, flat, and how many each has."""
        parts, sizes = [], []
        for text in texts:
            size = 0
            found = [text or ""]
            if text and self.special and "<" in text:
                found = self.special.split(text)
            for i, part in enumerate(found):
                if i % 2:
                    parts.append(0x110000 + self.names[part])
                    size += 1
                    continue
                # Lower case by character: a sigma at a word's end is no exception.
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                part = part.lower()
                parts.append(part)
                size += len(part)
            sizes.append(size)
        arrays, run = [], []
        for part in [*parts, 0]:
            if isinstance(part, str):
                run.append(part)
            else:
                arrays.append(np.frombuffer("".join(run).encode("utf-32-le"), np.uint32))
                arrays.append(np.array([part], np.uint32))
                run = []
        return np.concatenate(arrays)[:-1], np.array(sizes, np.int64)

    def _words(self, codes: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words start and end: runs of letters, single numbers, runs of
        other characters, and the short forms behind an apostrophe."""
        n = len(codes)
        kind = self.vocabulary.classes[codes]
        fresh = np.ones(n + 1, bool)
        fresh[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER) | (kind[1:] == _SPECIAL)
        fresh[borders] = True
        mark = np.flatnonzero((codes == ord("'")) & fresh[:n])
        mark = mark[(mark + 1 < n)]
        mark = mark[fresh[mark + 1] & (kind[mark + 1] == _LETTER)]
        ends = np.append(borders, n)
        end = ends[np.searchsorted(ends, mark, "right")]  # of the text
        for short in SHORT_FORMS:
            at = mark[mark + len(short) < end]
            for j, c in enumerate(short, 1):
                at = at[codes[at + j] == ord(c)]
            fresh[at + 1] = False
            fresh[at + 1 + len(short)] = True
        starts = np.flatnonzero(fresh[:n])
        stops = np.append(starts[1:], n)
        real = kind[starts] != _WHITE
        return starts[real], stops[real]

    def _hashes(self, codes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        n = len(codes)
        if len(self.powers) <= n:
            size, base = 1 << (n + 1).bit_length(), 0x5851F42D4C957F2D
            for name, step in (("powers", base), ("inverse", pow(base, -1, 1 << 64))):
                steps = np.full(size, step, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.random[codes] * self.powers[:n], out=sums[1:])
        spans = (sums[stops] - sums[starts]) * self.inverse[starts]
        return mix(spans + (stops - starts).astype(np.uint64) * GOLDEN)

    def _learn(self, codes, starts, stops, hashes) -> np.ndarray:
        """Merge words that are not known, and give their slots."""
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = list(zip(starts[first].tolist(), stops[first].tolist()))
        special = codes[starts[first]] >= 0x110000
        words = [
            b"" if s else codes[a:b].tobytes().decode("utf-32-le").encode()
            for s, (a, b) in zip(special.tolist(), at)
        ]
        ids, sizes = self.vocabulary.merge([w or b" " for w in words])
        ends = np.cumsum(sizes)
        ids[ends[special] - 1] = self.special_ids[codes[starts[first[special]]] - 0x110000]
        slots = len(self.sizes) + np.arange(len(first))
        self.starts = np.concatenate([self.starts, len(self.ids) + ends - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, ids])
        place = hashes[first] % np.uint64(TABLE)
        self.table_hash[place], self.table_slot[place] = hashes[first], slots
        return slots[which]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and how many each has; null counts as empty."""
        if len(self.ids) > CACHE_SYMBOLS:
            self.forget()
        codes, lengths = self._codes(texts)
        borders = np.cumsum(lengths) - lengths
        starts, stops = self._words(codes, borders)
        hashes = self._hashes(codes, starts, stops)
        place = hashes % np.uint64(TABLE)
        slots = np.where(self.table_hash[place] == hashes, self.table_slot[place], -1)
        new = np.flatnonzero(slots < 0)
        if len(new):
            slots[new] = self._learn(codes, starts[new], stops[new], hashes[new])
        sizes = self.sizes[slots]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        shift = self.starts[slots] - ends[:-1]
        flat = self.ids[np.arange(ends[-1]) + np.repeat(shift, sizes)]
        counts = np.diff(np.append(np.searchsorted(starts, borders), len(starts)))
        ends = ends[np.cumsum(np.append(0, counts))]
        return flat, np.diff(ends)


def encode(
    docs: DataFrame,
    path: str,
    text_column: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """The ``keep`` columns of each row, and ``ids`` (int array), ``n_tokens``,
    ``ids_sha256`` (of the ids as little-endian 32-bit numbers) and
    ``decoded_sha256`` (of the text decoded from the ids).

    Null and empty texts, and texts of white space, have no ids. Every row is
    encoded by itself, also with a repeated or null id; columns not named are not
    read. The vocabulary (a file of bounded size) is read by the driver and sent
    to all executors."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    names = [f"_keep{i}" for i in range(len(keep))]

    def run(batches):
        encoder = Encoder(shared.value)
        vocabulary = encoder.vocabulary
        for batch in batches:
            for part in pieces(batch, "_text"):
                flat, counts = encoder.encode(part.column("_text").to_pylist())
                ends = np.cumsum(counts)
                bounds = list(zip((ends - counts).tolist(), ends.tolist()))
                packed = flat.astype("<u4")
                hashes = [hashlib.sha256(packed[a:b]).hexdigest() for a, b in bounds]
                shown = [
                    hashlib.sha256(vocabulary.decode_bytes(flat[a:b])).hexdigest()
                    for a, b in bounds
                ]
                borders = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(n) for n in names),
                        pa.ListArray.from_arrays(borders, pa.array(flat.astype(np.int32))),
                        pa.array(counts, pa.int64()),
                        pa.array(hashes, pa.string()),
                        pa.array(shown, pa.string()),
                    ],
                    names=[*names, "ids", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    given = docs.select(
        *(F.col(k).alias(n) for k, n in zip(keep, names)), F.col(text_column).alias("_text")
    )
    schema = T.StructType(
        [given.schema[n] for n in names]
        + [
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )
    encoded = given.mapInArrow(run, schema)
    return encoded.withColumnsRenamed(dict(zip(names, keep)))


def decode(rows: DataFrame, path: str, ids_column: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the text that their ids stand for, special tokens included.
    Null and empty ids give an empty text; a column of the name ``into`` is
    replaced."""
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary(path))

    @F.pandas_udf("string")
    def shown(column: pd.Series) -> pd.Series:
        table = shared.value
        return column.map(
            lambda ids: table.decode_bytes(np.asarray(ids, np.int64)).decode()
            if ids is not None and len(ids)
            else ""
        )

    return rows.withColumn(into, shown(F.col(ids_column)))
