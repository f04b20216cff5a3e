"""Toxicity by two interpolated Kneser-Ney word-pair models, one per class.

Training counts the word pairs of toxic and of ordinary labelled documents, every
place of all of them, one row per different pair (its words known by 64-bit hashes) in
a Spark table that grows with the corpus. From it come, for each class, how often a
word is a context, how many different words follow it, and how many different words it
follows. A class's probability of a word after a context rests on its discounted
pair count; what the discount leaves goes to the number of different words that the
word follows in the class, and from there to both classes together. So a rare
expression says little for either class, and one that many toxic and no ordinary
documents have says much. Each class's probabilities sum to 1 after every context.
The difference of the two log-likelihoods is taken per word: over the whole document,
and over its most toxic passages, as an insult in a long text would vanish in the mean.

A class's count up to the discount changes no ratio by itself, so only the counts
above it are looked up, and those of words and contexts that have such a pair: pairs,
words and contexts without them have the same ratio as if all were at hand.

The most frequent of these, a bounded number, are sent to all executors, with a bit
table of bounded size that marks the others. Texts are scored in chunks; what a chunk
needs besides, and is marked, is joined, each key once per chunk, so no key has many
rows, and brought back to the chunk's texts. A mark that two keys share costs a row
and no more; a full bit table costs rows for all keys.

A logistic curve turns these into a probability. It is fitted on a bounded sample
of the training documents, each scored without its own counts.
"""

from __future__ import annotations

import zlib
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.llm.arrow_text import GOLDEN, NOT_ALNUM, Words, mix, pieces
from tallyline.llm.graph import stored

FREQUENT = 1 << 22  # counts (24 bytes each at most) sent to all executors, at most
COUNT_WORDS = 1 << 20  # words whose pairs are counted together before the shuffle
DISCOUNT = 3  # taken off every count of a class, or all of a smaller count
SHARED_DISCOUNT = 0.75  # taken off the counts of both classes together
BACKOFF = 1e7  # counts that the lower order adds to every context
SHARED = 20.0  # counts that both classes together add to a class, per count of it
LARGEST = 8.0  # log ratio of one word, at most
MARKS = 27  # bits of a place in the table of marks (16 MB)
SEGMENTS = 64  # parts in which the marks are gathered
PASSAGES = (1, 4, 12)  # words of a passage
CALIBRATION_ROWS = 6000  # documents the curve is fitted on, at most
LABEL_ROWS = 2_000_000  # most labels (about 10 bytes each) sent to all executors
_START = np.uint64(0x7E57A47)  # stands before the first word
# Tell the keys of a word, of a context and of what follows it from that of a pair.
_ALONE, _CONTEXT, _FOLLOWED = (np.uint64(n) for n in (0x0A10E, 0xC0472, 0xF0110))
PAIR, ALONE, CONTEXT, FOLLOWED = range(4)
_LIST = T.ArrayType(T.DoubleType())
_EXACT = float(1 << 20)  # ratios are multiples of its inverse, so their sums are exact


def _key(kind: int, before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key under which a count is kept."""
    if kind == PAIR:
        return mix(mix(before + GOLDEN) ^ word)
    if kind == ALONE:
        return mix(word ^ _ALONE)
    return mix(before ^ (_CONTEXT if kind == CONTEXT else _FOLLOWED))


class Pairs:
    """The word pairs of some texts: hashes of both words, and the keys of the pair,
    of its second word, of its context and of what follows the context."""

    def __init__(self, texts: pa.Array):
        words = Words(texts, NOT_ALNUM)
        self.text, self.first, self.after = words.text, words.first, words.hash
        self.before = np.empty_like(words.hash)
        self.before[1:] = words.hash[:-1]
        self.before[words.first[:-1][words.count > 0]] = _START

    def keys(self) -> np.ndarray:
        """Keys by kind and place."""
        return np.stack([_key(kind, self.before, self.after) for kind in range(4)])


def _summed(parts: list) -> pa.RecordBatch:
    """Places of each class by pair."""
    before, word, toxic = (np.concatenate(columns) for columns in zip(*parts))
    order = np.lexsort((before, word))
    before, word, toxic = before[order], word[order], toxic[order]
    new = np.ones(len(order), bool)
    new[1:] = (before[1:] != before[:-1]) | (word[1:] != word[:-1])
    starts = np.flatnonzero(new)
    counts = [np.add.reduceat(mine.astype(np.int64), starts) for mine in (~toxic, toxic)]
    columns = [before[starts].view(np.int64), word[starts].view(np.int64), *counts]
    return pa.RecordBatch.from_arrays(
        [pa.array(c) for c in columns], names=["before", "word", "ordinary", "toxic"]
    )


def _count(batches):
    parts, words = [], 0
    for batch in batches:
        for part in pieces(batch, "text"):
            pairs = Pairs(part.column("text"))
            toxic = part.column("toxic").to_numpy(zero_copy_only=False)[pairs.text] == 1
            if len(pairs.after):
                parts.append((pairs.before, pairs.after, toxic))
            words += len(pairs.after)
            if words >= COUNT_WORDS:
                yield _summed(parts)
                parts, words = [], 0
    if parts:
        yield _summed(parts)


def count_tables(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of texts with a class: places of each class by pair (``before, word, ordinary,
    toxic``); and by ``kind`` and ``word``, in each class, the different words before
    a word, the places of a context, and what the discount takes off the pairs after it."""
    rows = known.mapInArrow(_count, "before long, word long, ordinary long, toxic long")
    names = ("ordinary", "toxic")
    sums = [F.sum(name).alias(name) for name in names]
    some = [F.sum((F.col(name) > 0).cast("long")).alias(name) for name in names]
    taken = [F.sum(F.least(name, F.lit(DISCOUNT).cast("long"))).alias(name) for name in names]
    pairs = stored(rows.groupBy("before", "word").agg(*sums), "pairs", "zstd")
    alone = pairs.groupBy("word").agg(*some).withColumn("kind", F.lit(ALONE))
    context = pairs.groupBy(F.col("before").alias("word"))
    places = context.agg(*sums).withColumn("kind", F.lit(CONTEXT))
    followed = context.agg(*taken).withColumn("kind", F.lit(FOLLOWED))
    words = alone.unionByName(places).unionByName(followed)
    return pairs, stored(words, "words", "zstd")


def _keyed(batches):
    """Counts by key."""
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        before, word = (batch.column(n).to_numpy().view(np.uint64) for n in ("before", "word"))
        key = np.empty(len(kind), np.uint64)
        for k in np.unique(kind):
            at = kind == k
            key[at] = _key(k, before[at], word[at])
        columns = [pa.array(key.view(np.int64)), batch.column("ordinary"), batch.column("toxic")]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "ordinary", "toxic"])


def keyed_counts(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The counts that ratios depend on, as ``key, ordinary, toxic``.

    Of pairs, those beyond the discount in a class. Of contexts, those with such a
    pair: the discount takes all of any other, and its factor is 1. Of words, those with
    such a pair or that follow more words than the discount in a class: any other has
    its share of ``B`` in both classes, and ``B`` falls out of the ratio."""
    much = F.greatest("ordinary", "toxic") > DISCOUNT
    often = pairs.filter(much)
    rows = [often.withColumn("kind", F.lit(PAIR))]
    words = words.withColumn("before", F.col("word"))
    alone = F.col("kind") == ALONE
    followers = words.filter(alone).join(often.select("word").distinct(), "word", "left_semi")
    rows += [words.filter(alone & much), followers.filter(~much)]
    contexts = often.select(F.col("before").alias("word")).distinct()
    rows.append(words.filter(~alone).join(contexts, "word", "left_semi"))
    found = reduce(DataFrame.unionByName, rows)
    return found.mapInArrow(_keyed, "key long, ordinary long, toxic long")


class Counts:
    """Counts of both classes by key, looked up in sorted keys."""

    def __init__(self, table: pa.Table):
        keys = table.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        values = [table.column(n).to_numpy()[order] for n in ("ordinary", "toxic")]
        small = np.min_scalar_type(max((int(v.max()) for v in values if len(v)), default=0))
        self.values = np.stack(values).astype(small)

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The counts (zero if there are none here), and which keys are here."""
        if not len(self.keys):
            return np.zeros((2, len(keys)), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        here = self.keys[at] == keys
        return np.where(here, self.values[:, at], 0).astype(np.int64), here


def _bits(batches):
    """The marks of a partition's keys, by segment."""
    marks = np.zeros(1 << MARKS >> 3, np.uint8)
    for batch in batches:
        place = batch.column("key").to_numpy().view(np.uint64) >> np.uint64(64 - MARKS)
        bit = np.left_shift(np.uint8(1), (place & np.uint64(7)).astype(np.uint8))
        np.bitwise_or.at(marks, (place >> np.uint64(3)).astype(np.int64), bit)
    for i, part in enumerate(marks.reshape(SEGMENTS, -1)):
        if part.any():
            packed = zlib.compress(part.tobytes(), 1)
            yield pa.RecordBatch.from_pydict(
                {"segment": pa.array([i], pa.int32()), "marks": pa.array([packed], pa.binary())}
            )


def _united(batches):
    """The marks of all partitions, by segment."""
    found: dict = {}
    for batch in batches:
        for i, packed in zip(*(batch.column(n).to_pylist() for n in ("segment", "marks"))):
            part = np.frombuffer(zlib.decompress(packed), np.uint8)
            found[i] = found[i] | part if i in found else part
    for i, part in found.items():
        yield pa.RecordBatch.from_pydict(
            {"segment": pa.array([i], pa.int32()), "marks": pa.array([part.tobytes()], pa.binary())}
        )


def marks_of(counts: DataFrame) -> np.ndarray:
    """A table of bits in which every key of ``counts`` has its place marked."""
    kind = "segment int, marks binary"
    rows = counts.select("key").mapInArrow(_bits, kind).repartition(SEGMENTS, "segment")
    marks = np.zeros((SEGMENTS, (1 << MARKS >> 3) // SEGMENTS), np.uint8)
    for row in rows.mapInArrow(_united, kind).collect():  # one row a segment
        marks[row["segment"]] = np.frombuffer(row["marks"], np.uint8)
    return marks.ravel()


class ClassModels:
    """The frequent counts, marks of the others, and what follows from counts.

    With a class c, the different words f_c(w) before w, which sum to F_c (f and F: both
    classes added up), V different words, a discount d below 1 and a whole one D:

    ``B(w)       = (cut(f(w), d) + d V / (V + 1)) / F``
    ``P_c(w)     = (cut(f_c(w), D) + (L_c + SHARED F_c) B(w)) / (F_c + SHARED F_c)``
    ``P_c(w | v) = (cut(n_c(v, w), D) + (L_c(v) + BACKOFF) P_c(w)) / (n_c(v) + BACKOFF)``

    Here n counts the places of a pair and of a context, ``cut`` takes the discount off
    (down to 0), and L adds up what was taken off: of f_c, and of the pairs after v. Over
    all words and one unknown word each of the three sums to 1. With D above 1 an
    expression seen D times or less in a class has its share of the lower order alone.
    ``totals`` are F and L by class, and V."""

    def __init__(self, frequent: Counts, totals: dict, marks: np.ndarray | None = None):
        self.frequent, self.marks = frequent, marks
        self.sums = totals["sums"]
        self.all_sums = max(sum(totals["sums"]), 1)
        self.left, self.all_words = totals["left"], totals["all_words"]

    def unknown(self, keys: np.ndarray) -> np.ndarray:
        """Which keys may have counts that are not here."""
        there = ~self.frequent.of(keys)[1]
        if self.marks is not None:
            place = keys >> np.uint64(64 - MARKS)
            byte = self.marks[(place >> np.uint64(3)).astype(np.int64)]
            there &= (byte >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return there

    def probabilities(self, counts: np.ndarray) -> list[np.ndarray]:
        """``P_c(w | v)`` by class, of counts by class, kind and place."""
        both = counts[:, ALONE].sum(axis=0)
        spread = SHARED_DISCOUNT * self.all_words / (self.all_words + 1)
        base = (np.maximum(both - SHARED_DISCOUNT, 0) + spread) / self.all_sums
        if not self.all_words:
            base = np.ones(len(both))
        found = []
        for (pair, alone, context, left), total, taken in zip(counts, self.sums, self.left):
            lower = base
            if total:
                shared = (taken + SHARED * total) * base
                lower = (np.maximum(alone - DISCOUNT, 0) + shared) / (total * (1 + SHARED))
            top = np.maximum(pair - DISCOUNT, 0) + (left + BACKOFF) * lower
            found.append(top / (context + BACKOFF))
        return found

    def log_ratios(self, counts: np.ndarray) -> np.ndarray:
        """Log of toxic over ordinary probability, word by word."""
        ordinary, toxic = self.probabilities(counts)
        ratios = np.clip(np.log(toxic) - np.log(ordinary), -LARGEST, LARGEST)
        return np.round(ratios * _EXACT) / _EXACT

    def measured(self, part: pa.RecordBatch, found: Counts | None = None) -> tuple[list, list]:
        """Features of each text; and, for texts with a class in ``own``, features
        without the text's own counts (else null)."""
        pairs = Pairs(part.column("text"))
        at = pairs.keys()
        keys, which = np.unique(at, return_inverse=True)
        counts = sum(t.of(keys)[0] for t in (self.frequent, found) if t is not None)
        counts = counts[:, which.reshape(at.shape)].astype(float)
        features = text_features(self.log_ratios(counts), pairs.first).tolist()
        alone: list = [None] * part.num_rows
        for i, own in enumerate(part.column("own").to_pylist()):
            if own is not None:
                mine = slice(pairs.first[i], pairs.first[i + 1])
                ratios = self.log_ratios(_without_own(at[:, mine], counts[:, :, mine], own))
                ends = np.array([0, len(ratios)])
                alone[i] = text_features(ratios, ends)[0].tolist()
        return features, alone


def _without_own(keys: np.ndarray, counts: np.ndarray, own: int) -> np.ndarray:
    """A learned text's counts, by class, kind and place, without what this text brought
    in. The totals of the classes stay. A pair that the class has no more often than the
    discount may not be at hand, and is taken for one of this text alone."""
    counts = counts.copy()
    mine = counts[own]
    _, first, which, times = np.unique(
        keys[PAIR], return_index=True, return_inverse=True, return_counts=True
    )
    mine[PAIR] = np.maximum(mine[PAIR], times[which])
    only = first[mine[PAIR, first] <= times]  # pairs of no other text of the class
    taken = np.minimum(mine[PAIR, first], DISCOUNT)
    taken -= np.minimum(np.maximum(mine[PAIR, first] - times, 0), DISCOUNT)
    mine[PAIR] -= times[which]
    for kind, places, lost in (
        (CONTEXT, first, times), (ALONE, only, np.ones(len(only))), (FOLLOWED, first, taken)
    ):
        words, which = np.unique(keys[kind], return_inverse=True)
        mine[kind] -= np.bincount(which[places], lost, len(words))[which]
    np.maximum(mine, 0, out=mine)
    return counts


def text_features(ratios: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: the mean ratio, and for each passage length the best passage's sum
    over the length. Texts without words have zeros."""
    counts = np.diff(first)
    sums = np.concatenate([[0], np.cumsum(ratios)])
    found = np.zeros((len(counts), 1 + len(PASSAGES)))
    some = counts > 0
    found[some, 0] = (sums[first[1:]] - sums[first[:-1]])[some] / counts[some]
    if some.any():
        at = np.arange(len(ratios))
        end = np.repeat(first[1:], counts)
        heads = first[:-1][some]
        for i, size in enumerate(PASSAGES, 1):
            passage = sums[np.minimum(at + size, end)] - sums[at]
            found[some, i] = np.maximum.reduceat(passage, heads) / size
    return found


def fit_curve(features: np.ndarray, labels: np.ndarray, penalty: float = 1e-3) -> dict:
    """Logistic regression by Newton steps on standardised features."""
    mean, spread = features.mean(axis=0), features.std(axis=0) + 1e-6
    x = np.column_stack([np.ones(len(labels)), (features - mean) / spread])
    weights = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (p - labels) / len(labels) + penalty * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(labels)
        step = np.linalg.solve(curve + penalty * np.eye(len(weights)), gradient)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return {"mean": mean, "spread": spread, "weights": weights}


def apply_curve(curve: dict, features: np.ndarray) -> np.ndarray:
    z = curve["weights"][0] + (features - curve["mean"]) / curve["spread"] @ curve["weights"][1:]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out_rows(id_column: str = "doc_id"):
    """Rows whose label is never learned."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame) -> tuple[ClassModels, DataFrame | None, DataFrame]:
    """From all labelled rows that are not held out: models with the frequent counts,
    the other counts (``key, ordinary, toxic``; none if there are no others), and the
    sample for the curve (``id, own``). ``docs``: ``id, text``; ``labels``: ``id, toxic``.
    An id with several labels is toxic if any of them says so; null ids and null
    labels are passed over."""
    labels = labels.filter(F.col("id").isNotNull() & F.col("toxic").isNotNull())
    labels = labels.groupBy("id").agg(F.max("toxic").cast("int").alias("toxic"))
    labels = stored(labels.filter(~held_out_rows("id")), "labels")
    few = F.broadcast(labels) if labels.count() <= LABEL_ROWS else labels
    pairs, words = count_tables(docs.join(few, "id").select("text", "toxic"))
    names = ("ordinary", "toxic")
    sums = [F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]
    left = [F.least(n, F.lit(DISCOUNT).cast("long")) for n in names]
    left = [F.coalesce(F.sum(c), F.lit(0)).alias(f"{n}_left") for c, n in zip(left, names)]
    row = words.filter(F.col("kind") == ALONE).agg(*sums, *left, F.count("*").alias("all")).first()
    totals = {
        "sums": [row[n] for n in names],
        "left": [row[f"{n}_left"] for n in names],
        "all_words": row["all"],
    }
    counts = stored(keyed_counts(pairs, words), "counts", "zstd")
    level = F.floor(F.log2(F.col("ordinary") + F.col("toxic")) * 8).cast("int")
    levels = counts.groupBy(level.alias("level")).count().collect()  # 8 by power of two
    least, room = 1 << 30, FREQUENT
    for row in sorted(levels, key=lambda row: -row["level"]):
        room -= row["count"]
        if room < 0:
            break
        least = row["level"]
    rare = counts.filter(level < least) if room < 0 else None
    marks = None if rare is None else marks_of(rare)
    models = ClassModels(Counts(counts.filter(level >= least).toArrow()), totals, marks)
    sample = labels.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(CALIBRATION_ROWS)
    sample = sample.select("id", F.col("toxic").alias("own"))
    return models, rare, sample


def _with_features(part: pa.RecordBatch, names: list, features: list, alone: list):
    kind = pa.list_(pa.float64())
    return pa.RecordBatch.from_arrays(
        [*(part.column(n) for n in names), pa.array(features, kind), pa.array(alone, kind)],
        names=[*names, "features", "alone"],
    )


def _chunked(batches, names: list):
    """Rows with the number of their chunk, about half a megabyte of whole texts."""
    chunk = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in pieces(batch, "text"):
            yield pa.RecordBatch.from_arrays(
                [*(part.column(n) for n in names), pa.array(np.full(part.num_rows, chunk))],
                names=[*names, "chunk"],
            )
            chunk += 1


def _wanted(batches, shared):
    """Keys of a chunk that may have counts beyond the frequent ones, once each."""
    for batch in batches:
        of = batch.column("chunk").to_numpy()
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        for start, stop in zip(starts, np.append(starts[1:], len(of))):
            pairs = Pairs(batch.column("text").slice(start, stop - start))
            keys = np.unique(pairs.keys())
            keys = keys[shared.value.unknown(keys)].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), of[start])), pa.array(keys)], names=["chunk", "key"]
            )


def measure(
    given: DataFrame, models: ClassModels, rare: DataFrame | None, with_text: bool = False
) -> DataFrame:
    """Rows of ``given`` (``text``, ``own`` and others), without the text unless it is
    asked for, but with ``features`` and ``alone``."""
    shared = given.sparkSession.sparkContext.broadcast(models)
    names = [name for name in given.columns if with_text or name != "text"]
    schema = T.StructType([given.schema[name] for name in names])
    schema = schema.add("features", _LIST).add("alone", _LIST)
    if rare is None:

        def direct(batches):
            for batch in batches:
                for part in pieces(batch, "text"):
                    yield _with_features(part, names, *shared.value.measured(part))

        return given.mapInArrow(direct, schema)
    chunked = T.StructType(list(given.schema.fields)).add("chunk", "long")
    texts = stored(given.mapInArrow(partial(_chunked, names=given.columns), chunked), "chunks", "zstd")
    wanted = texts.select("chunk", "text").mapInArrow(
        partial(_wanted, shared=shared), "chunk long, key long"
    )
    # A chunk on both sides of a file split asks twice for the same.
    found = wanted.join(rare, "key").select("chunk", "key", "ordinary", "toxic")

    def joined(rows: pa.Table, counts: pa.Table) -> pa.Table:
        parts, found = rows.combine_chunks().to_batches(), Counts(counts)
        done = [_with_features(p, names, *shared.value.measured(p, found)) for p in parts]
        return pa.Table.from_batches(done)

    return texts.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(joined, schema)


def curve_from(rows: list) -> dict:
    """The curve from rows ``(own, alone)``."""
    if len({own for own, _ in rows}) < 2:
        zeros = np.zeros(1 + len(PASSAGES))
        share = sum(own for own, _ in rows) / max(len(rows), 1)
        odds = float(np.clip(np.log((share + 1e-3) / (1 - share + 1e-3)), -6, 6))
        return {"mean": zeros, "spread": zeros + 1, "weights": np.append(odds, zeros)}
    rows = sorted(rows)
    return fit_curve(np.array([alone for _, alone in rows]), np.array([own for own, _ in rows]))


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.3,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: its id and the ``keep`` columns, ``held_out`` (its label
    was not learned), ``score`` (probability of the label, from the text alone) and ``predicted`` (1
    from the threshold on). ``labels`` has the same id column.

    Null and empty texts, and texts without words, score what the curve gives for
    no evidence. Rows are scored one by one, also with a repeated or null id. Without
    labels of both classes every row scores the share of toxic labels (0.5 without
    any). Only the named columns are read, so clashing names of others do no harm."""
    spark = docs.sparkSession
    place = {text_column: "text", id_column: "id"}  # each kept once
    kept = {name: place.get(name, f"_keep{i}") for i, name in enumerate(keep)}
    others = {name: alias for name, alias in kept.items() if alias.startswith("_keep")}
    given = docs.select(
        F.col(id_column).alias("id"),
        F.col(text_column).alias("text"),
        *(F.col(name).alias(alias) for name, alias in others.items()),
    )
    marked = labels.select(F.col(id_column).alias("id"), F.col(label_column).alias("toxic"))
    models, rare, sample = train(given.select("id", "text"), marked)
    given = given.join(F.broadcast(sample), "id", "left")
    with_text = text_column in keep
    measured = stored(measure(given, models, rare, with_text), "measured", "zstd")
    fitted = measured.filter(F.col("own").isNotNull())
    fitted = fitted.orderBy(F.xxhash64("id", F.lit(7)), "id", "alone").select("own", "alone")
    curve = curve_from([tuple(row) for row in fitted.limit(CALIBRATION_ROWS).collect()])

    def score(batches):
        for batch in batches:
            features = batch.column("features").flatten().to_numpy()
            scores = apply_curve(curve, features.reshape(batch.num_rows, -1))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(scores)], names=[*names, "score"]
            )

    names = ["id", *others.values(), *(["text"] if with_text else [])]
    schema = T.StructType([given.schema[name] for name in names]).add("score", "double")
    return measured.mapInArrow(score, schema).select(
        F.col("id").alias(id_column),
        *(F.col(alias).alias(name) for name, alias in kept.items()),
        held_out_rows("id").alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
