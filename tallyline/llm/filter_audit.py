"""How filters interact: what each removes, and what others had removed before it.

A document fails some of a few named filters; which ones is a combination of
bits. All figures, for any order of the filters, follow from the number of
documents of each combination, so documents are reduced to these counts first.

Duplicates are one of the filters: a document fails it if any document with a
smaller id has the same text. That is a left-semi join of the table with itself,
on a hash of the text, the text and the smaller id:

* Hashes that more than one id has are found among hashes and ids alone; only
  texts with such a hash are compared.
* The right side is one row per different text with its least id, combined before
  the shuffle. A row with a smaller id exists if the least id is smaller.
* The left side is dealt out by salt as well, as many as the copies need, and the
  right side once for each, so that a large group of copies is many tasks' work.

The ids found are joined by union with those of the other failures, and the bits
of each document are aggregated.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.graph import stored

SPACES = r"[\x20\x09-\x0D]+"
COPIES_PER_TASK = 5_000  # rows of one text that a salt holds, about
BROADCAST_ROWS = 200_000  # most hashes (16 bytes each) sent to all


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, SPACES, -1), "")


def under_words(least: int) -> Column:
    return F.size("_words") < least


def repeats_words(percent: int) -> Column:
    """Fewer different words than ``percent`` of all."""
    return F.lit(100) * F.size(F.array_distinct("_words")) < F.lit(percent) * F.size("_words")


def many_capitals(percent: int) -> Column:
    capitals = F.length(F.regexp_replace("_text", "[^A-Z]+", ""))
    return F.lit(100) * capitals > F.lit(percent) * F.length("_text")


def holds(characters: str) -> Column:
    """Any of the characters; these are taken as they are."""
    return F.length(F.translate("_text", characters, "")) < F.length("_text")


def matches(pattern: str) -> Column:
    return F.col("_text").rlike(pattern)


def earlier_copies(given: DataFrame, marks: DataFrame) -> DataFrame:
    """``_id``, ``_digest`` and ``_part`` of the rows of ``marks`` whose text
    stands under a smaller id, too. ``given`` has ``_id``, ``_digest``, ``_part`` and
    ``_text``; ``marks`` the first three and ``_n``, rows of each."""
    shared = marks.groupBy("_digest").agg(
        F.min("_id").alias("_low"), F.max("_id").alias("_high"), F.sum("_n").alias("_copies")
    )
    salts = F.ceil(F.col("_copies") / F.lit(COPIES_PER_TASK)).cast("int")
    shared = shared.filter(F.col("_low") < F.col("_high")).select("_digest", salts.alias("_salts"))
    shared = stored(shared, "shared_hashes")
    few = shared.count() <= BROADCAST_ROWS
    side = F.broadcast(shared) if few else shared
    rows = given.filter(F.col("_id").isNotNull()).join(side, "_digest")
    least = rows.groupBy("_digest", "_text").agg(
        F.min("_id").alias("_least"), F.max("_salts").alias("_salts")
    )
    salt = F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_s")
    least = least.select(
        F.col("_digest").alias("_d"), F.col("_text").alias("_t"), "_least", salt
    )
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), "_salts").cast("int"))
    same = (
        (F.col("_digest") == F.col("_d"))
        & (F.col("_salt") == F.col("_s"))
        & (F.col("_text") == F.col("_t"))
        & (F.col("_least") < F.col("_id"))
    )
    return dealt.join(least, same, "left_semi").select("_id", "_digest", "_part")


def combinations(
    docs: DataFrame,
    labels: DataFrame,
    filters: dict[str, Column | None],
    id_column: str = "doc_id",
    text_column: str = "text",
    part_column: str = "source",
) -> DataFrame:
    """``part``, ``bits``, ``n``, ``good`` and ``toxic``: the documents of each part that
    fail the same filters, and how many of them are labelled so.

    ``filters`` has a condition for each name, over ``_text`` and ``_words``; a null
    one is undecided and counts as passed. None stands for "the text of a smaller id".
    Bit i is the i-th filter. Null texts are empty ones, null parts the empty part. A
    null id is not smaller than any, and none is smaller than it. Every row counts,
    also a repeated one; rows that share an id and a text have the same bits. Labels of
    an id in several rows: any 1 counts; a null id has none. Long texts are whole; their words are an
    array of one row. Columns not named are not read."""
    names = list(filters)
    given = docs.select(
        F.col(id_column).alias("_id"),
        F.coalesce(F.col(text_column), F.lit("")).alias("_text"),
        F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("_part"),
    ).withColumn("_digest", F.unhex(F.md5("_text")))
    own = [
        F.coalesce(condition, F.lit(False)).cast("int") * F.lit(1 << i)
        for i, condition in enumerate(filters.values())
        if condition is not None
    ]
    failed = reduce(Column.__add__, own, F.lit(0)).alias("_bits")
    failing = given.withColumn("_words", words(F.col("_text")))
    failing = failing.select("_id", "_digest", "_part", failed)
    marks = failing.groupBy("_id", "_digest", "_part", "_bits").agg(F.count(F.lit(1)).alias("_n"))
    marks = stored(marks, "marks")
    for name in names:
        if filters[name] is None:
            found = earlier_copies(given, marks).distinct()
            bit = F.lit(1 << names.index(name)).alias("_bits")
            none = F.lit(0).cast("bigint").alias("_n")
            marks = marks.unionByName(found.select("*", bit, none))
    # One row per id, text and part, then few rows per id; a hot id is few rows, too.
    rows = marks.groupBy("_id", "_digest", "_part").agg(
        F.bit_or("_bits").alias("_bits"), F.sum("_n").alias("_n")
    )
    rows = rows.groupBy("_id", "_part", "_bits").agg(F.sum("_n").alias("_n"))
    known = labels.groupBy(F.col(id_column).alias("_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("_good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("_toxic"),
    )
    judged = rows.join(known, "_id", "left")
    return judged.groupBy(F.col("_part").alias("part"), F.col("_bits").alias("bits")).agg(
        F.sum("_n").alias("n"),
        F.sum(F.when(F.col("_good"), F.col("_n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("_toxic"), F.col("_n")).otherwise(0)).alias("toxic"),
    )


def interactions(counted: DataFrame, names: list[str]) -> DataFrame:
    """One row per part, order of the filters and step, from ``combinations``.

    A part has at most 2^filters counts; these travel as one row, over which every
    order and step is worked out in place."""
    size = len(names)
    orders = [
        {
            "filter_order": "".join(names[i] for i in order),
            "step": step + 1,
            "own": 1 << order[step],
            "before": sum(1 << i for i in order[:step]),
        }
        for order in permutations(range(size))
        for step in range(size)
    ]
    shape = "array<struct<filter_order:string,step:int,own:int,before:int>>"
    steps = F.from_json(F.lit(json.dumps(orders)), shape)
    every = len(orders) // size
    entry = F.struct("bits", "n", "good", "toxic")
    parts = counted.groupBy("part").agg(F.collect_list(entry).alias("_counts"))
    rows = parts.select("part", "_counts", F.explode(steps).alias("_at"))
    own, before = F.col("_at.own"), F.col("_at.before")

    def total(kept, value) -> Column:
        zero = F.lit(0).cast("bigint")
        add = lambda sum_, c: sum_ + F.when(kept(c["bits"]), value(c)).otherwise(zero)
        return F.aggregate("_counts", zero, add)

    here = lambda bits: (bits.bitwiseAND(before) == 0) & (bits.bitwiseAND(own) != 0)
    fails = lambda bits: bits.bitwiseAND(own) != 0
    # Of k failed filters each comes first in the k-th part of all orders.
    share = lambda c: c["n"] * F.call_function("div", F.lit(every), F.bit_count(c["bits"]))
    return rows.select(
        "part", "_at.filter_order", "_at.step",
        total(lambda b: b.bitwiseAND(before.bitwiseOR(own)) == 0, lambda c: c["n"]).alias("kept"),
        total(here, lambda c: c["n"]).alias("removed"),
        total(lambda b: fails(b) & (b.bitwiseAND(before) != 0), lambda c: c["n"]).alias("redundant"),
        total(lambda b: b == own, lambda c: c["n"]).alias("unique_fails"),
        total(here, lambda c: c["good"]).alias("good_lost"),
        total(here, lambda c: c["toxic"]).alias("toxic_lost"),
        total(fails, share).alias("shapley"),
    )


def audit(
    docs: DataFrame,
    labels: DataFrame,
    filters: dict[str, Column | None],
    id_column: str = "doc_id",
    text_column: str = "text",
    part_column: str = "source",
) -> DataFrame:
    """``part``, ``filter_order``, ``step`` and, over the documents of the part when the
    filters are applied one after the other: ``kept`` after the step, ``removed`` by it,
    ``redundant`` (failing, but gone before), ``unique_fails`` (failing this filter
    only), ``good_lost`` and ``toxic_lost`` (labelled ones removed), ``shapley`` (removed
    by this filter, summed over all orders). All counts are long; empty tables have no
    parts. Nulls, ties, repeats and clashing names: see ``combinations``."""
    counted = combinations(docs, labels, filters, id_column, text_column, part_column)
    return interactions(counted, list(filters))
