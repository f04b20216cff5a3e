"""Words and ranks with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else changed. Pure ASCII texts, most of
    any corpus, take Spark's much faster ``lower``."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def alnum_words(text: Column) -> Column:
    """Digits, letters and all beyond ASCII, in runs."""
    pattern = F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.regexp_extract_all(lower_ascii(text), pattern, F.lit(0))


def ranked(df: DataFrame, key: str, order: str, ties: list[str], rank: str) -> DataFrame:
    """Number the rows of each ``key`` from 0 without gaps, by ``order`` (a block
    number with few rows each) and then ``ties``.

    Two levels: rows are counted by block, the counts are summed up in order,
    and only the rows of one block are ever sorted together."""
    counts = df.groupBy(key, order).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(
        Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = counts.select(key, order, F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(key, order).orderBy(*ties)) - 1
    joined = df.join(starts, [key, order])
    return joined.withColumn(rank, F.col("_before") + within).drop("_before")
