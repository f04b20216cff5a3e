"""Words of documents that also stand in benchmark items, found by winnowing.

A window is ``window`` consecutive words of an item, or the whole item if it is
shorter. Both sides hash every ``gram`` words and keep, for each window, the least
of its gram hashes: two equal windows keep the same fingerprint, so every shared
span of a window or more shares one (Schleimer et al., "Winnowing", 2003). Runs of
windows with one minimum are a single fingerprint. Fingerprints of both sides are
joined; a hit is extended to the windows behind it, whose full content is joined
with the windows of the items.

All of it is DataFrame functions, and each document passes once: the row that
stands for the document itself goes through the joins with its fingerprints, so
the texts are not read again for the result. Where the items have too many windows
to be sent to all executors, the hashed words are written once and looked up again
for the fingerprints that hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.graph import stored
from tallyline.llm.native_text import alnum_words

RUN = 64  # windows that one fingerprint stands for at most
BROADCAST_ROWS = 500_000  # most item windows (about 40 bytes each) sent to all executors


def _upto(n: Column) -> Column:
    """0, 1, ..., n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _content(words: Column, at: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), *[F.get(words, at + j) for j in range(length)])


def _hashed(rows: DataFrame, text_column: str) -> DataFrame:
    """``words``: a 64-bit hash of each word."""
    hashes = F.transform(alnum_words(F.col(text_column)), lambda w: F.xxhash64(w))
    return rows.withColumn("words", F.coalesce(hashes, F.array().cast("array<bigint>")))


def _minima(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """``minima``: for each window of the words, its least gram hash."""
    words, wide = F.col("words"), window - gram + 1
    # Texts below a window have no grams, as they have no minima.
    grams = F.when(F.size(words) >= window, F.size(words) - gram + 1).otherwise(0)
    rows = rows.withColumn(
        "grams",
        F.transform(
            _upto(grams), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(gram)])
        ),
    )
    least = F.transform(
        _upto(F.size("grams") - wide + 1),
        lambda i: F.least(*[F.get("grams", i + j) for j in range(wide)])
        if wide > 1
        else F.get("grams", i),
    )
    return rows.withColumn("minima", least).drop("grams")


def item_windows(
    benchmark: DataFrame, window: int, gram: int, item_column: str, text_column: str
) -> DataFrame:
    """``length, print, content, items``: each distinct window of the items, its
    fingerprint, and the items that have it."""
    items = benchmark.select(F.col(item_column).alias("item"), F.col(text_column).alias("text"))
    items = _minima(_hashed(items.filter(F.col("item").isNotNull()), "text"), window, gram)
    words, size = F.col("words"), F.size("words")
    full = F.transform(
        _upto(F.size("minima")),
        lambda i: F.struct(
            F.lit(window).alias("length"),
            F.get("minima", i).alias("print"),
            _content(words, i, window).alias("content"),
        ),
    )
    short = F.array().cast("array<struct<length:int,print:bigint,content:bigint>>")
    for length in range(1, window):
        whole = _content(words, F.lit(0), length)
        one = F.struct(
            F.lit(length).alias("length"), whole.alias("print"), whole.alias("content")
        )
        short = F.when(size == length, F.array(one)).otherwise(short)
    found = items.select(
        "item", F.explode(F.when(size >= window, full).otherwise(short)).alias("w")
    ).select("item", "w.*")
    return found.groupBy("length", "print", "content").agg(
        F.array_sort(F.collect_set("item")).alias("items")
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    gram: int = 6,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """One row per document: its id, ``n_words``, ``n_hit`` (words inside any
    occurrence of a window), ``items`` (ids of the items with such windows, in
    order) and ``contaminated`` (``n_hit > 0``).

    Null texts count as empty; empty texts have no words and no hits; empty items
    have no window; items with a null id take no part, and rows with one item id
    are one item. Each row is a document of its own, also with a repeated or null
    id. Only the named columns are read, so clashing names of others do no harm."""
    spark = docs.sparkSession
    windows = stored(
        item_windows(benchmark, window, gram, item_column, item_text_column), "item_windows"
    )
    # At most window - 1 lengths of short items.
    lengths = [r[0] for r in windows.select("length").distinct().collect()]
    few = windows.count() <= BROADCAST_ROWS
    hint = F.broadcast if few else (lambda df: df)

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = _minima(_hashed(rows, "text").drop("text"), window, gram)
    words, minima = F.col("words"), F.col("minima")

    def mark(length, at, value) -> Column:
        return F.struct(
            F.lit(length).alias("length"), at.alias("at"), value.alias("print")
        )

    def spans(length: int) -> Column:
        """All spans of the length, for short items."""
        starts = _upto(F.size(words) - length + 1)
        return F.transform(starts, lambda i: mark(length, i, _content(words, i, length)))

    fresh = F.filter(
        _upto(F.size(minima)),
        lambda i: (i % RUN == 0) | (F.get(minima, i) != F.get(minima, i - 1)),
    )
    # The row of the document itself, under a number that spreads such rows.
    marks = [F.array(mark(0, F.lit(-1), F.xxhash64("row")))]
    marks.append(F.transform(fresh, lambda i: mark(window, i, F.get(minima, i))))
    for length in sorted(set(lengths) - {window}):
        marks.append(spans(length))
    prints = windows.select("length", "print").distinct().withColumn("known", F.lit(True))
    if not few:
        # Only fingerprints are dealt by key then; the words follow for hits alone.
        rows = stored(rows, "word_hashes")
    marked = rows.withColumn("mark", F.explode(F.concat(*marks)))
    texts = ["id", "words", "minima"]
    found = (
        marked.select("row", *(texts if few else []), "mark.*")
        .join(hint(prints), ["length", "print"], "left")
        .filter((F.col("length") == 0) | F.col("known"))
    )
    if not few:
        found = found.join(rows, "row")

    # From a fingerprint to the windows it stands for.
    last = F.least(F.col("at") + (RUN - 1) - F.col("at") % RUN, F.size(minima) - 1)
    starts = F.filter(
        F.sequence(F.col("at"), F.greatest(last, F.col("at"))),
        lambda i: F.get(minima, i) == F.col("print"),
    )
    hits = F.transform(
        starts, lambda i: F.struct(i.alias("at"), _content(words, i, window).alias("content"))
    )
    itself = F.array(F.struct(F.col("at"), F.col("print").alias("content")))
    hit = F.explode(F.when(F.col("length") == window, hits).otherwise(itself))
    found = (
        found.select("row", "id", F.size(words).alias("n_words"), "length", hit.alias("hit"))
        .select("row", "id", "n_words", "length", "hit.*")
        .join(hint(windows.select("length", "content", "items")), ["length", "content"], "left")
        .filter((F.col("length") == 0) | F.col("items").isNotNull())
    )

    span = F.when(F.col("items").isNotNull(), F.struct("at", "length"))
    by_row = found.groupBy("row", "id", "n_words").agg(
        F.array_sort(F.collect_set(span)).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    zero = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))

    def cover(so_far, s) -> Column:
        end = (s["at"] + s["length"]).cast("bigint")
        more = F.greatest(F.lit(0), end - F.greatest(so_far["end"], s["at"]))
        return F.struct(
            F.greatest(so_far["end"], end).alias("end"), (so_far["n"] + more).alias("n")
        )

    return by_row.select(
        F.col("id").alias(id_column),
        F.col("n_words").cast("bigint").alias("n_words"),
        F.aggregate("spans", zero, cover, lambda x: x["n"]).alias("n_hit"),
        "items",
    ).withColumn("contaminated", F.col("n_hit") > 0)
