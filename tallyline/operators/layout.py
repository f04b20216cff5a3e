"""Topic layout: partitions, dense offsets, and exact bounded reads.

Offsets and record counts need running totals over a whole partition. A window
over a partition would put all its rows in one task, so rows are first cut into
blocks of neighbouring order numbers: blocks are counted with a partial
aggregate, running totals run over the few block counts, and only rows of one
block ever meet in a task. The range of a partition is cut evenly into as many
blocks as its rows need; where order numbers stand close together, a block that
is still too large is cut again, within the range of its own rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.session import scratch_path

BLOCK = 1 << 18
# Each cuts a range in three at least, and there are 2^64 numbers.
MAX_LEVELS = 41
_BLOCK, _SPARE = "_block", "_spare"


def with_partition(df: DataFrame, partitions: int, key: str, otherwise: str) -> DataFrame:
    """Rows with equal keys share a partition; rows without a key are spread
    by another column."""
    chosen = F.when(F.col(key).isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(otherwise))
    return df.withColumn("partition", F.pmod(chosen, F.lit(partitions)).cast("int"))


def _block_of(order: str, block: int) -> Column:
    return F.call_function("div", F.col(order), F.lit(block))


def _block_sizes(df: DataFrame) -> DataFrame:
    """Rows per block, and rows of the same partition before the block."""
    sizes = df.groupBy("partition", _BLOCK).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("partition").orderBy(_BLOCK).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))


def order_blocks(df: DataFrame, order: str, block: int = BLOCK) -> tuple[DataFrame, list[str]]:
    """``df`` with the columns, also named, that number the block of each row in the
    order of a column of unique whole numbers. A block holds at most twice ``block``
    rows, unless numbers repeat; most hold about ``block``.

    Every level costs one count over partition and order alone. One is enough where
    partitions are small, two where numbers are spread evenly. Later levels cut
    only what is still too large, at least into three, so there are few."""
    place, keys = F.col(order).cast("double"), ["partition"]
    for level in range(MAX_LEVELS):
        cells = df.where(F.col(order).isNotNull() & F.col("partition").isNotNull())
        cells = cells.groupBy(*keys).agg(
            F.min(order).cast("double").alias("_low"),
            F.max(order).cast("double").alias("_high"),
            F.count(F.lit(1)).alias("_n"),
        )
        large = cells.where((F.col("_n") > 2 * block) & (F.col("_low") < F.col("_high")))
        blocks = F.ceil(F.col("_n") / F.lit(block))
        width = (F.col("_high") - F.col("_low")) / blocks
        cuts = large.select(*keys, "_low", width.alias("_width"), blocks.alias("_blocks"))
        path = scratch_path(df.sparkSession, "blocks")
        cuts.write.parquet(path)
        cuts = df.sparkSession.read.schema(cuts.schema).parquet(path)
        if cuts.isEmpty():
            break
        # The highest number of a range belongs to its last block.
        cut = F.least(F.floor((place - F.col("_low")) / F.col("_width")), F.col("_blocks") - 1)
        name = f"{_BLOCK}{level}"
        df = df.join(cuts, keys, "left").withColumn(name, F.coalesce(cut, F.lit(0)))
        df, keys = df.drop("_low", "_width", "_blocks"), [*keys, name]
    return df, keys


def with_offsets(df: DataFrame, order: str, block: int = BLOCK) -> DataFrame:
    """Adds dense offsets 0, 1, 2, ... per partition in the order of a column
    of unique whole numbers, see ``order_blocks``. A row without partition or order
    number stays, without an offset; such rows stay with the task that reads them."""
    known = F.col(order).isNotNull() & F.col("partition").isNotNull()
    blocked, keys = order_blocks(df, order, block)
    blocked = blocked.withColumn(_SPARE, F.when(~known, F.spark_partition_id()))
    within = Window.partitionBy(*keys, _SPARE).orderBy(order)
    place = F.row_number().over(within) - 1
    if len(keys) > 1:
        sizes = blocked.where(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        before = Window.partitionBy("partition").orderBy(*keys[1:])
        before = F.sum("_rows").over(before.rowsBetween(Window.unboundedPreceding, -1))
        starts = sizes.select(*keys, F.coalesce(before, F.lit(0)).alias("_before"))
        blocked = blocked.join(starts, keys, "left")
        place = F.col("_before") + place
    offset = F.when(known, place.cast("bigint"))
    return blocked.withColumn("offset", offset).drop(*keys[1:], _SPARE, "_before")


def first_records(df: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """Exactly the first ``n`` records of a topic in the order of partition and
    offset, gaps allowed. The place of the cut is found from offsets alone, within
    one block; payloads are only filtered, by conditions that reach the file scan."""
    places = df.select("partition", "offset")
    sizes = _block_sizes(places.withColumn(_BLOCK, _block_of("offset", block)))
    totals = sizes.groupBy("partition").agg(F.sum("_rows").alias("_total"))
    ahead = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_ahead", F.coalesce(F.sum("_total").over(ahead), F.lit(0)))
    counted = sizes.join(totals, "partition").withColumn(
        "_done", F.col("_ahead") + F.col("_before")
    )
    cut = counted.where((F.col("_done") < n) & (F.col("_done") + F.col("_rows") >= n)).first()
    if cut is None:
        return df if n > 0 else df.limit(0)
    same = F.col("partition") == cut["partition"]
    start, end = cut[_BLOCK] * block, (cut[_BLOCK] + 1) * block
    inside = places.where(same & (F.col("offset") >= start) & (F.col("offset") < end))
    taken = inside.orderBy("offset").limit(n - cut["_done"])
    last = taken.groupBy("offset").count().orderBy(F.desc("offset")).first()
    # A repeated record can stand at the cut; of its copies only some are taken.
    before = F.col("offset") < last["offset"]
    whole = df.where((F.col("partition") < cut["partition"]) | (same & before))
    edge = df.where(same & (F.col("offset") == last["offset"]))
    return whole.unionByName(edge.limit(last["count"]))
