"""Balanced label propagation: linked documents move towards their neighbours'
shard, under exact quotas.

Documents with equal texts are linked. Every document starts in a shard, with
shard sizes at most one row apart. In each round a group counts its members by
shard, and its members prefer the shard that holds most of them. A shard then
admits rows up to its quota: members that are there already, then members that
want in, then unlinked documents; whoever finds no room fills what is free
elsewhere, groups staying together. So sizes stay exact in every round, and the
cut (members outside their group's main shards, as many as it must fill) falls, and
rounds go on until it does not.

A group larger than a share of a shard is cut into pieces by a hash, each of which
moves as a group; the pieces of one group start together in one shard, or fill shards
one after another. No task ever holds a group or a shard. Ranks within a shard come
from counts of small blocks. All of it is DataFrame functions.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate, count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.graph import stored
from tallyline.llm.native_text import ranked

PIECE_ROWS = 20_000  # members that move as one at most
BLOCK_ROWS = 20_000  # rows that are sorted together, about


def _block(blocks: int) -> Column:
    """The block a row is sorted in: one for a piece, any for an unlinked row. (The
    hash of a null is a number like any other, so it cannot serve as a test.)"""
    linked = F.xxhash64("piece", F.lit(1))
    return F.pmod(F.when(F.col("piece").isNotNull(), linked).otherwise(F.col("mark")), F.lit(blocks))


def _quota(rows: int, shards: int, shard: int) -> int:
    return rows // shards + (shard < rows % shards)


def _filled(rank: Column, room: list[int]) -> Column:
    """The shard of a rank, if one shard's room is filled after another's."""
    ends = list(accumulate(max(0, free) for free in room))
    return reduce(
        lambda rest, pair: F.when(rank < pair[1], pair[0]).otherwise(rest),
        reversed(list(enumerate(ends[:-1]))),
        F.lit(len(room) - 1),
    )


def homes(pieces: list[tuple[int, int, int]], room: list[int]) -> dict[int, int]:
    """Shards for pieces ``(group, piece, rows)`` of cut groups, the largest group
    first: the fullest shard that takes the whole rest of a group, else the emptiest
    is filled with what fits. Takes the rows off ``room``; a piece that fits nowhere
    has no home."""
    groups: dict[int, list] = {}
    for group, piece, n in pieces:
        groups.setdefault(group, []).append((n, piece))
    found: dict[int, int] = {}
    for group in sorted(groups, key=lambda g: (-sum(n for n, _ in groups[g]), g)):
        left = sorted(groups[group], reverse=True)
        while left:
            total = sum(n for n, _ in left)
            fits = [shard for shard, free in enumerate(room) if free >= total]
            if fits:
                shard = min(fits, key=lambda k: room[k])
            else:
                shard = max(range(len(room)), key=lambda k: room[k])
            rest = []
            for n, piece in left:
                if n <= room[shard]:
                    found[piece] = shard
                    room[shard] -= n
                else:
                    rest.append((n, piece))
            if len(rest) == len(left):
                break
            left = rest
    return found


def _placed(nodes: DataFrame, shards: int, rows: int, blocks: int) -> DataFrame:
    """One round: the shard each row is admitted to."""
    here = nodes.filter(F.col("piece").isNotNull()).groupBy("piece", "shard")
    counts = here.agg(F.count(F.lit(1)).alias("n"))
    # Ties fall differently in each piece, so that no shard is preferred by many.
    strength = F.struct("n", F.xxhash64("piece", "shard"), "shard")
    target = counts.groupBy("piece").agg(F.max(strength)["shard"].alias("target"))
    # Unlinked rows are looked up under their own random number, which spreads them.
    target = target.withColumnRenamed("piece", "of")
    wishes = nodes.withColumn("of", F.coalesce("piece", "mark")).join(target, "of", "left")
    linked = F.col("piece").isNotNull()
    wishes = wishes.withColumn("target", F.when(linked, F.col("target"))).drop("of")
    kind = F.when(F.col("target").isNull(), 2).when(F.col("target") == F.col("shard"), 0)
    place = _block(blocks)
    wishes = (
        wishes.withColumn("prefer", F.coalesce("target", "shard"))
        .withColumn("order", F.when(F.col("piece").isNull(), 2).otherwise(
            kind.otherwise(1)) * blocks + place)
        .drop("target", "shard")
    )
    wishes = stored(ranked(wishes, "prefer", "order", ["piece", "mark"], "rank"), "wishes")
    quota = F.lit(rows // shards) + (F.col("prefer") < rows % shards).cast("int")
    # One row per shard.
    asked = dict(wishes.groupBy("prefer").count().collect())
    admitted = wishes.filter(F.col("rank") < quota).withColumn("shard", F.col("prefer"))
    over = wishes.filter(F.col("rank") >= quota).drop("rank").withColumn("all", F.lit(0))
    over = ranked(over, "all", "order", ["piece", "mark"], "rank")
    room = [_quota(rows, shards, shard) - asked.get(shard, 0) for shard in range(shards)]
    free = _filled(F.col("rank"), room)
    over = over.withColumn("shard", free)
    names = nodes.columns
    return admitted.select(*names).unionByName(over.select(*names))


def cut_rows(nodes: DataFrame, quota: int = 0) -> int:
    """Members that are not in the main shards of their group (of their piece, where
    no group is given): the fullest, as many as shards of ``quota`` rows must be filled."""
    group = "group" if "group" in nodes.columns else "piece"
    counts = nodes.filter(F.col(group).isNotNull()).groupBy(group, "shard")
    counts = counts.agg(F.count(F.lit(1)).alias("n"))
    # A group has as many rows here as there are shards, at most.
    by_group = Window.partitionBy(group)
    counts = counts.withColumn("all", F.sum("n").over(by_group)).withColumn(
        "place", F.row_number().over(by_group.orderBy(F.desc("n"), "shard"))
    )
    main = F.ceil(F.col("all") / quota) if quota else F.lit(1)
    cut = counts.filter(F.col("place") > main).agg(F.coalesce(F.sum("n"), F.lit(0)))
    return cut.first()[0]


def balanced_shards(
    docs: DataFrame,
    shards: int = 40,
    rounds: int | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: its id, ``size`` (UTF-8 bytes of the text plus
    16), ``text_crc32`` (of the text's UTF-8 bytes; null for a null text),
    ``shard`` and ``slot`` (its number in the shard, from 0 without gaps). Row
    counts of the shards differ by one at most. Without ``rounds`` there are as many as
    lower the cut.

    Null texts have size 16 and are not linked; empty texts are equal texts. Null
    and repeated ids are placed like any others, each row by itself. An empty table
    gives no rows. Only the two named columns are read, so clashing names of others
    do no harm."""
    text = F.col(text_column)
    nodes = stored(
        docs.select(
            F.col(id_column).alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 16).alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("text"),
            F.xxhash64(F.monotonically_increasing_id()).alias("mark"),
        ),
        "documents",
    )
    rows = nodes.count()
    blocks = max(64, -(-rows // BLOCK_ROWS))
    piece_rows = max(2, min(PIECE_ROWS, rows // shards // 8))
    groups = nodes.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    groups = groups.filter((F.col("n") > 1) & F.col("text").isNotNull())
    cuts = F.ceil(F.col("n") / piece_rows)
    piece = F.xxhash64("text", F.pmod(F.col("mark"), cuts))
    # A null text is looked up as the row's own random number, which no hash equals.
    nodes = nodes.withColumn("text", F.coalesce("text", F.to_binary(F.hex("mark"), F.lit("hex"))))
    nodes = nodes.join(groups, "text", "left").select(
        "id", "size", "text_crc32", "mark", F.when(F.col("n") > 1, piece).alias("piece"),
        F.when(F.col("n") > 1, F.xxhash64("text")).alias("group"),
        (F.coalesce("n", F.lit(0)) > piece_rows).alias("cut"),
    )
    nodes = stored(nodes, "linked")
    # Pieces have a good part of piece_rows, so there are few of them.
    sizes = nodes.filter("cut").groupBy("group", "piece").count().collect()
    room = [_quota(rows, shards, shard) for shard in range(shards)]
    found = homes([tuple(row) for row in sizes], room)
    home = docs.sparkSession.createDataFrame(list(found.items()), "piece long, home int")
    nodes = nodes.drop("cut")
    settled = nodes.join(F.broadcast(home), "piece").withColumnRenamed("home", "shard")
    nodes = nodes.join(F.broadcast(home), "piece", "left_anti")
    nodes = nodes.withColumn("order", F.pmod("mark", F.lit(blocks))).withColumn("all", F.lit(0))
    nodes = ranked(nodes, "all", "order", ["mark"], "rank")
    nodes = nodes.withColumn("shard", _filled(F.col("rank"), room)).drop("order", "all", "rank")
    nodes = stored(nodes.unionByName(settled), "start")
    quota = max(1, rows // shards)
    cut = cut_rows(nodes, quota)
    for _ in count() if rounds is None else range(rounds):
        if not cut:
            break
        moved = stored(_placed(nodes, shards, rows, blocks), "round")
        now = cut_rows(moved, quota)
        if now >= cut:
            break
        nodes, cut = moved, now
    place = _block(blocks)
    nodes = ranked(nodes.withColumn("order", place), "shard", "order", ["piece", "mark"], "slot")
    return nodes.select(
        F.col("id").alias(id_column), "size", "text_crc32", "shard", F.col("slot").cast("bigint")
    )
