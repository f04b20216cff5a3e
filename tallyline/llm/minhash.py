"""Near-duplicate documents: SuperMinHash signatures, banding, verification and
union-find.

A document's set holds its distinct word shingles. Two documents are linked if
``100 * intersection >= percent * union``; groups are the components of links.

1. One pass over the texts gives each document the size of its set, a 128-bit
   name of the set and the keys of its signature's bands. Documents with equal
   sets are one node from here on, so copies cost nothing more.
2. Nodes that share a band are joined to the least node of the band (a star, not
   pairs); the components of the stars are the candidate clusters.
3. Clusters are cut into blocks of bounded size. All pairs of a block are compared
   inside one task on their whole sets, and joined by union-find there. Of a larger
   cluster, the best-linked nodes of some blocks then visit its other blocks, and at
   last every node outside its largest component does. A node visits the blocks with
   a node of linkable size in one of its own bands. A pair is left out only if it
   shares no band, cannot be linked by size, or is in one component already, so no
   link is lost that would change a component.

Two documents just at the bound share no band with a probability below one in a
million; that is the only way to miss a link.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.llm.arrow_text import GOLDEN, SPACES, Words, mix, pieces
from tallyline.llm.graph import components, stored

MISS = 1e-6  # chance that a pair just at the bound shares no band
BLOCK = 96  # nodes whose pairs one task compares at once
BLOCK_SHINGLES = 1 << 17  # and the mean sum of their set sizes
LEADERS = 8  # blocks of a large cluster that name a leader
SALTS = 16  # tasks that a cluster with a large part of all nodes is dealt over
BROADCAST_NODES = 200_000  # most nodes (about 80 bytes each) sent to all executors
_CELLS = 1 << 22  # cells of the incidence matrix at once


def bands_for(percent: int) -> tuple[int, int]:
    """Rows of a band and number of bands: rows enough that pairs of half the
    bound rarely meet, bands enough that pairs at the bound are not missed."""
    rows = 6 if percent >= 85 else 5 if percent >= 75 else 4
    hit = (percent / 100) ** rows
    if hit >= 1:
        return rows, 1
    return rows, int(np.ceil(np.log(MISS) / np.log1p(-hit)))


def _prime_from(n: int) -> int:
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, as one flat array,
    the text each belongs to, and the number per text. A text of fewer words is
    one shingle."""
    texts = len(words.count)
    factors = mix(np.arange(11, 11 + size, dtype=np.uint64) * GOLDEN) | np.uint64(1)
    total = len(words.hash)
    gram = np.zeros(total, np.uint64)
    full = max(0, total - size + 1)
    for j in range(size):
        gram[:full] += words.hash[j : j + full] * factors[j]
    last = words.first[1:] - size  # where the last shingle of a text begins
    valid = np.arange(total) <= last[words.text]
    flat, of = mix(gram[valid]), words.text[valid]
    few = np.flatnonzero((words.count > 0) & (words.count < size))
    if len(few):
        whole = np.zeros(len(few), np.uint64)
        for j in range(size - 1):
            there = words.count[few] > j
            whole[there] += words.hash[words.first[few][there] + j] * factors[j]
        whole = mix(whole ^ mix(words.count[few].astype(np.uint64)))
        flat, of = np.concatenate([flat, whole]), np.concatenate([of, few])
        order = np.argsort(of, kind="stable")
        flat, of = flat[order], of[order]
    ends = np.searchsorted(of, np.arange(texts), "right")
    start = 0
    for end in ends:
        flat[start:end].sort()
        start = end
    fresh = np.ones(len(flat), bool)
    fresh[1:] = (flat[1:] != flat[:-1]) | (of[1:] != of[:-1])
    flat, of = flat[fresh], of[fresh]
    return flat, of, np.bincount(of, minlength=texts)


def set_names(flat: np.ndarray, of: np.ndarray, texts: int) -> list[bytes]:
    """128 bits that depend on the whole set and not on its order."""
    name = np.zeros((texts, 2), ">u8")
    for side, salt in enumerate((0xA5A5A5A5A5A5A5A5, 0x0123456789ABCDEF)):
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(mix(flat ^ np.uint64(salt)), out=sums[1:])
        ends = np.searchsorted(of, np.arange(texts), "right")
        starts = np.searchsorted(of, np.arange(texts), "left")
        name[:, side] = mix(sums[ends] - sums[starts])
    return [row.tobytes() for row in name]


def superminhash(flat: np.ndarray, of: np.ndarray, texts: int, width: int) -> np.ndarray:
    """``width`` minima for each text, in rounds over all its elements at once.

    In round i an element offers the value ``i + fraction`` to the place that is
    number i in its own permutation of the places, so an element's values are
    spread evenly over the signature. Values only grow from round to round: a text
    is finished as soon as all its minima are below the next round's number. The
    permutations are ``(start + i * step) mod width`` with a prime width, which
    leaves each minimum a fair sample of the set, as elements are exchangeable."""
    step = np.uint64(1) + mix(flat ^ np.uint64(0x51ED270B)) % np.uint64(width - 1)
    place = mix(flat ^ np.uint64(0x2545F491)) % np.uint64(width)
    minima = np.full(texts * width, np.iinfo(np.uint64).max, np.uint64)
    base = (of * width).astype(np.uint64)
    open_texts = np.zeros(texts, bool)
    open_texts[of] = True
    for i in range(width):
        salt = np.uint64((i + 1) * int(GOLDEN) % (1 << 64))
        value = mix(flat + salt) >> np.uint64(9)
        np.minimum.at(minima, base + place, value | np.uint64(i << 55))
        at = np.flatnonzero(open_texts)
        done = minima.reshape(texts, width)[at].max(axis=1) < np.uint64((i + 1) << 55)
        open_texts[at[done]] = False
        if done.any():
            if done.all():
                break
            going = open_texts[of]
            flat, of, base = flat[going], of[going], base[going]
            step, place = step[going], place[going]
        place = place + step
        place[place >= width] -= np.uint64(width)
    return minima.reshape(texts, width)


def _sign(batches, shingle: int, rows: int, bands: int, least: int):
    width = _prime_from(rows * bands)
    factors = mix(np.arange(77, 77 + rows, dtype=np.uint64)) | np.uint64(1)
    salts = mix(np.arange(bands, dtype=np.uint64) + GOLDEN)
    for batch in batches:
        for part in pieces(batch, "text"):
            words = Words(part.column("text"), SPACES)
            flat, of, sizes = shingle_sets(words, shingle)
            texts = part.num_rows
            names = set_names(flat, of, texts)
            # Sets below ``least`` are linked with equal sets only.
            need = np.flatnonzero(sizes >= least)
            renumber = np.full(texts, -1)
            renumber[need] = np.arange(len(need))
            chosen = renumber[of] >= 0
            minima = superminhash(flat[chosen], renumber[of[chosen]], len(need), width)
            grid = minima[:, : rows * bands].reshape(len(need), bands, rows)
            keys = mix((grid * factors).sum(axis=2, dtype=np.uint64) ^ salts).view(np.int64)
            lists = np.zeros(texts + 1, np.int32)
            lists[1:] = np.cumsum((sizes >= least) * bands)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(names, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(lists), pa.array(keys.ravel())),
                ],
                names=["id", "n_shingles", "node", "bands"],
            )


def _sets(batches, shingle: int):
    """The set of each text that belongs to the node it is looked up for, once for
    each node of a task, with all other columns."""
    seen = set()
    for batch in batches:
        for part in pieces(batch, "text"):
            flat, of, sizes = shingle_sets(Words(part.column("text"), SPACES), shingle)
            names = set_names(flat, of, part.num_rows)
            wanted = part.column("node").to_pylist()
            ends = np.cumsum(sizes)
            rows = []
            for i, name in enumerate(names):
                if name == wanted[i] and name not in seen:
                    seen.add(name)
                    rows.append(i)
            packed = [flat[ends[i] - sizes[i] : ends[i]].tobytes() for i in rows]
            picked = part.drop_columns(["text"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*picked.columns, pa.array(packed, pa.binary())],
                names=[*picked.schema.names, "shingles"],
            )


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets, exactly."""
    n, m = len(left), len(right)
    found = np.zeros((n, m), np.float64)
    flat = np.concatenate(left + right)
    owner = np.repeat(np.arange(n + m), [len(s) for s in left + right])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    column = np.zeros(len(flat), np.int64)
    column[1:] = np.cumsum(flat[1:] != flat[:-1])
    # Elements that only one set has cannot count.
    often = np.bincount(column)[column] > 1
    owner = owner[often]
    column = np.unique(column[often], return_inverse=True)[1]
    step = max(1, _CELLS // (n + m))
    for low in range(0, int(column.max()) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, (low, low + step))
        grid = np.zeros((n + m, step), np.float32)
        grid[owner[a:b], column[a:b] - low] = 1
        found += grid[:n] @ grid[n:].T
    return np.rint(found).astype(np.int64)


def linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which left sets are linked with which right sets."""
    both = shared_counts(left, right)
    sizes = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])
    return 100 * both >= percent * (sizes - both)


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _groups(batches, keys: list[str], row_key: list[str]) -> Iterator[list[dict]]:
    """Rows of batches sorted by both keys, run by run of equal ``keys``; of rows that
    are equal in both, the first."""
    run, at, last = [], None, None
    for batch in batches:
        for row in batch.to_pylist():
            if (now := tuple(row[k] for k in keys)) != at:
                if run:
                    yield run
                run, at, last = [], now, None
            if (this := tuple(row[k] for k in row_key)) != last:
                run.append(row)
                last = this
    if run:
        yield run


def _block_links(batches, percent: int):
    """Union-find over all pairs of each block: links to the block's roots, and
    how many links each node has."""
    for rows in _groups(batches, ["cluster", "block"], ["node"]):
        sets = [np.frombuffer(row["shingles"], np.uint64) for row in rows]
        link = linked(sets, sets, percent)
        parent = list(range(len(rows)))
        for i, j in np.argwhere(np.triu(link, 1)).tolist():
            a, b = _find(parent, i), _find(parent, j)
            parent[max(a, b)] = min(a, b)
        yield pa.RecordBatch.from_pydict(
            {
                "cluster": [row["cluster"] for row in rows],
                "block": [row["block"] for row in rows],
                "u": [row["node"] for row in rows],
                "v": [rows[_find(parent, i)]["node"] for i in range(len(rows))],
                "degree": (link.sum(axis=1) - 1).tolist(),
            },
            schema=_BLOCK_LINKS,
        )


def _cross_links(batches, percent: int):
    """Links between the visitors of a block and its own nodes, as links of their
    roots, each once."""
    for run in _groups(batches, ["cluster", "block", "chunk"], ["visitor", "node"]):
        own = [row for row in run if not row["visitor"]]
        guests = [row for row in run if row["visitor"]]
        if not own or not guests:
            continue
        link = linked(
            [np.frombuffer(row["shingles"], np.uint64) for row in guests],
            [np.frombuffer(row["shingles"], np.uint64) for row in own],
            percent,
        )
        pairs = {(guests[i]["root"], own[j]["root"]) for i, j in np.argwhere(link).tolist()}
        yield pa.RecordBatch.from_pydict(
            {"u": [u for u, _ in pairs], "v": [v for _, v in pairs]}, schema=_LINKS
        )


_LINKS = pa.schema([("u", pa.binary()), ("v", pa.binary())])
_BLOCK_LINKS = pa.schema(
    [("cluster", pa.binary()), ("block", pa.int32()), *_LINKS, ("degree", pa.int64())]
)


def _with_cluster(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows with what is known of their cluster, if anything. A cluster may hold a
    large part of all rows, so its facts are copied for ``SALTS`` parts of it."""
    salt = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(SALTS)).cast("int")
    copies = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", salt).join(copies, ["cluster", "salt"], "left").drop("salt")


def _band_places(members: DataFrame, bands: DataFrame) -> DataFrame:
    """For each band the blocks that have nodes of it, and the range of their sizes."""
    return (
        members.select("node", "cluster", "block", "n_shingles")
        .join(bands, "node")
        .select("cluster", "block", "n_shingles", F.explode("bands").alias("band"))
        .groupBy("band", "cluster", "block")
        .agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    )


def _visits(
    members: DataFrame, guests: DataFrame, bands: DataFrame, places: DataFrame, percent: int
) -> DataFrame:
    """Links of the roots of guests with those of other blocks, in chunks of guests. A
    guest visits at least the blocks that have a node of a linkable size in one of its
    bands."""
    keys = ["cluster", "block"]
    fits = (F.col("n_shingles") * 100 >= F.col("low") * percent) & (
        F.col("high") * 100 >= F.col("n_shingles") * percent
    )
    asking = guests.select("node", "cluster", "n_shingles", "blocks", F.col("block").alias("home"))
    asked = asking.join(bands, "node").select("node", "blocks", F.explode("bands").alias("band"))
    # A guest whose bands have more places than its cluster has blocks goes to every
    # block, so that at most one row for each block is made.
    reach = places.groupBy("band").agg(F.count(F.lit(1)).alias("reach"))
    wide = asked.join(reach, "band").groupBy("node").agg(
        (F.sum("reach") >= F.first("blocks")).alias("wide")
    )
    asking = stored(asking.join(wide, "node"), "asking")
    ranges = places.groupBy(*keys).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    everywhere = (
        asking.filter("wide")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .join(ranges, keys)
    )
    somewhere = (
        asking.filter(~F.col("wide"))
        .drop("cluster")
        .join(bands, "node")
        .withColumn("band", F.explode("bands"))
        .join(places, "band")
    )
    calls = everywhere.select("node", "n_shingles", "home", *keys, "low", "high").unionByName(
        somewhere.select("node", "n_shingles", "home", *keys, "low", "high")
    )
    calls = calls.filter(fits & (F.col("block") != F.col("home")))
    calls = stored(calls.select("node", *keys).distinct(), "calls")
    chunks = calls.groupBy(*keys).agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("chunks")
    )
    own = members.join(chunks, keys).select(
        *keys, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        "node", "root", "shingles", F.lit(False).alias("visitor"),
    )
    chunk = F.pmod(F.xxhash64("node", F.lit(5)), F.col("chunks")).cast("int")
    visiting = (
        calls.join(chunks, keys)
        .join(guests.select("node", "root", "shingles"), "node")
        .select(
            *keys, chunk.alias("chunk"), "node", "root", "shingles", F.lit(True).alias("visitor")
        )
    )
    keys = [*keys, "chunk"]
    dealt = own.unionByName(visiting).repartition(*keys)
    dealt = dealt.sortWithinPartitions(*keys, "visitor", "node")
    links = dealt.mapInArrow(partial(_cross_links, percent=percent), "u binary, v binary")
    return stored(links, "visits")


def _hooked(links: DataFrame) -> DataFrame:
    """``(root, label)``: the least root it is linked with, or that one's. Roots with
    one label are in one component; the reverse need not hold."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    first = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("v"))
    second = first.select(F.col("u").alias("v"), F.col("v").alias("top"))
    return first.join(second, "v", "left").select(
        F.col("u").alias("root"), F.coalesce("top", "v").alias("label")
    )


def _joined_clusters(sets: DataFrame, bands: DataFrame, percent: int) -> DataFrame:
    """``(node, root)`` over candidate clusters: ``cluster, node, n_shingles, block,
    blocks, shingles`` in, compared block by block."""
    keys = ["cluster", "block"]
    dealt = sets.repartition(*keys).sortWithinPartitions(*keys, "node")
    inside = stored(
        dealt.mapInArrow(
            partial(_block_links, percent=percent),
            "cluster binary, block int, u binary, v binary, degree long",
        ),
        "inside",
    )
    rooted = inside.select(F.col("u").alias("node"), F.col("v").alias("root"))
    large = sets.filter(F.col("blocks") > 1)
    if large.isEmpty():
        return rooted
    known = stored(large.join(rooted, "node"), "known")
    places = stored(_band_places(known.dropDuplicates(["node"]), bands), "places")
    best = F.max_by("u", F.struct("degree", "u")).alias("node")
    leaders = inside.filter(F.col("block") < LEADERS).groupBy(*keys).agg(best)
    guests = known.join(leaders.select("node"), "node", "left_semi")
    links = _visits(known, guests, bands, places, percent)
    labelled = known.join(_hooked(links), "root", "left")
    labelled = labelled.withColumn("label", F.coalesce("label", "root"))
    sizes = labelled.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("cluster").agg(
        F.max_by("label", F.struct("n", "label")).alias("largest")
    )
    apart = _with_cluster(labelled, largest).filter(F.col("label") != F.col("largest"))
    apart = stored(apart.select(*known.columns), "apart")
    links = links.unionByName(_visits(known, apart, bands, places, percent))
    tops = components(sets.sparkSession, links)
    tops = tops.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return rooted.join(tops, "root", "left").select(
        "node", F.coalesce("top", "root").alias("root")
    )


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = 5,
    percent: int = 80,
) -> DataFrame:
    """One row per document: its id, ``n_shingles``, ``component_id`` (the least id
    of its group) and ``kept`` (it is that id).

    Null and empty texts, and texts of white space, have an empty set and are
    linked with nothing. A very long text is one set, taken whole. Rows with a null id are never linked, have a null group
    and are kept. Repeated rows share an id, so both are kept or neither is; rows
    with one id and different texts are linked only if their texts are. Only the
    two named columns are read, so clashing names of others do no harm."""
    spark = docs.sparkSession
    rows, bands = bands_for(percent)
    # A smaller set cannot differ from another by one shingle and be linked.
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 60
    given = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    signed = stored(
        given.mapInArrow(
            partial(_sign, shingle=shingle, rows=rows, bands=bands, least=least),
            f"id {kind}, n_shingles long, node binary, bands array<long>",
        ),
        "signed",
    )
    nodes = stored(
        signed.filter((F.col("n_shingles") > 0) & F.col("id").isNotNull())
        .groupBy("node")
        .agg(
            F.min("id").alias("id"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"),
        ),
        "nodes",
    )
    banded = nodes.select("node", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(
        F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")
    )
    hubs = hubs.filter(F.col("n") > 1).select("band", "hub")
    stars = banded.join(hubs, "band").filter(F.col("node") != F.col("hub"))
    stars = stars.select(F.col("node").alias("u"), F.col("hub").alias("v"))
    clusters = components(spark, stars).withColumnRenamed("root", "cluster")
    members = clusters.join(nodes.select("node", "id", "n_shingles"), "node")
    sizes = members.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("weight")
    )
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("weight") / BLOCK_SHINGLES))
    # Blocks of a cut cluster are half full on the mean, as hashing is uneven.
    large = sizes.select("cluster", (blocks * 2).cast("int").alias("blocks")).filter("blocks > 2")
    members = stored(
        _with_cluster(members, large)
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .select("cluster", "node", "id", "n_shingles", "blocks", "block"),
        "members",
    )
    wanted = F.broadcast(members) if members.count() <= BROADCAST_NODES else members
    columns = ["cluster", "node", "n_shingles", "blocks", "block"]
    sets = (
        given.join(wanted, "id")
        .select(*columns, "text")
        .mapInArrow(
            partial(_sets, shingle=shingle),
            "cluster binary, node binary, n_shingles long, blocks int, block int, shingles binary",
        )
    )
    roots = _joined_clusters(stored(sets, "sets"), nodes.select("node", "bands"), percent)
    named = nodes.select("node", "id").join(roots, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    groups = named.groupBy("root").agg(F.min("id").alias("component_id"))
    named = stored(named.join(groups, "root").select("node", "component_id"), "named")
    return (
        signed.select("id", "n_shingles", "node")
        .join(named, "node", "left")
        .select(
            F.col("id").alias(id_column),
            "n_shingles",
            F.when(F.col("id").isNull(), F.lit(None))
            .otherwise(F.coalesce("component_id", "id"))
            .alias("component_id"),
            F.when(F.col("id").isNull(), F.lit(True))
            .otherwise(F.coalesce("component_id", "id") == F.col("id"))
            .alias("kept"),
        )
    )
