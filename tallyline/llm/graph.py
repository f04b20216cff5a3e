"""Connected components of links that may form very large stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.session import scratch_path


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write a table into the shared folder and read it again: later steps start
    from it, also when an executor is lost."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(spark: SparkSession, links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node that has a link ``(u, v)``; the root is the
    least node of its component.

    Ends when every node has one neighbour, which has no smaller one. Until then it
    alternates two steps that hand each node's neighbours to its least neighbour
    (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014). A
    node's least neighbour is an aggregate, combined before the shuffle; a node
    with very many neighbours is a skewed join key, which Spark splits."""
    edges = stored(
        links.filter(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "links",
    )
    for _ in range(max_rounds):
        # Larger neighbours of a node go to the least of its neighbours.
        least = edges.groupBy("u").agg(F.min("v").alias("low"))
        large = edges.join(least.withColumnRenamed("u", "v"), "v", "left").select(
            "u", F.coalesce("low", "v").alias("v"), F.col("low").isNotNull().alias("moved")
        )
        large = stored(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"))
        if large.filter("moved").isEmpty() and least.filter("low < high").isEmpty():
            break
        # The node itself and its smaller neighbours go to the least of them.
        moved = large.join(least, "u").filter(F.col("v") != F.col("low"))
        small = (
            moved.select(F.col("v").alias("u"), F.col("low").alias("v"))
            .unionByName(least.select("u", F.col("low").alias("v")))
            .distinct()
        )
        edges = stored(small, "small")
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
