"""From raw documents to token ids: toxicity, near duplicates, benchmark passages,
secrets, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and gives a table; all but the last give
the columns of ``docs``, whatever they are called. Stages are written as Parquet
and read again, so a lost executor repeats at most one stage. Null texts pass
through all stages as texts without content; an empty table stays one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import bpe, decontaminate, minhash, secret_scan, toxicity
from tallyline.llm.graph import stored

BROADCAST_ROWS = 500_000  # most ids or text digests (up to 40 bytes each) sent to all


def _without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among those gone; a null key is never gone."""
    gone = stored(gone.select(key).distinct(), "gone")
    few = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, key, "left_anti")


def _plain(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """Numbered column names, which cannot clash, and those of the named columns."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain, [f"c{docs.columns.index(name)}" for name in names]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose predicted label is toxic. Rows are judged one by one
    by their text; labels come from the table of that name."""
    plain, (doc_id, text) = _plain(docs, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels = labels.select(F.col("doc_id").alias(doc_id), "toxic")
    scored = toxicity.toxicity(
        plain, labels, id_column=doc_id, text_column=text, keep=tuple(plain.columns)
    )
    # The first column is the id by itself, before the kept ones.
    scored = scored.toDF("_id", *plain.columns, "_held_out", "_score", "_predicted")
    return scored.filter("_predicted = 0").select(*plain.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group (five-word shingles, similarity 0.8): that with the
    least id, and of several rows with it the least text digest. Rows are told apart
    by a number of their own, so rows that share only an id stay. Documents without
    words or with a null id stay."""
    plain, (doc_id, text) = _plain(docs, "doc_id", "text")
    keyed = stored(plain.withColumn("row", F.monotonically_increasing_id()), "rows")
    named = keyed.filter(F.col(doc_id).isNotNull())
    found = minhash.near_duplicates(named, "row", text, shingle=5, percent=80)
    groups = found.filter(F.col("n_shingles") > 0).select("row", "component_id")
    order = F.struct(F.col(doc_id).alias("id"), F.unhex(F.md5(text)).alias("digest"), "row")
    members = groups.join(named.select("row", order.alias("place")), "row")
    members = stored(members, "members")
    first = members.groupBy("component_id").agg(F.min("place")["row"].alias("row"))
    gone = members.join(first, "row", "left_anti")
    return _without(keyed, gone, "row").select(*plain.columns).toDF(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold ten consecutive words of a benchmark item, or the
    whole of a shorter one. The text alone decides, so rows are told apart by it."""
    plain, (text,) = _plain(docs, "text")
    keyed = plain.withColumn("key", F.unhex(F.md5(text)))
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(keyed, benchmark, id_column="key", text_column=text)
    kept = _without(keyed, found.filter("contaminated"), "key")
    return kept.select(*plain.columns).toDF(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in the text, and ``n_chars`` (where there
    is such a column) counted anew."""
    plain, (doc_id, text) = _plain(docs, "doc_id", "text")
    others = tuple(name for name in plain.columns if name not in (doc_id, text))
    clean = secret_scan.secret_scan(plain, doc_id, text, keep=others, redact=True)
    clean = clean.withColumnRenamed("redacted", text)
    if "n_chars" in docs.columns:
        place = f"c{docs.columns.index('n_chars')}"
        kind = plain.schema[place].dataType
        counted = F.when(F.col(text).isNull(), F.col(place)).otherwise(F.length(text))
        clean = clean.withColumn(place, counted.cast(kind))
    return clean.select(*plain.columns).toDF(*docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of them and of the decoded text."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode(docs, path, keep=("doc_id",))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("encoding", encode_texts),
]

# The toxicity model and the field of the secret scan are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
