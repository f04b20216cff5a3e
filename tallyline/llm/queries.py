"""The registered queries: each operator over its whole table, and their oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import (
    bpe,
    byte_bpe,
    decontaminate,
    fill_middle,
    filter_audit,
    minhash,
    quality,
    secret_scan,
    sharding,
    substring_dedup,
    token_counts,
    top_k,
    toxicity,
)

SHARDS = 40
NEIGHBOURS = 20
SCALE = 64


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_balanced_label_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards whose row counts differ by one at most."""
    placed = sharding.balanced_shards(_table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_impact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of every vector whose id is divisible by 20."""
    vectors = _table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), top_k.quantised(F.col("embedding"), SCALE).alias("vector")
    )
    return top_k.exact_top_k(vectors, F.col("id") % 20 == 0, NEIGHBOURS)


def op3_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in benchmark items, by windows of 10 words."""
    found = decontaminate.contamination(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10
    )
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), "contaminated",
    )


def op4_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the sentences of passages that stood before."""
    return substring_dedup.without_repeats(_table(spark, sf_dir, "documents"))


def op5_superminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by 3-word shingles at a similarity of 0.85."""
    documents = _table(spark, sf_dir, "documents")
    return minhash.near_duplicates(documents, shingle=3, percent=85)


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded with the word vocabulary, and decoded."""
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe.encode(_table(spark, sf_dir, "documents"), path)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of the toxic label for every document."""
    tables = (_table(spark, sf_dir, name) for name in ("documents", "labels"))
    return toxicity.toxicity(*tables)


def op8_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades 0 (low quality), 1 (good but toxic) and 2 (good) of every document;
    selected if a grade of 1 or more is likely. Rows that the toxicity query holds
    out are not learned here either."""
    labels = _table(spark, sf_dir, "labels").filter(~toxicity.held_out_rows())
    grade = F.col("quality") * (2 - F.coalesce("toxic", F.lit(0)))
    ratings = labels.select("doc_id", grade.cast("int").alias("grade"))
    graded = quality.quality(_table(spark, sf_dir, "documents"), ratings, grades=3)
    return graded.select("*", toxicity.held_out_rows().alias("held_out"))


def op9_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, from one encoding of each."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_counts.section_token_counts(_table(spark, sf_dir, "documents"), path, "most")


def op10_crf_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: fixed patterns and what the field adds."""
    return secret_scan.secret_scan(_table(spark, sf_dir, "documents"))


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in every order: what each step removes of every source."""
    filters = {
        "A": filter_audit.under_words(200),
        "B": filter_audit.repeats_words(50),
        "C": filter_audit.many_capitals(2),
        "D": filter_audit.matches("[#$%&*|]"),
        "E": None,
    }
    documents, labels = (_table(spark, sf_dir, name) for name in ("documents", "labels"))
    return filter_audit.audit(documents, labels, filters)


def op12_distinct_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded with the byte-level vocabulary, and decoded."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    outputs = ("n_tokens", "ids_sha256", "decoded_sha256")
    documents = _table(spark, sf_dir, "documents")
    return byte_bpe.encode(documents, path, public_tokenizers.PATTERN, outputs=outputs)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut at two line borders, and put together again."""
    made = fill_middle.transform(_table(spark, sf_dir, "documents"), seed=7)
    plain = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(plain, 256).alias("restored_sha256"),
    )


QUERIES = {
    query.__name__: query
    for query in (
        op1_balanced_label_shards,
        op2_impact_top_k,
        op3_winnowing_decontamination,
        op4_sentence_span_dedup,
        op5_superminhash_near_dedup,
        op6_bpe_round_trip,
        op7_kneser_ney_toxicity,
        op8_ordinal_quality,
        op9_section_tokens,
        op10_crf_secret_scan,
        op11_filter_interactions,
        op12_distinct_word_bpe,
        op13_fill_middle,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = (
    "regexp_extract_all(coalesce(" + _LOWER + ", ''), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

_TOP_K = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x
    FROM embeddings
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           list_inner_product(q.x, c.x)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

_WINNOWING = f"""
WITH d AS (SELECT doc_id, {_ALNUM.format("text")} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n,
           unnest(list_transform(range(1, greatest(len(w) - 10, 0) + 2),
                                 lambda i: array_to_string(w[i:i + 9], ' '))) AS content
    FROM b WHERE len(w) > 0
),
lengths AS (SELECT DISTINCT n FROM windows),
spans AS (
    SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2),
        lambda i: {{'place': i, 'content': array_to_string(w[i:i + n - 1], ' ')}})) AS s
    FROM d CROSS JOIN lengths WHERE len(w) >= n
),
hits AS (
    SELECT s.doc_id, s.s.place AS place, s.n, x.item_id
    FROM spans s JOIN windows x ON x.content = s.s.content AND x.n = s.n
),
words AS (
    SELECT doc_id, count(DISTINCT word) AS n_hit
    FROM (SELECT DISTINCT doc_id, unnest(range(place, place + n)) AS word FROM hits) GROUP BY doc_id
),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_NEAR = rf"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(coalesce({_LOWER.format("text")}, ''),
                                      '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
shingles AS (
    SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 0) + 2),
                                   lambda i: array_to_string(w[i:i + 2], ' '))) AS s
    FROM d WHERE len(w) > 0
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
),
links AS (
    SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v
    WHERE 100 * k >= 85 * (x.n + y.n - k)
),
reached AS (
    SELECT doc_id, doc_id AS other FROM d
    UNION
    SELECT r.doc_id, l.v FROM reached r JOIN links l ON l.u = r.other
),
groups AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id,
       doc_id = component_id AS kept
FROM groups LEFT JOIN sizes USING (doc_id)
"""

_AUDIT = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
low AS (SELECT t, min(doc_id) AS low FROM d GROUP BY t),
marks AS (
    SELECT doc_id, part,
           (len(w) < 200)::INT
           + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
           + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t))::INT
           + 8 * regexp_matches(t, '[#$%&*|]')::INT
           + 16 * coalesce(low < doc_id, false)::INT AS bits
    FROM d JOIN low USING (t)
),
known AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic
    FROM labels GROUP BY doc_id
),
combos AS (
    SELECT part, bits, count(*) AS n, count(*) FILTER (WHERE good) AS good,
           count(*) FILTER (WHERE toxic) AS toxic
    FROM marks LEFT JOIN known USING (doc_id) GROUP BY part, bits
),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
steps AS (
    SELECT p.f || q.f || r.f || s.f || t.f AS filter_order,
           unnest([1, 2, 3, 4, 5]) AS step, unnest([p.b, q.b, r.b, s.b, t.b]) AS own,
           unnest([0, p.b, p.b + q.b, p.b + q.b + r.b, p.b + q.b + r.b + s.b]) AS gone
    FROM f p JOIN f q ON q.f <> p.f JOIN f r ON r.f NOT IN (p.f, q.f)
    JOIN f s ON s.f NOT IN (p.f, q.f, r.f) JOIN f t ON t.f NOT IN (p.f, q.f, r.f, s.f)
),
figures AS (
    SELECT part, filter_order, step, own,
           coalesce(sum(n) FILTER (WHERE bits & (own | gone) = 0), 0)::BIGINT AS kept,
           coalesce(sum(n) FILTER (WHERE bits & gone = 0 AND bits & own <> 0), 0)::BIGINT AS removed,
           coalesce(sum(n) FILTER (WHERE bits & gone <> 0 AND bits & own <> 0), 0)::BIGINT
               AS redundant,
           coalesce(sum(n) FILTER (WHERE bits = own), 0)::BIGINT AS unique_fails,
           coalesce(sum(good) FILTER (WHERE bits & gone = 0 AND bits & own <> 0), 0)::BIGINT
               AS good_lost,
           coalesce(sum(toxic) FILTER (WHERE bits & gone = 0 AND bits & own <> 0), 0)::BIGINT
               AS toxic_lost
    FROM combos CROSS JOIN steps GROUP BY ALL
),
over_orders AS (SELECT part, own, sum(removed)::BIGINT AS shapley FROM figures GROUP BY part, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       shapley
FROM figures JOIN over_orders USING (part, own)
"""

_MIDDLE = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
           sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
    FROM documents
),
drawn AS (
    SELECT *, len(lines)::BIGINT AS n,
           list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS x
    FROM d
),
cut AS (
    SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a,
           greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                     OR x[3] % 100 >= 100 THEN 'plain'
                WHEN x[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
),
parts AS (
    SELECT *, coalesce(array_to_string(lines[1:a], ''), '') AS p,
           coalesce(array_to_string(lines[a + 1:b], ''), '') AS m,
           coalesce(array_to_string(lines[b + 1:], ''), '') AS s
    FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                   ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""

ORACLES = {
    "op11_filter_interactions": _AUDIT,
    "op13_fill_middle": _MIDDLE,
    "op2_impact_top_k": _TOP_K,
    "op3_winnowing_decontamination": _WINNOWING,
    "op5_superminhash_near_dedup": _NEAR,
}
