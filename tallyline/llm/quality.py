"""Quality grades by ordinal regression on hashed text.

Graded ratings 0, 1, ..., K - 1 are fitted by a cumulative-link model: one weight
for each hashed feature, shared by all grades, and K - 1 ascending thresholds. The
probability of a grade above k is ``logistic(x . w - threshold_k)``; the expected
grade is the sum of these, and one of them serves as tail probability for
selection.

Features of a text: its words (hashed), the shapes of its words (letter case,
digits, punctuation, length), pairs of shapes, and repeats of a word pair seen
before in the text, each as a share of the words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.arrow_text import GOLDEN, SPACES, Words, mix, pieces
from tallyline.llm.graph import stored

FEATURES = 1 << 16
SAMPLE_ROWS = 8000  # rated documents the model is fitted on, at most
EPOCHS = 150


def _shape(words: Words) -> np.ndarray:
    """A number for the look of each word."""
    data = words.data
    sums = {}
    for name, low, high in (("upper", 65, 90), ("lower", 97, 122), ("digit", 48, 57)):
        inside = (data >= low) & (data <= high)
        sums[name] = np.concatenate([[0], np.cumsum(inside)])
    size = words.end - words.start
    count = {n: s[words.end] - s[words.start] for n, s in sums.items()}
    other = size - sum(count.values())
    share = np.zeros(len(size), np.int64)
    for found in (count["upper"], count["lower"], count["digit"], other):
        share = share * 3 + (found > 0) + (found * 2 > size)
    last = data[words.end - 1].astype(np.int64) if len(size) else share
    last = np.where(last < 128, last, 128) * ~((last >= 97) & (last <= 122))
    return (share * 12 + np.minimum(size, 11)) * 129 + last


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, feature number and weight of every occurrence."""
    words = Words(texts, SPACES)
    shape = mix(_shape(words).astype(np.uint64) + np.uint64(1 << 40))
    n, text = len(words.hash), words.text
    same = np.zeros(n, bool)
    if n:
        same[1:] = text[1:] == text[:-1]
    pair = np.zeros(n, np.uint64)
    looks = np.zeros(n, np.uint64)
    pair[1:] = mix(words.hash[:-1] * GOLDEN + words.hash[1:])
    looks[1:] = mix(shape[:-1] * GOLDEN + shape[1:])
    at = np.flatnonzero(same)
    order = at[np.lexsort((at, pair[at], text[at]))]
    again = np.zeros(n, bool)
    if len(order):
        a, b = order[1:], order[:-1]
        again[a] = (text[a] == text[b]) & (pair[a] == pair[b])
    repeats = np.where(again, np.uint64(1), np.uint64(2))
    share = 1 / np.maximum(words.count, 1)[text]
    parts = [(text, words.hash), (text, shape), (text[at], looks[at]), (text, mix(repeats))]
    number = [(keys % np.uint64(FEATURES)).astype(np.int64) for _, keys in parts]
    weights = [share, share, share[at], share]
    return np.concatenate([t for t, _ in parts]), np.concatenate(number), np.concatenate(weights)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list, grades: int) -> dict:
    """Weights and thresholds by full-gradient Adam steps; ``rows`` are ``(grade,
    feature numbers, values)``. The likelihood of a grade is the difference of two
    neighbouring tail probabilities."""
    y = np.array([r[0] for r in rows])
    which = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    number = np.concatenate([r[1] for r in rows]).astype(np.int64)
    value = np.concatenate([r[2] for r in rows])
    # Thresholds as a first one and the logs of the steps between them.
    tails = np.array([(y > k).mean() for k in range(grades - 1)]).clip(1e-3, 1 - 1e-3)
    start = np.log((1 - tails) / tails)
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    params = np.concatenate([np.zeros(FEATURES), start[:1], gaps])
    first = second = np.zeros_like(params)
    for step in range(1, EPOCHS + 1):
        weights, low = params[:FEATURES], params[FEATURES]
        jumps = np.exp(params[FEATURES + 1 :])
        edges = np.concatenate([[-np.inf], low + np.concatenate([[0], np.cumsum(jumps)]), [np.inf]])
        z = np.bincount(which, value * weights[number], len(rows))
        upper, lower = _logistic(z - edges[y]), _logistic(z - edges[y + 1])
        p = np.maximum(upper - lower, 1e-9)
        d_upper, d_lower = upper * (1 - upper) / p, lower * (1 - lower) / p
        slope = (d_lower - d_upper) / len(rows)  # of the loss, by z
        gradient = np.zeros_like(params)
        gradient[:FEATURES] = np.bincount(number, value * slope[which], FEATURES)
        gradient[:FEATURES] += 1e-6 * weights
        by_edge = np.zeros(grades - 1)
        np.add.at(by_edge, y[y > 0] - 1, d_upper[y > 0] / len(rows))
        np.add.at(by_edge, y[y < grades - 1], -d_lower[y < grades - 1] / len(rows))
        gradient[FEATURES] = by_edge.sum()
        later = np.cumsum(by_edge[::-1])[::-1][1:]
        gradient[FEATURES + 1 :] = later * jumps
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        rate = 0.3 * first / (1 - 0.9**step)
        params = params - rate / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    edges = params[FEATURES] + np.concatenate([[0], np.cumsum(np.exp(params[FEATURES + 1 :]))])
    return {"weights": params[:FEATURES], "edges": edges}


def quality(
    docs: DataFrame,
    ratings: DataFrame,
    grades: int,
    tail: int = 1,
    threshold: float = 0.5,
    id_column: str = "doc_id",
    text_column: str = "text",
    grade_column: str = "grade",
) -> DataFrame:
    """One row per document: its id, ``expected_grade`` (0 to ``grades - 1``),
    ``tail_probabilities`` (of a grade of 1 or more, 2 or more, ...) and ``selected``
    (the probability of a grade of ``tail`` or more reaches the threshold).

    The model is fitted on at most ``SAMPLE_ROWS`` rated documents, those with the
    least hash of their id. An id with several ratings has the lowest; null ids and
    ratings, and ratings outside the scale, are passed over. Null and empty texts
    have no features, so the thresholds alone grade them. Without two different
    ratings the shares of the ratings serve as grade of every row. Rows are graded
    one by one, also with a repeated or null id. Only the named columns are read, so
    clashing names of others do no harm."""
    spark = docs.sparkSession
    given = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    rated = ratings.select(F.col(id_column).alias("id"), F.col(grade_column).alias("grade"))
    rated = rated.filter(F.col("id").isNotNull() & F.col("grade").between(0, grades - 1))
    rated = rated.groupBy("id").agg(F.min("grade").cast("int").alias("grade"))
    sample = stored(
        rated.orderBy(F.xxhash64("id", F.lit(13)), "id").limit(SAMPLE_ROWS), "rated"
    )

    def measure(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                text, number, weight = features(part.column("text"))
                grade = part.column("grade").to_pylist()
                keys, inverse = np.unique(text * FEATURES + number, return_inverse=True)
                value = np.bincount(inverse, weight, len(keys))
                ends = np.searchsorted(keys // FEATURES, np.arange(part.num_rows + 1))
                for i in range(part.num_rows):
                    own = slice(ends[i], ends[i + 1])
                    yield pa.RecordBatch.from_pydict(
                        {
                            "grade": pa.array([grade[i]], pa.int32()),
                            "number": pa.array([(keys[own] % FEATURES).astype(np.int32)]),
                            "value": pa.array([value[own].astype(np.float32)]),
                        }
                    )

    picked = given.join(F.broadcast(sample), "id").select("text", "grade")
    rows = picked.mapInArrow(measure, "grade int, number array<int>, value array<float>")
    # Bounded by the sample: a few hundred features for each of its documents.
    table = rows.toArrow()
    found = [
        (g.as_py(), n.values.to_numpy(), v.values.to_numpy())
        for g, n, v in zip(table["grade"], table["number"], table["value"])
    ]
    if len({r[0] for r in found}) < 2:
        share = np.array([np.mean([r[0] > k for r in found] or [0.5]) for k in range(grades - 1)])
        share = share.clip(1e-3, 1 - 1e-3)
        model = {"weights": np.zeros(FEATURES), "edges": np.log((1 - share) / share)}
    else:
        model = fit(found, grades)
    shared = spark.sparkContext.broadcast(model)

    def grade_texts(batches):
        weights, edges = shared.value["weights"], shared.value["edges"]
        for batch in batches:
            for part in pieces(batch, "text"):
                text, number, weight = features(part.column("text"))
                z = np.bincount(text, weight * weights[number], part.num_rows)
                tails = _logistic(z[:, None] - edges)
                borders = pa.array(np.arange(0, tails.size + 1, len(edges), dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array(tails.sum(axis=1)),
                        pa.ListArray.from_arrays(borders, pa.array(tails.ravel())),
                    ],
                    names=["id", "expected_grade", "tail_probabilities"],
                )

    kind = given.schema["id"].dataType.simpleString()
    graded = given.mapInArrow(
        grade_texts, f"id {kind}, expected_grade double, tail_probabilities array<double>"
    )
    return graded.select(
        F.col("id").alias(id_column),
        "expected_grade",
        "tail_probabilities",
        (F.get("tail_probabilities", F.lit(tail - 1)) >= threshold).alias("selected"),
    )
