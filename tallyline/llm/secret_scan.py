"""Secrets in texts: fixed patterns, and a linear-chain conditional random field.

The patterns give the base spans. The field adds what they miss: each token of a
line is the begin of a secret, inside one, or outside, judged by its shape (length,
kinds of characters, how often they change), its neighbours, and how much of the
whole text looks random; the best tagging of a line is found by Viterbi's
algorithm. The field is trained on lines of a bounded sample of documents, where
the base spans' values serve as tags.

A line none of whose tokens can gain by leaving "outside", whatever its
neighbours, is outside as a whole; only the others go through the algorithm.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.llm.arrow_text import SPACES, flat_bytes, pieces, span_hashes
from tallyline.llm.graph import stored

# Kinds of base spans and their patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "crf")

SAMPLE_DOCUMENTS = 8000  # documents that training lines come from, at most
TRAINING_TOKENS = 40  # tokens of a training line, at most; around the secret if it has one
EPOCHS = 60
LEAST_CHARACTERS = 8  # of a span that the field adds
MASK = "[SECRET]"

_HASHES = 4096
_SHAPES = 32 * 12 * 6
_PARTS = np.array([_SHAPES, 128, _HASHES, _HASHES, _HASHES, 8 * 12])
_OFFSETS = np.cumsum(_PARTS) - _PARTS
FEATURES = int(_PARTS.sum())
OUT, BEGIN, IN = range(3)
NEVER = -1e4

_KIND = np.full(256, 2, np.uint8)  # 0 white space, 1 part of a word, 2 a token by itself
_KIND[list(SPACES)] = 0
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/.-")] = 1
_KIND[128:] = 1
_CLASS = np.full(256, 3, np.uint8)  # upper, lower, digit, symbol, beyond ASCII
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 4


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns, in code points, ordered by start and kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def secret_values(text: str) -> list[tuple[int, int]]:
    """The secrets themselves within the base spans."""
    found = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    return found + [(a, b) for kind, a, b in base_spans(text) if kind != "assign"]


class Tokens:
    """Tokens of some texts, their lines and their features."""

    def __init__(self, texts: pa.Array):
        data, borders = flat_bytes(texts)
        n = len(data)
        kind = _KIND[data]
        begins = np.ones(n, bool)
        begins[1:] = (kind[1:] != 1) | (kind[:-1] != 1)
        inner = borders[(borders < n)]
        begins[inner] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], n)
        real = kind[starts] > 0
        self.start, self.end = starts[real], ends[real]
        self.data, self.borders = data, borders
        lines = np.zeros(n + 1, np.int64)
        np.cumsum(data == ord("\n"), out=lines[1:])
        self.text = np.searchsorted(borders, self.start, "right") - 1
        number = lines[self.start] + self.text
        count = len(self.start)
        fresh = np.ones(count, bool)
        if count:
            fresh[1:] = (number[1:] != number[:-1]) | (self.text[1:] != self.text[:-1])
        self.line = np.flatnonzero(fresh)
        self.line_end = np.append(self.line[1:], count)[: len(self.line)]
        self._measure(fresh)

    def _measure(self, fresh: np.ndarray) -> None:
        data, start, end = self.data, self.start, self.end
        classes = _CLASS[data]
        size = end - start
        mask = np.zeros(len(start), np.int64)
        for c in range(5):
            sums = np.concatenate([[0], np.cumsum(classes == c)])
            mask |= (sums[end] > sums[start]).astype(np.int64) << c
        change = np.zeros(len(data) + 1, np.int64)
        if len(data):
            np.cumsum(classes[1:] != classes[:-1], out=change[2:])
        turns = change[end] - change[np.minimum(start + 1, end)]
        length = np.searchsorted([2, 3, 4, 6, 8, 12, 16, 20, 32, 40, 64], size, "right")
        turn = np.searchsorted([1, 2, 3, 5, 9], turns, "right")
        # Of the whole text: how many of its tokens look random.
        odd = (size >= 8) & (turns >= 3)
        counts = np.bincount(self.text, minlength=len(self.borders))
        share = np.bincount(self.text, odd, len(self.borders)) / np.maximum(counts, 1)
        file = np.searchsorted([1e-9, 0.002, 0.005, 0.01, 0.02, 0.05, 0.2], share, "right")
        hashes = (span_hashes(data, start, end) % np.uint64(_HASHES)).astype(np.int64)
        first = np.where(data[start] < 128, data[start], 0) if len(start) else size
        last = np.ones(len(start), bool)
        last[:-1] = fresh[1:]

        def moved(values, steps):
            out = np.zeros_like(values)
            if steps > 0:
                out[steps:] = values[:-steps]
            else:
                out[:steps] = values[-steps:]
            return out

        one = np.where(fresh, 0, moved(hashes, 1))
        two = np.where(fresh, 0, moved(one, 1))
        after = np.where(last, 0, moved(hashes, -1))
        columns = [
            (mask * 12 + length) * 6 + turn,
            np.where(size == 1, first, 0),
            one,
            two,
            after,
            file[self.text] * 12 + length,
        ]
        self.features = np.stack(columns, axis=1) + _OFFSETS if len(start) else np.zeros((0, 6), int)

    def characters(self, places: np.ndarray) -> np.ndarray:
        """Code points before byte places, counted from the first text's start."""
        return np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])[places]


def viterbi(scores: np.ndarray, sizes: np.ndarray, model: dict) -> np.ndarray:
    """Best tags of many lines at once; ``scores`` has their tokens line by line."""
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    back = np.zeros((len(scores), 3), np.int8)
    best = model["start"] + scores[starts]
    longest = int(sizes[0]) if len(sizes) else 0
    final = np.zeros((len(sizes), 3))
    for step in range(1, longest + 1):
        live = int(np.searchsorted(-sizes, -step, "left"))  # lines longer than step
        final[live : len(best)] = best[live:]
        if not live:
            break
        ways = best[:live, :, None] + model["moves"]
        at = starts[:live] + step
        back[at] = ways.argmax(axis=1)
        best = ways.max(axis=1) + scores[at]
    tags = np.zeros(len(scores), np.int8)
    tag = final.argmax(axis=1)
    for step in range(longest - 1, -1, -1):
        live = int(np.searchsorted(-sizes, -step, "left"))
        at = starts[:live] + step
        tags[at] = tag[:live]
        tag[:live] = back[at, tag[:live]]
    return tags


def tag_tokens(tokens: Tokens, model: dict) -> np.ndarray:
    """The best tag of every token."""
    tags = np.zeros(len(tokens.start), np.int8)
    if not len(tags):
        return tags
    scores = model["weights"][tokens.features[:, 0]].copy()
    for column in range(1, tokens.features.shape[1]):
        scores += model["weights"][tokens.features[:, column]]
    # What a token can gain at most by not being outside, moves included.
    moves = model["moves"] - model["moves"][OUT, OUT]
    bonus = max(0.0, float(moves.max()), float((model["start"] - model["start"][OUT]).max()))
    gain = scores[:, 1:].max(axis=1) - scores[:, OUT] + 2 * bonus
    open_lines = np.flatnonzero(np.maximum.reduceat(gain, tokens.line) > 0)
    if not len(open_lines):
        return tags
    sizes = (tokens.line_end - tokens.line)[open_lines]
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.repeat(tokens.line[open_lines], sizes) + within
    tags[at] = viterbi(scores[at], sizes, model)
    return tags


def _log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(values - top).sum(axis=axis))


def train(lines: list[tuple[np.ndarray, np.ndarray]]) -> dict:
    """Weights by maximum likelihood, with AdaGrad steps on all lines at once;
    ``lines`` are ``(features, tags)``. Every line is learned a second time without
    its neighbouring words, so that shapes are not left to the words that the base
    patterns name."""
    blind = []
    for features, tags in lines:
        features = features.copy()
        features[:, 2:5] = _OFFSETS[2:5]
        blind.append((features, tags))
    lines = lines + blind
    n, width = len(lines), max(len(t) for _, t in lines)
    features = np.zeros((n, width, len(_PARTS)), np.int64)
    tags = np.zeros((n, width), np.int64)
    there = np.zeros((n, width), bool)
    for i, (f, t) in enumerate(lines):
        features[i, : len(t)], tags[i, : len(t)], there[i, : len(t)] = f, t, True
    weights, moves, start = np.zeros((FEATURES, 3)), np.zeros((3, 3)), np.zeros(3)
    moves[OUT, IN] = start[IN] = NEVER
    squares = [np.full_like(w, 1e-8) for w in (weights, moves, start)]
    gold = np.eye(3)[tags] * there[..., None]
    gold_moves = np.einsum("nia,nib->ab", gold[:, :-1], gold[:, 1:])
    both = there[:, 1:, None]
    for _ in range(EPOCHS):
        scores = weights[features].sum(axis=2)
        forward, backward = np.zeros_like(scores), np.zeros_like(scores)
        forward[:, 0] = start + scores[:, 0]
        for i in range(1, width):
            forward[:, i] = scores[:, i] + _log_sum(forward[:, i - 1, :, None] + moves, 1)
            forward[:, i] = np.where(there[:, i, None], forward[:, i], forward[:, i - 1])
        total = _log_sum(forward[:, -1], 1)
        for i in range(width - 2, -1, -1):
            after = (scores[:, i + 1] + backward[:, i + 1])[:, None, :] + moves
            backward[:, i] = np.where(there[:, i + 1, None], _log_sum(after, 2), 0)
        expected = np.exp(forward + backward - total[:, None, None]) * there[..., None]
        step = (
            forward[:, :-1, :, None]
            + moves
            + (scores[:, 1:] + backward[:, 1:])[:, :, None, :]
            - total[:, None, None, None]
        )
        expected_moves = (np.exp(np.minimum(step, 0)) * both[..., None]).sum(axis=(0, 1))
        error = (expected - gold)[there]
        slope = np.zeros_like(weights)
        for column in range(len(_PARTS)):
            own = features[..., column][there]
            for tag in range(3):
                slope[:, tag] += np.bincount(own, error[:, tag], FEATURES)
        slopes = [
            slope / n + 1e-5 * weights,
            (expected_moves - gold_moves) / n,
            (expected[:, 0] - gold[:, 0]).sum(axis=0) / n,
        ]
        for values, squared, s in zip((weights, moves, start), squares, slopes):
            squared += s**2
            values -= 0.2 * s / np.sqrt(squared)
        moves[OUT, IN] = start[IN] = NEVER
    return {"weights": weights, "moves": moves, "start": start}


def _training_lines(batches):
    for batch in batches:
        for part in pieces(batch, "text"):
            tokens = Tokens(part.column("text"))
            tags = np.zeros(len(tokens.start), np.int8)
            texts = part.column("text").to_pylist()
            firsts = tokens.characters(tokens.borders)
            chars = tokens.characters(tokens.start)
            for i, text in enumerate(texts):
                for a, b in secret_values(text or ""):
                    low, high = np.searchsorted(chars, (firsts[i] + a, firsts[i] + b))
                    tags[low:high] = IN
                    tags[low : low + (high > low)] = BEGIN
            text = tokens.text[tokens.line] if len(tokens.line) else tokens.line
            has = np.array([tags[a:b].any() for a, b in zip(tokens.line, tokens.line_end)], bool)
            # One line in some without a secret, whatever it looks like.
            plain = (tokens.line + tokens.start[tokens.line] if len(text) else text) % 16 == 0
            for line in np.flatnonzero(has | plain):
                a, b = int(tokens.line[line]), int(tokens.line_end[line])
                if b - a > TRAINING_TOKENS:
                    hit = a + int(tags[a:b].argmax())
                    a = max(a, hit - TRAINING_TOKENS // 2)
                    b = min(b, a + TRAINING_TOKENS)
                if tags[a] == IN:
                    tags[a] = BEGIN
                yield pa.RecordBatch.from_pydict(
                    {
                        "features": pa.array([tokens.features[a:b].ravel().astype(np.int32)]),
                        "tags": pa.array([tags[a:b].astype(np.int32)]),
                    }
                )


def fit(docs: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> dict | None:
    """A field trained on at most ``sample`` documents (``id, text``), those with the
    least hash of their id; None if no line there has a base span."""
    ids = docs.select("id").filter(F.col("id").isNotNull()).distinct()
    ids = stored(ids.orderBy(F.xxhash64("id", F.lit(17)), "id").limit(sample), "sample")
    picked = docs.join(F.broadcast(ids), "id").select("text")
    rows = picked.mapInArrow(_training_lines, "features array<int>, tags array<int>").toArrow()
    lines = [
        (f.values.to_numpy().reshape(-1, len(_PARTS)), t.values.to_numpy())
        for f, t in zip(rows["features"], rows["tags"])
    ]
    if not any(t.any() for _, t in lines):
        return None
    lines.sort(key=lambda line: (not line[1].any(), line[0].tobytes()))
    secret = sum(1 for _, t in lines if t.any())
    return train(lines[: 4 * secret + 400])


def added_spans(tokens: Tokens, tags: np.ndarray, taken: list[list]) -> list[list]:
    """Spans of tagged tokens, by text, that touch no base span."""
    found = [[] for _ in taken]
    begins = np.flatnonzero(tags == BEGIN)
    if not len(begins):
        return found
    inside = np.append(tags != IN, True)
    stops = np.flatnonzero(inside)
    last = stops[np.searchsorted(stops, begins, "right")] - 1
    firsts = tokens.characters(tokens.borders)
    text = tokens.text[begins]
    starts = tokens.characters(tokens.start[begins]) - firsts[text]
    ends = tokens.characters(tokens.end[last]) - firsts[text]
    for i, a, b in zip(text.tolist(), starts.tolist(), ends.tolist()):
        if b - a >= LEAST_CHARACTERS and all(b <= s or e <= a for _, s, e in taken[i]):
            found[i].append(("crf", a, b))
    return found


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced; overlapping spans are one."""
    parts, at = [], 0
    for _, a, b in spans:
        if a >= at:
            parts += [text[at:a], MASK]
        at = max(at, b)
    return "".join(parts) + text[at:]


def _joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def secret_scan(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: tuple[str, ...] = (),
    redact: bool = False,
) -> DataFrame:
    """One row per document: its id and the ``keep`` columns, ``n_assign``,
    ``n_access``, ``n_hex``, ``base_sha256`` (of the base spans as
    ``kind:start:end``, comma-joined), ``spans`` (all spans, likewise) and, if told
    so, ``redacted`` (the text with every span replaced).

    Spans are whole matches in code points, end exclusive. Null and empty texts have
    no spans; a null text is redacted to null. Rows are scanned one by one, also with
    a repeated or null id; the field is trained on rows with an id. Without a base
    span in the sample nothing is added. Columns not named are not read, so clashing
    names of others do no harm."""
    given = docs.select(
        F.col(id_column).alias("id"),
        F.col(text_column).alias("text"),
        *(F.col(name).alias(f"_keep{i}") for i, name in enumerate(keep)),
    )
    shared = docs.sparkSession.sparkContext.broadcast(fit(given.select("id", "text")))

    def scan(batches):
        model = shared.value
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = part.column("text").to_pylist()
                base = [base_spans(text) if text else [] for text in texts]
                spans = base
                if model is not None:
                    tokens = Tokens(part.column("text"))
                    more = added_spans(tokens, tag_tokens(tokens, model), base)
                    spans = [sorted(b + m, key=lambda s: s[1]) for b, m in zip(base, more)]
                columns = [part.column("id")]
                columns += [part.column(f"_keep{i}") for i in range(len(keep))]
                for kind in KINDS[:3]:
                    counts = [sum(s[0] == kind for s in found) for found in base]
                    columns.append(pa.array(counts, pa.int64()))
                hashes = [hashlib.sha256(_joined(found).encode()).hexdigest() for found in base]
                columns.append(pa.array(hashes, pa.string()))
                columns.append(pa.array([_joined(found) for found in spans], pa.string()))
                if redact:
                    clean = [t if not s else masked(t, s) for t, s in zip(texts, spans)]
                    columns.append(pa.array(clean, pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    schema = T.StructType(
        [given.schema["id"], *(given.schema[f"_keep{i}"] for i in range(len(keep)))]
    )
    for name in ("n_assign", "n_access", "n_hex"):
        schema = schema.add(name, "long")
    schema = schema.add("base_sha256", "string").add("spans", "string")
    if redact:
        schema = schema.add("redacted", "string")
    names = {"id": id_column, **{f"_keep{i}": name for i, name in enumerate(keep)}}
    return given.mapInArrow(scan, schema).withColumnsRenamed(names)
