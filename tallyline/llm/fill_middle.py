"""Fill-in-the-middle: cut texts at two unit borders and reorder the three parts.

Units are lines here. Over the units of a text stands an indexable skip list: the
bottom lane has a node per unit, and every lane above has a node for each run of
``FAN`` nodes below. A node carries two widths, the units and the code points it spans.
A rank is found from the top lane: while the units passed so far and the next
node's width stay within the rank, step over it; else go down a lane. The code
points passed on the way are the place of the cut, exactly. A rank takes at most
``FAN`` - 1 steps in each lane.

Lists of all texts of a piece stand in the same arrays, and all ranks descend
together. Lists never share nodes: each text's lane begins at its own offset.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.llm.arrow_text import flat_bytes, pieces

FAN = 8

# The marks before each part.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"


def _head(data: np.ndarray) -> np.ndarray:
    """Bytes that begin a code point."""
    return (data & 0xC0) != 0x80


def line_units(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every line of all texts, and the number of lines of each text.
    A line ends after its line feed, or with the text."""
    starts = np.zeros(len(data) + 1, bool)
    starts[1:] = data == ord("\n")
    starts[borders] = True  # also where an empty text stands: then once
    starts[len(data)] = False
    first = np.flatnonzero(starts)
    return first, np.diff(np.searchsorted(first, borders))


class SkipLists:
    """Lanes over the units of many texts. Lane k has for every text ceil(units /
    FAN^k) nodes; ``first[k][i]`` is the first of text i."""

    def __init__(self, points: np.ndarray, counts: np.ndarray):
        """``points``: code points of each unit; ``counts``: units of each text."""
        self.units, self.points, self.first, self.nodes = [], [], [], []
        units = np.ones(len(points), np.int64)
        while True:
            first = np.cumsum(counts) - counts
            self.units.append(units)
            self.points.append(points)
            self.first.append(first)
            self.nodes.append(counts)
            if not len(counts) or counts.max() <= 1:
                break
            above = -(-counts // FAN)
            text = np.repeat(np.arange(len(counts)), above)
            within = np.arange(len(text)) - np.repeat(np.cumsum(above) - above, above)
            runs = first[text] + within * FAN
            units = np.add.reduceat(units, runs)
            points = np.add.reduceat(points, runs)
            counts = above

    def descend(self, text: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Code points before unit ``rank`` of each ``text``."""
        passed, at = np.zeros_like(rank), np.zeros_like(rank)
        node = np.zeros_like(rank)  # place within the text's lane
        for lane in range(len(self.units) - 1, -1, -1):
            if not len(self.units[lane]):
                continue
            for _ in range(FAN):
                inside = node < self.nodes[lane][text]
                spot = np.minimum(self.first[lane][text] + node, len(self.units[lane]) - 1)
                step = inside & (passed + self.units[lane][spot] <= rank)
                if not step.any():
                    break
                passed += np.where(step, self.units[lane][spot], 0)
                at += np.where(step, self.points[lane][spot], 0)
                node += step
            node = node * FAN
        return at


def draws(ids: list, seed: int) -> np.ndarray:
    """Four numbers of 32 bits for each id. A null id draws like an empty one."""
    digests = [
        hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids
    ]
    return np.frombuffer(b"".join(digests), ">u4").reshape(-1, 4).astype(np.int64)


def byte_places(data: np.ndarray, borders: np.ndarray, text, points) -> np.ndarray:
    """Byte of a text at which a code point begins (or its end)."""
    heads = np.flatnonzero(_head(data))
    wanted = np.searchsorted(heads, borders[text]) + points
    return np.append(heads, len(data))[wanted]


def transform(
    docs: DataFrame,
    seed: int,
    rate: int = 100,
    spm_rate: int = 50,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """The ``keep`` columns of each row and ``n`` (lines), ``form``, ``prefix_chars``,
    ``middle_chars`` (code points, null if plain) and ``output``, the text as it is or
    its parts, each behind its mark.

    The hash of ``seed:id`` decides: two cuts between lines (ranks 0 to n), whether the
    text stays plain (beyond ``rate`` of 100), and the order of its parts. Empty texts
    and those that hold a mark stay plain. Null texts are empty. Rows that share an id
    draw alike, a null id draws as an empty one. Whole texts are cut, however long; a
    text is one value of a batch. Columns not named are not read, so clashing names do
    no harm; an empty table stays one."""
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    names = [f"_keep{i}" for i in range(len(keep))]

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "_text"):
                data, borders = flat_bytes(part.column("_text"))
                rows = part.num_rows
                first, counts = line_units(data, borders)
                heads = np.concatenate([[0], np.cumsum(_head(data))])
                ends = np.append(first[1:], len(data))
                lists = SkipLists((heads[ends] - heads[first]).astype(np.int64), counts)
                drawn = draws(part.column("_id").to_pylist(), seed)
                cuts = np.sort(drawn[:, :2] % (counts + 1)[:, None], axis=1)
                text = np.arange(rows)
                low, high = (lists.descend(text, cuts[:, i].copy()) for i in (0, 1))
                at = [byte_places(data, borders, text, points) for points in (low, high)]
                blob = data.tobytes()
                forms, outputs = [], []
                spans = zip(borders[:-1].tolist(), at[0].tolist(), at[1].tolist(), borders[1:].tolist())
                plain = drawn[:, 2] % 100 >= rate
                suffix_first = drawn[:, 3] % 100 < spm_rate
                for row, (a, b, c, d) in enumerate(spans):
                    whole = blob[a:d]
                    if plain[row] or not whole or any(m in whole for m in marks):
                        forms.append(PLAIN)
                        outputs.append(whole)
                        continue
                    prefix = marks[0] + blob[a:b]
                    suffix, middle = marks[1] + blob[c:d], marks[2] + blob[b:c]
                    spm = suffix_first[row]
                    forms.append(SPM if spm else PSM)
                    outputs.append((suffix + prefix if spm else prefix + suffix) + middle)
                cut = np.array([form != PLAIN for form in forms], bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(n) for n in names),
                        pa.array(counts.astype(np.int64)),
                        pa.array(forms, pa.string()),
                        pa.array(low, pa.int64(), mask=~cut),
                        pa.array(high - low, pa.int64(), mask=~cut),
                        pa.array(outputs, pa.binary()).cast(pa.string()),
                    ],
                    names=[*names, "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    given = docs.select(
        *(F.col(k).alias(n) for k, n in zip(keep, names)),
        F.col(id_column).cast("string").alias("_id"),
        F.col(text_column).alias("_text"),
    )
    schema = T.StructType([given.schema[n] for n in names])
    for name, kind in (
        ("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"),
        ("output", "string"),
    ):
        schema = schema.add(name, kind)
    return given.mapInArrow(run, schema).withColumnsRenamed(dict(zip(names, keep)))


def restored(output: Column, form: Column) -> Column:
    """The text before it was cut, from the output and its form alone. Parts hold no
    marks, so the first place of each mark is the one that was put there."""

    def between(begin: str, end: str | None) -> Column:
        rest = F.substring(output, F.locate(begin, output) + len(begin), F.length(output))
        if end is None:
            return rest
        return F.substring(rest, F.lit(1), F.locate(end, rest) - 1)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)
