"""Splitting of oversized texts at natural boundaries.

The boundaries of a text are found once as sorted offset arrays, one for each kind (paragraph, turn,
sentence, word). A cut is a binary search for the last boundary under the limit, of the best kind that lies
in the second half of the room, else of any kind, else hard at the limit. The next piece starts up to
``overlap`` characters before the cut, at a word start where there is one.

The operator works on any unit that has offsets: for a limit in tokens, ``cut_points`` takes the prefix
sums of token lengths as ``sizes``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2000, 200

# Where a piece may end, best kind first; the end of a match is the boundary.
BOUNDARIES = (
    re.compile(r"\n[^\S\n]*\n\s*"),  # paragraph
    re.compile(r"\n+"),  # turn or line
    re.compile("[.!?…]+[\"'”’»)\\]]*\\s+|[。！？]+[」』）]*\\s*"),  # sentence
    re.compile(r"\s+"),  # word
)


def boundaries(text: str) -> list[np.ndarray]:
    """Sorted offsets at which a piece may end, one array a kind, best kind first."""
    return [np.fromiter((m.end() for m in kind.finditer(text)), dtype=np.int64) for kind in BOUNDARIES]


def cut_points(n: int, kinds: list[np.ndarray], limit: int, overlap: int, sizes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spans (start, end) of the pieces of a text of ``n`` characters.

    ``sizes``: ascending prefix sums of size at each offset, length n + 1; without it a character counts 1.
    Every span is at most ``limit``, starts at most ``overlap`` before the end of the one before, never after
    it, and ends further; so no character is lost. One character larger than the limit forms a piece alone.
    """
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("limit must be positive and overlap in 0 .. limit - 1")
    spans, start, covered = [], 0, 0
    words = kinds[-1] if kinds else np.empty(0, dtype=np.int64)
    while True:
        if sizes is None:
            room = start + limit
        else:
            room = int(np.searchsorted(sizes, sizes[start] + limit, side="right")) - 1
            if room <= covered:  # the next character leaves no room for an overlap
                start = covered
                room = max(int(np.searchsorted(sizes, sizes[start] + limit, side="right")) - 1, start + 1)
        if room >= n:
            spans.append((start, n))
            return spans
        end = 0
        for least in (max(start + (room - start) // 2, covered), covered):
            for ends in kinds:
                at = int(np.searchsorted(ends, room, side="right")) - 1
                if at >= 0 and ends[at] > least:
                    end = int(ends[at])
                    break
            if end:
                break
        end = end or room
        spans.append((start, end))
        covered = end
        if sizes is None:
            back = max(end - overlap, start + 1)
        else:
            back = max(int(np.searchsorted(sizes, sizes[end] - overlap, side="left")), start + 1)
        back = min(back, end)
        at = int(np.searchsorted(words, back, side="left"))
        start = int(words[at]) if at < len(words) and words[at] < end else back


def split_texts(df: DataFrame, key: str, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, unit_order, span_start, span_end, piece) of every text longer than ``limit`` characters.

    Spans are code points of the stored text; ``piece`` is the text of its span. Null, empty and short texts
    give no rows. A text without any boundary is cut hard. Only the two columns named are read, and only
    oversized texts leave the JVM; each row stands alone, so there is no shuffle.
    """
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("limit must be positive and overlap in 0 .. limit - 1")
    large = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.length("text") > limit)
    kind = large.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for k, t in zip(batch["key"], batch["text"]):
                rows += [(k, i, a, b, t[a:b]) for i, (a, b) in enumerate(cut_points(len(t), boundaries(t), limit, overlap))]
                if len(rows) > 5000:
                    yield pd.DataFrame(rows, columns=["key", "unit_order", "span_start", "span_end", "piece"])
                    rows = []
            yield pd.DataFrame(rows, columns=["key", "unit_order", "span_start", "span_end", "piece"])

    return large.mapInPandas(run, f"key {kind}, unit_order int, span_start int, span_end int, piece string").withColumnRenamed("key", key)
