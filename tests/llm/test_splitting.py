import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftmark.llm import splitting as S


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n!é。 ", max_size=200), st.integers(1, 40), st.integers(0, 39), st.booleans())
def test_pieces_cover_and_overlap(text, limit, overlap, sized):
    if overlap >= limit or not text:
        return
    sizes = np.concatenate([[0], np.cumsum([1 + ord(c) % 3 for c in text])]) if sized else None
    spans = S.cut_points(len(text), S.boundaries(text), limit, overlap, sizes)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    weight = (lambda a, b: sizes[b] - sizes[a]) if sized else (lambda a, b: b - a)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b < d and weight(c, b) <= overlap
    assert all(weight(a, b) <= limit or b - a == 1 for a, b in spans)


def test_prefers_natural_boundaries():
    text = "a" * 60 + ".\n\n" + "b" * 20 + ". " + "c" * 60
    assert S.cut_points(len(text), S.boundaries(text), 100, 10)[0] == (0, 63)
    words = "word " * 50
    assert all(words[b - 1] == " " for _, b in S.cut_points(len(words), S.boundaries(words), 33, 7))
    assert [b - a for a, b in S.cut_points(250, S.boundaries("x" * 250), 100, 0)] == [100, 100, 50]


def test_rows_nulls_short_and_surrogate_pairs(spark):
    long_ = "🙂 wörd\n" * 700
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "x" * 2000, "k"), (4, long_, "k"), (4, "x" * 2001, None)], "doc_id long, text string, key string")
    rows = S.split_texts(df, "doc_id").collect()
    assert {r["doc_id"] for r in rows} == {4}
    pieces = sorted((r for r in rows if "w" in r["piece"]), key=lambda r: r["unit_order"])
    assert [r["unit_order"] for r in pieces] == list(range(len(pieces)))
    assert all(r["piece"] == long_[r["span_start"] : r["span_end"]] and len(r["piece"]) <= 2000 for r in pieces)
    assert S.split_texts(df.limit(0), "doc_id").count() == 0
    with pytest.raises(ValueError):
        S.split_texts(df, "doc_id", limit=10, overlap=10)
