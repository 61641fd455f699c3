import base64
import gc
import random
from array import array

import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from weftmark.llm import tokenize as T

VOCABULARY = T.read_vocabulary()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, VOCABULARY.splitlines())}
KNOWN = tiktoken.Encoding("known", pat_str=T.PATTERN, mergeable_ranks=RANKS, special_tokens={})
MACHINE = T.transducer(VOCABULARY)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80))
def test_equals_the_public_encoder(text):
    ids = MACHINE.encode(text)
    assert ids == KNOWN.encode_ordinary(text) and MACHINE.decode(ids) == text


def test_words_of_tokens_and_long_runs():
    rnd = random.Random(3)
    tokens = list(RANKS)
    for _ in range(3000):
        word = b"".join(rnd.choice(tokens) for _ in range(rnd.randrange(1, 5))) * rnd.choice((1, 1, 20))
        assert MACHINE.encode_bytes(word) == KNOWN._encode_single_piece(word)


def test_bounded_table_changes_nothing(monkeypatch):
    monkeypatch.setattr(T, "MAX_STATES", 5)
    small = T.Transducer(VOCABULARY)
    text = "Straße 日本語 antidisestablishmentarianism " * 3 + "a" * 300
    assert small.encode(text) == KNOWN.encode_ordinary(text)


def test_new_words_cost_few_border_tests_and_nothing_to_collect(monkeypatch):
    machine, tested = T.Transducer(VOCABULARY), []
    holds = machine._border_holds
    monkeypatch.setattr(machine, "_border_holds", lambda left, right: tested.append(right) or holds(left, right))
    rnd = random.Random(4)
    words = [f" {rnd.randrange(10**6)}" for _ in range(5000)] + ["日本語" * 50, "antidisestablishmentarianism"]
    gc.collect()
    before = len(gc.get_objects())
    found = [array("i", machine.encode_bytes(word.encode())).tobytes() for word in words]
    gc.collect()
    assert len(gc.get_objects()) - before < 500  # was 2,600: a table a state
    assert all(len(machine.tokens[right]) > 1 for right in tested)  # one hypothesis ends at each byte: if no other, the byte alone
    assert found == [array("i", KNOWN.encode_ordinary(word)).tobytes() for word in words]


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=20), st.integers(0, 20))
def test_incremental_utf8(data, cut):
    machine = T.Utf8Machine()
    assert machine.feed(data[:cut]) + machine.feed(data[cut:]) + machine.end() == data.decode("utf-8", "replace")


def test_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "<|endoftext|>", 0), (3, "héllo wörld", 1)], "doc_id long, text string, key int")
    rows = T.encode_texts(df, "doc_id").collect()
    assert sorted((r["doc_id"], r["ids"]) for r in rows) == sorted([(1, []), (2, []), (3, KNOWN.encode_ordinary("<|endoftext|>")), (3, KNOWN.encode_ordinary("héllo wörld"))])
    counts = {(r["doc_id"], r["n_tokens"]) for r in T.encode_texts(df, "doc_id", counts_only=True).collect()}
    assert counts == {(r["doc_id"], len(r["ids"])) for r in rows}
    back = {r["text"] for r in T.decode_ids(T.encode_texts(df, "doc_id"), "doc_id").collect()}
    assert back == {"", "<|endoftext|>", "héllo wörld"}
    assert T.encode_texts(df.limit(0), "doc_id").count() == 0
