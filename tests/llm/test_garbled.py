import random

import numpy as np
import pytest

from weftmark.llm import garbled as G

CLEAN = [
    "Die Größe über die Brücke für Wärme natürlich schön geprüft.", "Três canções e uma mão não estão lá, a questão é próxima.", "La théorie déjà évaluée après la forêt où l’été s’achève…",
    "Почему задача не построена? Вчера широкая мельница снова закрыта.", "Η λίμνη και η έκθεση έμειναν εδώ ποτέ.", "昨日、資料と機械を延期した。正確な実験は方法を比較した。", "The “quick” brown fox – naïve café costs €5 at 20 °C.",
    "La señora compañía pequeña mañana está aquí según la región.", "plain words without any accent at all in this one",
]


def corpus():
    rnd = random.Random(1)
    words = [t.split() for t in CLEAN]
    return [" ".join(rnd.sample(w, len(w))) for w in words for _ in range(120)] + CLEAN * 40 + ["├── root", "√2 ≈ 1.41"] * 20


@pytest.fixture(scope="module")
def model():
    table = np.zeros(G.SIZE * G.SIZE, dtype=np.int64)
    for t in corpus():
        c = G.classes_of(G.points_of("\n" + t + "\n"))
        np.add.at(table, c[:-1].astype(np.int64) * G.SIZE + c[1:], 1)
    pairs = np.flatnonzero(table)
    return G.PairModel(pairs, table[pairs])


@pytest.mark.parametrize("text", CLEAN + ["ATENÇÃO : A CONEXÃO NÃO ESTÁ", "├── root", "√2 ≈ 1.41", "a b", "", "x" * 10_000])
def test_clean_text_is_left_alone(model, text):
    if text in CLEAN:
        assert G.restore(text, model) == (text, 0, True)
    else:
        assert G.restore(text, model)[0] == text


@pytest.mark.parametrize("read", ["cp1252", "latin-1", "cp437", "mac_roman", "cp1251", "cp850"])
@pytest.mark.parametrize("text", CLEAN[:4])
def test_utf8_read_as_single_bytes(model, read, text):
    table = {b: ch for ch, b in G.byte_table(read).items()}
    garbled = "".join(chr(b) if b < 0x80 else table[b] for b in text.encode())
    fresh, runs, whole = G.restore(garbled, model)
    assert fresh == text and runs and whole


def test_read_twice_and_in_part(model):
    part = "Größe über".encode().decode("latin-1").encode().decode("latin-1")
    assert G.restore("natürlich " + part + " Brücke", model)[0] == "natürlich Größe über Brücke"


@pytest.mark.parametrize("read, true, text", [("cp1252", "cp1251", CLEAN[3]), ("cp1251", "koi8-r", CLEAN[3]), ("koi8-r", "cp1251", CLEAN[3]), ("cp1252", "mac_roman", CLEAN[1]), ("cp1252", "cp850", CLEAN[0])])
def test_one_encoding_read_as_another(model, read, true, text):
    table = {b: ch for ch, b in G.byte_table(read).items()}
    garbled = "".join(chr(b) if b < 0x80 else table[b] for b in text.encode(true, "ignore"))
    fresh, runs, _ = G.restore(garbled, model)
    assert runs and fresh == text


@pytest.mark.parametrize("read", G.WIDE_READ)
@pytest.mark.parametrize("text", [CLEAN[0], CLEAN[3], CLEAN[5]])
def test_utf8_read_as_two_bytes(model, read, text):
    tried = 0
    for word in text.split():
        try:
            garbled = word.encode().decode(read)
        except UnicodeDecodeError:
            continue
        if not word.isascii() and len(word.encode()) - len(word) > 3 and garbled.encode(read) == word.encode():
            tried += 1
            fresh, runs, whole = G.restore(garbled, model)
            assert runs and whole and fresh == word
    assert tried or text != CLEAN[3] or read not in ("gbk", "cp932")


def test_rare_letters_of_a_large_corpus(model):
    table = np.zeros(G.SIZE * G.SIZE, dtype=np.int64)
    for t in corpus():
        c = G.classes_of(G.points_of("\n" + t + "\n"))
        np.add.at(table, c[:-1].astype(np.int64) * G.SIZE + c[1:], 1000)
    c = G.classes_of(G.points_of(" Dvořák "))
    np.add.at(table, c[:-1].astype(np.int64) * G.SIZE + c[1:], 3)
    pairs = np.flatnonzero(table)
    garbled = "Dvo" + "řá".encode().decode("latin-1") + "k"
    assert G.restore("plain words by " + garbled, G.PairModel(pairs, table[pairs]))[0] == "plain words by Dvořák"


def test_found_without_a_mapping(model):
    for text in ("plain words by Dvo" + "řá".encode().decode("latin-1") + "k", "plain â€½ words", "mÃƒÂ\xadnima"):
        _, runs, whole = G.restore(text, model)
        assert runs or not whole
    for text in ("MAÇÃ” e “ATENÇÃO”", "“É”", "soft\xadhyphen"):
        assert G.restore(text, model)[1:] == (0, True)


def test_tables(spark):
    rows = [(i, t) for i, t in enumerate(corpus())]
    bad = [(90_001, "Größe über Wärme".encode().decode("latin-1")), (90_002, "F��r die Brücke"), (90_003, None), (90_004, ""), (90_001, "Größe über Wärme".encode().decode("latin-1"))]
    df = spark.createDataFrame([(*r, "k") for r in rows + bad], "doc_id long, text string, key string")
    got = {r["doc_id"]: r for r in G.garbled(df, "doc_id").collect()}
    assert set(got) == {90_001, 90_002}
    assert got[90_001]["restored"] == "Größe über Wärme" and got[90_001]["whole"] and not got[90_002]["whole"]
    assert G.garbled(df.limit(0), "doc_id").count() == 0


def test_counts_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(t,) for t in CLEAN * 3], "text string")
    one = {tuple(r) for r in G.pair_counts(df.coalesce(1)).collect()}
    many = {tuple(r) for r in G.pair_counts(df.repartition(4)).collect()}
    total = lambda x: sum(n for p, n in x if p != 10 * G.SIZE + 10)
    assert total(one) == total(many)


def _garblings():
    for k, text in enumerate(CLEAN):
        for read in ("cp1252", "cp1251", "cp437", "gbk"):
            yield text
            for whole in (True, False):
                part = text if whole else text[: len(text) // 2]
                try:
                    once = part.encode("utf-8").decode(read)
                    yield once + text[len(part) :]
                    yield once.encode("utf-8").decode(read) + text[len(part) :]
                except UnicodeDecodeError:
                    pass


def test_one_round_finds_the_same_texts(model):
    for text in _garblings():
        once, many = G.restore(text, model, rounds=1), G.restore(text, model)
        assert bool(once[1] or not once[2]) == bool(many[1] or not many[2]), text


def test_the_batch_test_misses_nothing(model):
    texts = list(_garblings())
    kept = G.suspects(texts, model)
    assert 0 < kept.sum()
    for text, keep in zip(texts, kept):
        if not keep:
            assert G.restore(text, model) == (text, 0, True)
    # the place in the batch does not matter
    assert [bool(G.suspects([t], model)[0]) for t in texts] == kept.tolist()
