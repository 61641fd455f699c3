import hashlib
import math
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from weftmark.functions import ids, vectors
from weftmark.functions.stemmer import stem
from weftmark.operators import extract, graph, induce, resolve, score, segment, simjoin
from weftmark.operators.simjoin import cosine_pairs


def docs(spark, *texts):
    return spark.createDataFrame([(i, f"d{i}", t) for i, t in enumerate(texts)], "doc_pos long, doc_id string, text string")


def unit_frame(spark, *texts):
    return spark.createDataFrame([(0, "d0", f"d0:u{i}", i, t) for i, t in enumerate(texts)], "doc_pos long, doc_id string, unit_id string, unit_order int, text string")


def mention_frame(spark, rows):
    return spark.createDataFrame([(p, f"d{p}", u, f"d{p}:u{u}", o, s, a, b) for p, u, o, s, a, b in rows], "doc_pos long, doc_id string, unit_order int, unit_id string, ord int, surface string, span_start int, span_end int")


def embed(text, dim=64):
    out = [0] * dim
    padded = f" {text.lower()} "
    for i in range(len(padded) - 2):
        out[int(hashlib.md5(padded[i : i + 3].encode()).hexdigest(), 16) % dim] += 1
    return out


def cos(a, b):
    whole = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / whole if whole else 0.0


def test_segmenters(spark):
    texts = ["a\n\n\nb", "", None, " \n ", "One. Two!  Three? four", "x \n\ny　", "anna: hi there\nplain line"]
    block = [(r["doc_pos"], r["unit_order"], r["text"]) for r in segment.block(docs(spark, *texts)).collect()]
    assert block == [(0, 0, "a"), (0, 1, "b"), (4, 0, texts[4]), (5, 0, "x"), (5, 1, "y"), (6, 0, texts[6])]
    assert [r["text"] for r in segment.sentence(docs(spark, texts[4])).collect()] == ["One.", "Two!", "Three?", "four"]
    turns = segment.turn(docs(spark, texts[6])).collect()
    assert [(r["speaker"], r["text"]) for r in turns] == [("anna", "hi there"), (None, "plain line")]


def test_token_spans(spark):
    text = "🙂 Olive-oil isn't ÄPFEL but co-op store"
    got = [(r["surface"], r["span_start"], r["span_end"]) for r in extract.token(unit_frame(spark, text)).orderBy("ord").collect()]
    want = [(m.group().lower(), m.start(), m.end()) for m in re.finditer("[A-Za-z][A-Za-z-]+", text) if len(m.group()) >= 4]
    assert got == want
    assert extract.token(unit_frame(spark, text).limit(0)).count() == 0


@pytest.mark.parametrize("block", [1, 3, 100])
def test_gazetteer_equals_regex(spark, block):
    terms = ["oil", "olive oil", "Fat", "c++", "été", "olive", "sunflower oil", None, "", "oil"]
    text = "Olive OIL and olive-oil, boil; FAT fats c++ c++x ÉTÉ. sunflower  oil sunflower oil" + " pad" * 30
    known = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
    pattern = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, known)) + r")(?!\w)", re.IGNORECASE)
    got = extract.gazetteer(unit_frame(spark, text, "nothing here"), spark.createDataFrame([(t,) for t in terms], "term string"), block=block).orderBy("ord").collect()
    assert [(r["surface"], r["span_start"], r["span_end"]) for r in got] == [(m.group(), m.start(), m.end()) for m in pattern.finditer(text)]
    assert all(r["context"] == text[max(0, r["span_start"] - 40) : r["span_end"] + 40] for r in got)


def test_gold_mentions_checks_text(spark):
    schema = "doc_id string, text string, mentions array<struct<span_start:int,span_end:int,surface:string>>"
    units = unit_frame(spark, "Paris is big")
    good = spark.createDataFrame([("d0", "Paris is big", [(0, 5, "Paris")])], schema)
    assert extract.gold_mentions(units, good).first()["surface"] == "Paris"
    for bad in ([("d0", "other", [])], [("d9", "Paris is big", [])]):
        with pytest.raises(Exception, match="gold"):
            extract.gold_mentions(units, spark.createDataFrame(bad, schema)).collect()
    with pytest.raises(ImportError, match="spacy"):
        extract.noun_chunk(units)


def random_case(seed, n_docs=3):
    rnd = random.Random(seed)
    vocabulary = ["oil", "olive oil", "ring", "Ring", "valve", "naïve", "x"]
    units, mentions = [], []
    for p in range(n_docs):
        for u in range(rnd.randint(1, 4)):
            words = [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 6))]
            text, at = "", 0
            for o, w in enumerate(words):
                text += (" " if text else "") + w
                if rnd.random() < 0.8:
                    mentions.append((p, u, o, w, len(text) - len(w), len(text)))
            units.append((p, f"d{p}", f"d{p}:u{u}", u, text))
    return units, mentions


def test_scorers_equal_brute_force(spark):
    units, mentions = random_case(3)
    u = spark.createDataFrame(units, "doc_pos long, doc_id string, unit_id string, unit_order int, text string")
    m = mention_frame(spark, mentions)
    got = {name: {(r["doc_pos"], r["surface"]): r["salience"] for r in f.collect()} for name, f in (("cosine", score.embedding_cosine(m, u)), ("mderank", score.mderank(m, u)), ("hcuke", score.hcuke(m, u)), ("frequency", score.frequency(m)))}
    slow = vectors.hashed(score.masked_texts(m, u), ["doc_pos", "surface"], "text")
    masked_counts = {(r["doc_pos"], r["surface"]): r["square"] for r in slow.collect()}
    for p in {x[0] for x in mentions}:
        text_of = {x[3]: x[4] for x in units if x[0] == p}
        text = "\n".join(text_of[k] for k in sorted(text_of))
        mine = [x for x in mentions if x[0] == p]
        surfaces = sorted({x[3] for x in mine})
        weights = {k: math.exp(1 / (k + 1)) for k in text_of}
        total = sum(weights.values())
        position, offset = {}, 0
        for k in sorted(text_of):
            for x in mine:
                if x[1] == k:
                    place = offset + len(text_of[k][: x[4]].split()) + 1
                    position[x[3]] = min(position.get(x[3], place), place)
            offset += len(text_of[k].split())
        softened = {s: math.exp(1 / position[s]) for s in surfaces}
        sims = {(a, b): 1.0 if a == b else cos(embed(a), embed(b)) for a in surfaces for b in surfaces}
        n = len(surfaces)
        mean = sum(sims[a, b] for a in surfaces for b in surfaces if a < b) / (n * (n - 1) / 2) if n > 1 else 0.0
        for s in surfaces:
            assert got["cosine"][p, s] == pytest.approx(cos(embed(s), embed(text)), abs=1e-9)
            masked = dict(text_of)
            for x in sorted((x for x in mine if x[3] == s), key=lambda x: -x[4]):
                masked[x[1]] = masked[x[1]][: x[4]] + " ".join(["[MASK]"] * max(1, len(s.split()))) + masked[x[1]][x[5] :]
            hidden = "\n".join(masked[k] for k in sorted(masked))
            assert masked_counts[p, s] == sum(v * v for v in embed(hidden))
            assert got["mderank"][p, s] == pytest.approx(1 - cos(embed(text), embed(hidden)), abs=1e-9)
            overall = sum(weights[k] / total * cos(embed(text_of[k]), embed(text)) * cos(embed(s), embed(text_of[k])) for k in {x[1] for x in mine if x[3] == s})
            local = sum(sims[s, b] - 1.3 * mean for b in surfaces)
            assert got["hcuke"][p, s] == pytest.approx(overall * local * softened[s] / sum(softened.values()), abs=1e-9)
            most = max(sum(x[3] == b for x in mine) for b in surfaces)
            assert got["frequency"][p, s] == sum(x[3] == s for x in mine) / most


def test_selection_ties(spark):
    m = mention_frame(spark, [(0, 0, i, s, i, i + 1) for i, s in enumerate("bbacd")])
    assert {r["surface"] for r in score.frequency(m, 2).filter("selected").collect()} == {"b", "a"}
    assert score.frequency(m.limit(0)).count() == 0
    assert all(r["selected"] and r["salience"] == 1.0 for r in score.passthrough(m).collect())


def test_ids_and_vectors(spark):
    names = ["oil", "naïve", "", "日本"]
    df = spark.createDataFrame([(n,) for n in names], "label string")
    got = [r[0] for r in df.select(ids.concept_id(F.col("label"))).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, "concept:" + n)) for n in names]
    hashed = {r["label"]: r for r in vectors.hashed(df, ["label"], "label").select("label", vectors.dense(F.col("counts")).alias("v")).collect()}
    assert "" not in hashed and all(list(hashed[n]["v"]) == embed(n) for n in names if n)
    pair = spark.createDataFrame([([1.0, 0.0], [0.8, 0.6]), ([0.0], [1.0]), ([], [1.0]), ([3.0, 4.0, 9.0], [3.0, 4.0])], "a array<double>, b array<double>")
    values = [r[0] for r in pair.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert values[:3] == [0.8, 0.0, 0.0] and values[3] == pytest.approx(25 / (math.sqrt(106) * 5))
    beatles = cos(embed("beatles"), embed("the beatles"))
    assert round(beatles, 4) == 0.8386 and round(cos(embed("beatles"), embed("kid rock")), 4) == 0.1336


@pytest.mark.parametrize("threshold", [0.9, 0.3, -0.5])
def test_similarity_join(spark, threshold):
    rnd = random.Random(11)
    base = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, [x + rnd.gauss(0, 0.2) for x in rnd.choice(base)] if i % 9 else [0.0] * 8) for i in range(120)]
    got = {(r["a"], r["b"]) for r in cosine_pairs(spark.createDataFrame(rows, "item long, vector array<double>"), threshold, 8, pivots=5).collect()}
    assert got == {(i, j) for i, a in rows for j, b in rows if i < j and round(cos(a, b), 12) >= threshold}


def test_cosine_pairs_by_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 64))
    near = base + 0.7 * rng.standard_normal((40, 64)) * rng.random((40, 1))
    x = np.vstack([base, near, np.repeat(base[:1], 30, axis=0), np.zeros((2, 64)), rng.integers(0, 3, (40, 64))])
    unit = np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=x.any(axis=1, keepdims=True))
    want = {(i, j) for i, j in zip(*np.nonzero(np.round(unit @ unit.T, 12) >= 0.9)) if i < j}
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item long, vector array<double>")
    got = cosine_pairs(rows, 0.9, 64, block=32).collect()
    assert len(got) == len(want) > 450 and {(r["a"], r["b"]) for r in got} == want
    assert all(r["cosine"] == pytest.approx(unit[r["a"]] @ unit[r["b"]], abs=1e-11) for r in got)
    # equal vectors: every cell of a tile is a pair, and their cosines are taken a few at a time
    monkeypatch.setattr(simjoin, "EXACT", 1000)
    same, short = np.repeat(base[:1], 90, axis=0), simjoin._narrow(np.repeat(unit[:1], 90, axis=0), simjoin._basis(unit, 64))
    sizes = [len(rows) for rows, _, _ in simjoin._tile(same, same, short, short, 0.9)]
    assert sum(sizes) == 8100 and max(sizes) == 1000


def fold(labels, threshold, prior=()):
    """The sequential resolver: one label after the other."""
    known, order, out = {}, [], []
    for p in prior:
        known[p] = p
        order.append(p)
    for x in labels:
        if x in known:
            out.append((x, False))
            continue
        best = min(((-round(cos(embed(x), embed(c)), 12), str(uuid.uuid5(uuid.NAMESPACE_URL, "concept:" + c)), c) for c in order), default=None)
        if best and -best[0] >= threshold:
            out.append((best[2], False))
        else:
            known[x] = x
            order.append(x)
            out.append((x, True))
    return out


@pytest.mark.parametrize("threshold, prior", [(0.6, ()), (0.4, ("olive oils", "ring")), (0.0, ())])
def test_nearest_resolver_equals_the_fold(spark, threshold, prior):
    rnd = random.Random(int(threshold * 10))
    words = ["olive oil", "olive oils", "the olive oil", "oil", "ring", "rings", "ringing", "valve", "relay valve", "relay", "a"]
    labels = [rnd.choice(words) for _ in range(40)]
    m = mention_frame(spark, [(i // 7, i % 7 // 3, i % 7 % 3, x, 0, len(x)) for i, x in enumerate(labels)]).withColumn("selected", F.lit(True))
    before = spark.createDataFrame([(str(uuid.uuid5(uuid.NAMESPACE_URL, "concept:" + p)), p) for p in prior], "id string, label string") if prior else None
    rows = resolve.embedding_nn(m, threshold, before).orderBy("doc_pos", "unit_order", "ord").collect()
    assert [(r["concept_label"], r["is_new"]) for r in rows] == fold(labels, threshold, prior)


def test_exact_resolver_and_graph(spark):
    m = mention_frame(spark, [(0, 0, 0, "Oil ", 0, 3), (0, 0, 1, "ring", 4, 8), (1, 0, 0, "oil", 0, 3), (1, 1, 0, "valve", 0, 5)]).withColumn("selected", F.lit(True))
    r = resolve.exact_label(m)
    assert [(x["label"], x["is_new"]) for x in r.orderBy("doc_pos", "unit_order", "ord").collect()] == [("oil", True), ("ring", True), ("oil", False), ("valve", True)]
    c = {x["label"]: (x["first_seen"], x["updated_at"]) for x in graph.concepts(r).collect()}
    assert c == {"oil": ("d0", "d1"), "ring": ("d0", "d0"), "valve": ("d1", "d1")}
    co = induce.co_occurrence(r).collect()
    assert len(co) == 1 and co[0]["source_id"] < co[0]["target_id"]
    d = {x["doc_id"]: x for x in graph.deltas(spark.createDataFrame([(0, "d0"), (1, "d1"), (2, "d2")], "doc_pos long, doc_id string"), r, induce.co_occurrence(r)).collect()}
    assert [(d[k]["concepts_added"], d[k]["concepts_updated"], d[k]["relations_added"]) for k in ("d0", "d1", "d2")] == [(2, 0, 1), (1, 1, 0), (0, 0, 0)]


SENTENCES = {
    "oils such as olive oil, palm oil and nut oil": {("olive oil", "oils"), ("palm oil", "oils"), ("nut oil", "oils")},
    "such oils as olive oil": {("olive oil", "oils")},
    "oils as olive oil": set(),
    "oils, including olive oil or palm oil": {("olive oil", "oils"), ("palm oil", "oils")},
    "oils especially olive oil": {("olive oil", "oils")},
    "olive oil, palm oil and other oils": {("palm oil", "oils")},
    "olive oil or other oils": {("olive oil", "oils")},
    "Olive oil IS A kind of oils": {("olive oil", "oils")},
    "olive oil are an oils": {("olive oil", "oils")},
    "oils. Such as olive oil": set(),
    "oils such as olive oil, then palm oil": {("olive oil", "oils")},
}


@pytest.mark.parametrize("text", list(SENTENCES))
def test_patterns(spark, text):
    names = ["olive oil", "palm oil", "nut oil", "oils"]
    rows, low = [], text.lower()
    for s in names:
        rows += [(0, 0, m.start(), s, m.start(), m.end()) for m in re.finditer(s, low)]
    m = mention_frame(spark, rows).withColumn("selected", F.lit(True))
    r = resolve.exact_label(m)
    label = {x["concept_id"]: x["label"] for x in r.collect()}
    got = {(label[x["source_id"]], label[x["target_id"]]) for x in induce.hearst(r, unit_frame(spark, text)).collect()}
    assert got == SENTENCES[text]
    if "IS A" in text:
        assert induce.hearst(r, unit_frame(spark, text), copula=False).count() == 0
    with pytest.raises(ValueError, match="nope"):
        induce.hearst(r, unit_frame(spark, text), patterns=["nope"])


def test_compound(spark):
    m = mention_frame(spark, [(0, 0, i, s, 0, 1) for i, s in enumerate(["extra olive oil", "olive oil", "oil", "pineapple", "apple"])]).withColumn("selected", F.lit(True))
    r = resolve.exact_label(m)
    label = {x["concept_id"]: x["label"] for x in r.collect()}
    pairs = lambda df: {(label[x["source_id"]], label[x["target_id"]]) for x in df.collect()}
    assert pairs(induce.compound(r)) == {("extra olive oil", "olive oil"), ("olive oil", "oil")}
    assert pairs(induce.compound(r, longest_only=False)) == {("extra olive oil", "olive oil"), ("extra olive oil", "oil"), ("olive oil", "oil")}
    assert induce.union([induce.compound(r), induce.compound(r)]).count() == 4


def test_view(spark):
    concepts = spark.createDataFrame([("1", "Oil"), ("2", "oil"), ("3", "ring")], "id string, label string")
    relations = spark.createDataFrame([("IS_A", "1", "3"), ("IS_A", "3", "3"), ("CO_OCCURS", "2", "3"), ("IS_A", "3", "9")], "type string, source_id string, target_id string")
    view = graph.GraphView(concepts, relations)
    assert view.find_concept("OIL").first()["id"] == "2" and view.find_concept("none").count() == 0
    near = view.neighbors(spark.createDataFrame([("3",)], "id string")).collect()
    assert sorted((r["type"], r["other_id"]) for r in near) == [("CO_OCCURS", "2"), ("IS_A", "1"), ("IS_A", "3")]
    assert view.relations("IS_A").count() == 3


def test_nearest_concepts(spark):
    store = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0]), ("s", [1.0])], "id string, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query long, vector array<double>")
    got = [(r["rank"], r["id"], r["cosine"]) for r in resolve.nearest_concepts(asked, store, 3, 2).orderBy("rank").collect()]
    assert got == [(1, "a", 1.0), (2, "b", 1.0), (3, "c", 0.0)]


STEMS = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consistency": "consist", "knightly": "knight", "knots": "knot", "generously": "generous", "communities": "communiti", "happy": "happi",
    "relational": "relat", "hopping": "hop", "hoping": "hope", "skies": "sky", "dying": "die", "ties": "tie", "cries": "cri", "agreed": "agre", "sensational": "sensat", "national": "nation", "embeddings": "embed", "indexes": "index",
}


@pytest.mark.parametrize("word", list(STEMS))
def test_stems(word):
    assert stem(word) == STEMS[word]


def test_views_put_the_spelling_of_types_aside(spark, tmp_path):
    from weftmark.queries import stages

    spark.createDataFrame([(x, x.upper()) for x in "abc"], "id string, label string").write.parquet(f"{tmp_path}/concepts.parquet")
    rows = [("IS_A", "a", "b"), (" is_a ", "b", "c"), ("Co_Occurs", "a", "c"), ("CO_OCCURS", "a", "c"), (None, "c", "a"), ("IS_A", "a", "x"), ("is_A", "c", "c")]
    spark.createDataFrame(rows, "type string, source_id string, target_id string").write.parquet(f"{tmp_path}/relations.parquet")
    assert sorted(map(tuple, stages.QUERIES["view_relations_plain"](spark, str(tmp_path)).collect())) == [("a", "b"), ("a", "x"), ("b", "c"), ("c", "c")]
    got = {(r["id"], r["other_id"], r["type"]) for r in stages.QUERIES["view_neighbors_all"](spark, str(tmp_path)).collect()}
    assert got == {("a", "b", "IS_A"), ("b", "a", "IS_A"), ("b", "c", "IS_A"), ("c", "b", "IS_A"), ("c", "c", "IS_A"), ("a", "c", "CO_OCCURS"), ("c", "a", "CO_OCCURS")}
