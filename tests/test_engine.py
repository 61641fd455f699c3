import json

import pytest

from weftmark.plans import registry
from weftmark.plans.config import PROFILES, Config, combinations, read
from weftmark.plans.engine import Engine
from weftmark.plans.runner import run_experiment, write_sweep
from weftmark.sources import converters, readers
from weftmark.streaming.ingest import ingest_stream, resume

A = "Granite cliffs shelter puffins."
B = "A kittiwake is a kind of gull that nests where cliffs are steep."
C = "Puffins, gulls and kittiwakes share the granite cliffs with terns."
SMALL = {
    "segmenter": {"name": "block"}, "extractor": {"name": "token"}, "scorer": {"name": "frequency"}, "resolver": {"name": "exact-label"}, "relation_inducer": {"name": "co-occurrence"},
}


def tables(engine):
    concepts, relations = engine.snapshot()
    return sorted(map(str, concepts.collect())), sorted(map(str, relations.collect()))


def test_ingest_save_load_resume(spark, tmp_path):
    straight = Engine(spark)
    first = straight.ingest(A)
    assert first["doc_id"] == "doc-0" and first["concepts_added"] == 4
    straight.ingest(B)
    straight.save(tmp_path / "graph.json")
    straight.ingest(C)
    again = Engine.load(spark, tmp_path / "graph.json")
    again.save(tmp_path / "copy.json")
    assert (tmp_path / "copy.json").read_text() == (tmp_path / "graph.json").read_text()
    assert again.ingest(C)["doc_id"] == "doc-2"
    assert tables(again) == tables(straight)
    batch = Engine(spark)
    batch.ingest_all([A, B, C])
    assert tables(batch) == tables(straight)
    bad = json.loads((tmp_path / "graph.json").read_text()) | {"format_version": 9}
    (tmp_path / "bad.json").write_text(json.dumps(bad))
    with pytest.raises(ValueError, match="9"):
        Engine.load(spark, tmp_path / "bad.json")


def test_documents_and_errors(spark):
    engine = Engine.from_config(spark, SMALL)
    with pytest.raises(ValueError):
        engine.ingest({"id": "x", "text": "some text"}, kind="note", id="y")
    assert engine.ingest({"id": "x", "text": "some words"})["doc_id"] == "x"
    assert engine.ingest("more words", id="own")["doc_id"] == "own"
    assert engine.ingest("last words")["doc_id"] == "doc-1"
    assert engine.view().find_concept("WORDS").count() == 1
    with pytest.raises(ValueError, match="no text"):
        engine.ingest({"id": "n", "text": None})
    skip = Engine.from_config(spark, SMALL | {"run": {"on_error": "skip"}})
    deltas = skip.ingest_all([{"id": "n", "text": None}, "good text here"])
    assert deltas[0]["error"] and not deltas[1]["error"] and deltas[1]["concepts_added"] == 3
    skip.reset()
    assert tables(skip) == ([], [])
    assert skip.ingest_all([]) == []


def test_profiles_and_optional_packages(spark):
    with pytest.raises(ValueError, match="lite"):
        Engine(spark, "heavy")
    with pytest.raises(ImportError):
        Engine(spark, "standard")


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    rows = [(i, f"d{i}", t) for i, t in enumerate((A, B, C))]
    spark.createDataFrame(rows, "doc_pos long, doc_id string, text string").coalesce(1).write.parquet(str(source))
    engine = Engine.from_config(spark, SMALL)
    stream = spark.readStream.schema("doc_pos long, doc_id string, text string").parquet(str(source))
    query = ingest_stream(engine, stream, str(tmp_path / "check"), state=str(tmp_path / "state"))
    query.awaitTermination(120)
    batch = Engine.from_config(spark, SMALL)
    batch.ingest_frame(spark.createDataFrame(rows, "doc_pos long, doc_id string, text string"))
    assert tables(engine) == tables(batch)
    back = resume(spark, str(tmp_path / "state"), engine.last_batch)
    assert tables(back) == tables(engine) and back.last_batch == engine.last_batch


def test_registry_and_config(tmp_path):
    with pytest.raises(registry.RegistryError, match="frequency"):
        registry.get("scorer", "none")
    with pytest.raises(registry.RegistryError):
        registry.get("port", "none")
    with pytest.raises(registry.RegistryError):
        registry.register("scorer", "frequency")(lambda m: m)
    with pytest.raises(ValueError):
        read(SMALL | {"typo": 1})
    with pytest.raises(LookupError):
        read(SMALL | {"scorer": {"name": "none"}})
    (tmp_path / "c.toml").write_text('[segmenter]\nname = "block"\n[extractor]\nname = "token"\n[scorer]\nname = "frequency"\n[resolver]\nname = "exact-label"\n[relation_inducer]\nname = "co-occurrence"\n')
    assert read(tmp_path / "c.toml")["scorer"].name == "frequency"
    assert read(PROFILES["lite"])["resolver"].params == {"threshold": 0.9}
    assert Config(read(SMALL).plain()).plain() == read(SMALL).plain()
    for wrong in ({"scorer": "frequency"}, {"scorer": {"name": "frequency", "more": 1}}, {"run": {"on_error": "stop"}}, {"dataset": {"name": "toy"}}):
        with pytest.raises(ValueError):
            read(SMALL | wrong)
    with pytest.raises(ValueError, match="resolver"):
        read({k: v for k, v in SMALL.items() if k != "resolver"})
    base = SMALL | {"dataset": {"name": "toy"}, "metrics": [{"name": "label-f1"}]}
    sweep = {"base": base, "axes": {"scorer": [{"name": "frequency"}, {"name": "passthrough"}], "resolver": [{"name": "exact-label"}]}}
    assert [tuple(c[n].name for n in c) for c, _ in combinations(sweep)] == [("exact-label", "frequency"), ("exact-label", "passthrough")]
    with pytest.raises(ValueError, match="nope"):
        combinations({"base": base, "axes": {"nope": []}})


def test_toy_experiment_and_report(spark, tmp_path):
    config = read(SMALL | {"dataset": {"name": "toy"}, "metrics": [{"name": "label-f1"}, {"name": "redundancy"}], "document_metrics": [{"name": "coherence"}]}, True)
    report = run_experiment(spark, config)
    assert report["documents_processed"] == 3 and report["errors"] == 0
    assert report["metrics"]["label-f1"] == {"precision": pytest.approx(4 / 11), "recall": 1.0, "f1": pytest.approx(8 / 15)}
    write_sweep([{"axis:x": "a", "m.f1": 0.5}, {"other": 1}], tmp_path / "out")
    assert "| a | 0.5000 |" in (tmp_path / "out" / "sweep-report.md").read_text()


def taxonomy(tmp_path):
    root = tmp_path / "tax" / "lamps"
    root.mkdir(parents=True)
    terms = ["lamp", "light", "desk lamp", "oil lamp", "street light", "candle"]
    docs = [
        {"id": "lamps:glossary", "kind": "terminology", "text": "\n".join(terms)},
        {"id": "lamps:oil-lamp", "kind": "article", "term": "oil lamp", "text": "The oil lamp is a light."},
        {"id": "lamps:candle", "kind": "article", "term": "candle", "text": "At night a light such as candle or street light helps."},
    ]
    gold = [["desk lamp", "lamp"], ["oil lamp", "lamp"], ["lamp", "light"], ["street light", "light"], ["oil lamp", "light"], ["candle", "light"]]
    (root / "documents.jsonl").write_text("\n".join(map(json.dumps, docs)) + "\n")
    (root / "gold_edges.jsonl").write_text("\n".join(map(json.dumps, gold)))
    (root / "terms.txt").write_text("\n".join([*terms, "", " "]))
    return tmp_path / "tax"


@pytest.mark.parametrize("inducer, f1", [({"name": "compound"}, 2 / 3), ({"name": "hearst"}, 2 / 3), ({"name": "union", "params": {"members": [{"name": "hearst"}, {"name": "compound"}]}}, 10 / 11)])
def test_taxonomy_experiment(spark, tmp_path, inducer, f1):
    root = str(taxonomy(tmp_path))
    config = read(
        SMALL | {"extractor": {"name": "gazetteer", "params": {"root": root, "gold": "lamps"}}, "scorer": {"name": "passthrough"}, "relation_inducer": inducer, "dataset": {"name": "taxonomy", "params": {"root": root, "gold": "lamps"}}, "metrics": [{"name": "edge-f1"}]}, True
    )
    assert run_experiment(spark, config)["metrics"]["edge-f1"]["f1"] == pytest.approx(f1)


def test_readers(spark, tmp_path):
    (tmp_path / "test.jsonl").write_text("\n".join(json.dumps({"id": f"m{i}", "text": f"t{i}", "keyphrases": ["a"]}) for i in range(5)) + "\n")
    data = readers.inspec(spark, str(tmp_path), limit=3)
    assert [(r["doc_pos"], r["doc_id"], r["kind"], r["timestamp"]) for r in data.documents.orderBy("doc_pos").collect()] == [(i, f"m{i}", "abstract", float(i)) for i in range(3)]
    assert data.truth["keyphrases_by_document"].count() == 3
    (tmp_path / "dev.jsonl").write_text(json.dumps({"id": "c", "kind": "article", "text": "Paris", "mentions": [{"start": 0, "end": 5, "surface": "Paris", "cluster": "P"}]}))
    clusters = readers.mention_clusters(spark, str(tmp_path), "dev").truth["clusters_by_mention"].first()
    assert (clusters["doc_id"], clusters["span_start"], clusters["span_end"], clusters["cluster"]) == ("c", 0, 5, "P")
    with pytest.raises(FileNotFoundError, match="convert"):
        readers.inspec(spark, str(tmp_path), "none")
    assert readers.taxonomy(spark, str(taxonomy(tmp_path)), "lamps", limit=1).documents.count() == 2


def test_converters(spark):
    rows = spark.createDataFrame([(None, 4, ["a", "b"], ["x"], None)], "id string, line long, document array<string>, extractive_keyphrases array<string>, abstractive_keyphrases array<string>")
    assert tuple(converters.keyphrase_records(rows).first()) == ("doc-4", "a b", ["x"])
    turns = spark.createDataFrame([(1, 0, "I like Paris  "), (1, 1, "  "), (1, 2, "Paris!")], "dialogue_id long, turn int, utterance string")
    schema = "dialogue_id long, turn int, mention string, span_start int, span_end int, entity string"
    marks = spark.createDataFrame([(1, 0, "Paris", 7, 12, "P"), (1, 0, "Paris", 7, 12, "P"), (1, 2, "Paris", 0, 6, "P")], schema)
    record = converters.dialogue_records(turns, marks, "con-").first()
    assert record["text"] == "I like Paris\nParis!" and [(m["start"], m["end"]) for m in record["mentions"]] == [(7, 12), (13, 18)]
    for wrong in ((1, 0, "Rome", 7, 12, "P"), (1, 0, "Paris", 7, 12, "Q")):
        with pytest.raises(Exception, match="dialogue"):
            converters.dialogue_records(turns, marks.unionByName(spark.createDataFrame([wrong], schema)), "con-").collect()
    tokens = spark.createDataFrame([("1_2ecb", 0, 1, "Mr"), ("1_2ecb", 0, 2, "Fox"), ("1_2ecb", 1, 3, "ran"), ("1_2ecb", 2, 4, "off")], "doc string, sentence int, t_id int, word string")
    m = spark.createDataFrame([("1_2ecb", "7", "HUMAN_PART_PER", [1, 2]), ("1_2ecb", "8", "HUMAN_PART", [2, 1]), ("1_2ecb", "9", "ACTION", [3]), ("1_2ecb", "10", "LOC", [1, 3]), ("1_2ecb", "11", "LOC", [4]), ("1_2ecb", "12", "TIME_X", [2])], "doc string, m_id string, tag string, t_ids array<int>")
    links = spark.createDataFrame([("1_2ecb", "7", "CROSS_DOC_COREF", "5", "HUM1"), ("1_2ecb", "3", "OTHER", "6", None)], "doc string, m_id string, relation string, r_id string, note string")
    record = converters.coreference_records(tokens, m, links, spark.createDataFrame([("1_2ecb", 0), ("1_2ecb", 1)], "doc string, sentence int")).first()
    assert record["text"] == "Mr Fox\nran"
    assert [(x["start"], x["end"], x["surface"], x["cluster"]) for x in record["mentions"]] == [(0, 6, "Mr Fox", "HUM1"), (3, 6, "Fox", "1_2ecb:m12")]
    names = spark.createDataFrame([("36_4ecb",), ("4_12plus",), ("4_2ecb",)], "doc string")
    assert [r[0] for r in names.orderBy(converters.topic_order(names["doc"])).collect()] == ["4_2ecb", "4_12plus", "36_4ecb"]
    assert [r[0] for r in names.select(converters.in_test_split(names["doc"])).collect()] == [True, False, False]
    lines = spark.createDataFrame([(0, "1\tDesk Lamp "), (1, "2\tdesk lamp"), (2, " "), (3, "3\tC++!"), (4, "4\t!!"), (5, "5\tc")], "line long, value string")
    terms = converters.normalize_terms(lines)
    assert [r["term"] for r in terms.orderBy("line").collect()] == ["desk lamp", "c++!", "!!", "c"]
    taxo = converters.parse_taxonomy(spark.createDataFrame([(0, "1\tA \tB"), (1, "2\ta\tb"), (2, "")], "line long, value string"))
    assert [(r["hypo"], r["hyper"]) for r in taxo.collect()] == [("a", "b")]
    pages = spark.createDataFrame([("desk lamp", "standard", " A lamp. "), ("c++!", "standard", "A."), ("c", "standard", "B."), ("!!", "standard", "?"), ("x", "disambiguation", "no")], "term string, type string, extract string")
    records = converters.taxonomy_records("k", terms, converters.usable_extracts(pages)).orderBy("line").collect()
    assert [r["id"] for r in records] == ["k:glossary", "k:desk-lamp", "k:c", "k:term", "k:c-2"] and records[0]["text"] == "desk lamp\nc++!\n!!\nc"
    ceiling = converters.recall_ceiling(terms, spark.createDataFrame([("c", "desk lamp"), ("c", "zzz")], "hypo string, hyper string")).first()
    assert tuple(ceiling) == (1, 2)
