import json
import os

import pytest
from pyspark.sql import functions as F

from terraweave import cli
from terraweave.plans import flows
from terraweave.session import shared_dir
from terraweave.sources import readers, writers
from terraweave.streaming import incremental as inc

TEXT = ("*** START OF THE PROJECT GUTENBERG EBOOK T ***\n" + " ".join(
    f"The Hotel near Avon was {w} and West Egg by New York stayed quiet. Avon north of West Egg kept the ferry. "
    f"We drove along New York through Avon on day {w}." for w in ("one", "two", "three", "four", "five"))
    + "\n*** END OF THE PROJECT GUTENBERG EBOOK T ***\n")


def scratch_tables(spark):
    folder = os.path.join(shared_dir(spark), "lineage")
    return sorted(os.listdir(folder)) if os.path.isdir(folder) else []


def joined(path):
    parts = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    return "".join(open(os.path.join(path, f), encoding="utf-8").read() for f in parts)


def test_text_to_graph(spark, tmp_path):
    src = tmp_path / "The Text.txt"
    src.write_text(TEXT, encoding="utf-8")
    cleaned = flows.ingest(spark, str(src), str(tmp_path / "cleaned"))
    sents = readers.read_sentences(spark, cleaned).collect()
    assert len(sents) == 15 and sents[0]["doc_id"] == "the_text"
    out = str(tmp_path / "rel")
    flows.extract_windows(spark, cleaned, out, limit=3)
    flows.extract_windows(spark, cleaned, out, resume=True)
    done = spark.read.json(out)
    assert done.count() == 5 and done.select("window_id").distinct().count() == 5
    flows.extract_windows(spark, cleaned, out, resume=True)     # nothing left to do
    assert spark.read.json(out).count() == 5
    report = flows.build_graph(spark, out, str(tmp_path / "g"), "g", top_k=3)
    assert report["edges"] == sum(report["rcc8_distribution"].values()) == sum(report["cdc_distribution"].values())
    assert report["nodes"] == sum(report["entity_kind_distribution"].values()) and len(report["top_connected"]) == 3
    dot = joined(tmp_path / "g" / "g.dot").splitlines()
    assert dot[0] == "digraph terraweave {" and dot[-1] == "}" and len(dot) == 5 + report["nodes"] + report["edges"]
    import xml.etree.ElementTree as et
    g = et.fromstring(joined(tmp_path / "g" / "g.graphml"))
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    assert len(g.findall(f".//{ns}node")) == report["nodes"] and len(g.findall(f".//{ns}edge")) == report["edges"]
    assert joined(tmp_path / "g" / "g.html").count("edge({") == report["edges"]
    assert json.load(open(tmp_path / "g" / "g.summary.json"))["edges"] == report["edges"]


def test_staged_run(spark, tmp_path):
    left = scratch_tables(spark)
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "the_text.txt").write_text(TEXT, encoding="utf-8")
    gaz = tmp_path / "gaz.jsonl"
    gaz.write_text("\n".join(json.dumps(dict(name=n, rank=0, lat=a, lon=b, display_name="US")) for n, a, b in [
        ("York", 40.7, -74.0), ("Avon", 40.9, -73.5), ("New", 40.71, -74.1)]))
    cfg = {"data_dir": str(tmp_path / "data"), "corpus": {"raw_dir": str(raw)}, "ner": {"fictional_overrides": ["Egg", "West"]},
           "grounding": {"gazetteer": str(gaz)}, "inference": {"sweeps": 4, "burn_in": 1, "thin": 1, "num_chains": 2}}
    flows.run_stages(spark, cfg)
    load = lambda n: spark.read.parquet(str(tmp_path / "data" / n))
    assert load("sentences").select("doc_id").first()[0] == "text"
    ents = {r["canonical_name"]: r["type"] for r in load("grounded").collect()}
    assert ents["Avon"] == "real"
    assert load("latent").count() >= 1 and load("constraints").count() >= 1
    assert scratch_tables(spark) == left  # nothing that a stage cut stays behind
    post = load("posterior").collect()
    assert len(post) == load("latent").count()
    assert all(r["semi_major"] >= r["semi_minor"] >= 0 for r in post)
    assert joined(tmp_path / "data" / "plots" / "constraints.dot").startswith("graph Constraints {")
    with pytest.raises(ValueError):
        flows.run_stages(spark, cfg, only=99)
    known = {r["key"]: (r["lat"], r["seen"]) for r in load("geocode_cache").collect()}
    assert known["avon"][0] == 40.9 and all(k not in known for k in ("egg", "west"))
    assert load("acceptance").where("chain_id = 0").agg(F.sum("sweeps")).first()[0] == 5
    log = load("run_log").orderBy("number").collect()
    assert [r["stage"] for r in log] == [name for name, _ in flows.STAGES] and {r["status"] for r in log} == {"complete"}
    # a second run looks up nothing: with an empty gazetteer it finds the same places
    before = {tuple(r) for r in load("grounded").collect()}
    gaz.write_text(json.dumps(dict(name="Nowhere", rank=0, lat=0.0, lon=0.0, display_name="US")))
    flows.ground(flows.Run(spark, cfg, force=True))
    assert {tuple(r) for r in load("grounded").collect()} == before
    assert {r["key"]: (r["lat"], r["seen"]) for r in load("geocode_cache").collect()} == known


def test_annotated_spans_with_clusters(spark, tmp_path):
    span = "doc_id string, chunk long, pos long, label string, surface string, sentence_id string, char_start int, char_end int, source_text string"
    rows = [("d", 0, 0, "LOC", "Lake Avon", "d_sent_0", 3, 12, "x"), ("d", 1, 0, "LOC", "Lake  Avon", "d_sent_1", 0, 10, "x"),
            ("d", 1, 1, "PER", "Tom", "d_sent_1", 20, 23, "x"), ("d", 1, 2, "GPE", "Oldham", "d_sent_2", 0, 6, "x"),
            ("d", 1, 3, "GPE", "Oldham", "d_sent_3", 0, 6, "x"), ("d", 2, 0, "LOC", "Latecome Hill", "d_sent_4", 0, 13, "x"),
            ("d", 2, 1, "LOC", "Blocked Hill", "d_sent_5", 0, 12, "x"), ("d", 2, 2, "LOC", "Blocked Hill", "d_sent_6", 0, 12, "x")]
    cluster = "doc_id string, chunk long, cluster int, pos long, mention string, sentence_id string, char_start int, char_end int"
    members = [("d", 1, 0, 0, "it", "d_sent_1", 30, 32), ("d", 1, 0, 1, "the lake avon shore", "d_sent_1", 40, 59),
               ("d", 1, 0, 2, "LAKE AVON", "d_sent_2", 10, 19), ("d", 1, 0, 3, "there", "d_sent_2", 30, 35), ("d", 1, 0, 4, "there", "d_sent_2", 30, 35),
               ("d", 0, 7, 0, "oldham", "d_sent_0", 20, 26), ("d", 0, 7, 1, "that town", "d_sent_0", 30, 39),  # named later only
               ("d", 2, 1, 0, "nothing known", "d_sent_4", 20, 33), ("d", 2, 2, 0, "Oldham", "d_sent_2", 0, 6), ("d", 2, 2, 1, "the town", "d_sent_3", 0, 6)]
    data = tmp_path / "data"
    spark.createDataFrame(rows, span).write.parquet(str(data / "spans"))
    spark.createDataFrame(members, cluster).write.parquet(str(data / "span_clusters"))
    flows.annotated(flows.Run(spark, {"data_dir": str(data), "ner": {"entity_blocklist": ["Blocked Hill"]}}))
    ents = {r["canonical_name"]: (r["entity_id"], r["mention_count"], r["doc_count"]) for r in spark.read.parquet(str(data / "span_entities")).collect()}
    # "it", "the lake avon shore" and one "there" join two spans; "the town" lies where Oldham is named already
    assert ents == {"Lake Avon": ("e_0000", 5, 1), "Oldham": ("e_0001", 2, 1)}
    new = {(r["canonical_name"], r["sentence_id"], r["char_start"]) for r in spark.read.parquet(str(data / "span_mentions")).collect()
           if "coref" in r["source_text"]}
    assert new == {("Lake Avon", "d_sent_1", 30), ("Lake Avon", "d_sent_1", 40), ("Lake Avon", "d_sent_2", 30)}


def test_readers(spark, tmp_path):
    (tmp_path / "latin.txt").write_bytes("Café".encode("latin-1"))
    (tmp_path / "bom.txt").write_bytes(b"\xef\xbb\xbfhi")
    got = {r["doc_id"]: r["text"] for r in readers.read_texts(spark, str(tmp_path / "*.txt")).collect()}
    assert got == {"latin": "Café", "bom": "﻿hi"}
    bad = readers.read_texts(spark, str(tmp_path / "latin.txt"), replace=True).first()["text"]
    assert bad == "Caf�"
    f = tmp_path / "rows.jsonl"
    f.write_text('{"doc_id":"d","sentence_id":"d_sent_0","text":"a"}\n\n{"doc_id":"d"}\n')
    assert readers.read_jsonl(spark, str(f), readers.SENTENCE, ["text"]).count() == 1
    f.write_text('{"doc_id":\n')
    with pytest.raises(Exception, match="(?i)malformed|json"):
        readers.read_jsonl(spark, str(f), readers.SENTENCE).collect()
    with pytest.raises(FileNotFoundError):
        readers.read_jsonl(spark, str(tmp_path / "none.jsonl"), readers.SENTENCE)
    f.write_text('{"window_id":1,"sentence_ids":["s1","s2"],"sentence":"x","location_relations":[{"location_1":"A"}]}\n'
                 '{"window_id":2,"sentence_id":"s9","location_relations":[{"location_1":"B"}]}\n')
    assert [r["sentence_id"] for r in readers.read_relations(spark, str(f)).orderBy("location_1").collect()] == ["s1", "s9"]
    f.write_text('{"window_id":1,"entity_1":"x"}\n')
    with pytest.raises(Exception, match="location_relations"):
        readers.read_relations(spark, str(f)).collect()
    f.write_text('{"doc_id":"d","window_id":1}\n{"doc_id":"d","wind')
    assert readers.read_done(spark, str(f)).count() == 1


def test_overwrite_or_skip(spark, tmp_path):
    out = str(tmp_path / "o")
    writers.write_jsonl(spark.range(2), out)
    writers.write_jsonl(spark.range(5), out, overwrite=False)
    assert spark.read.json(out).count() == 2
    pages = readers.read_pdfs(spark, out, lambda body: ["one", "two"]).first()
    assert pages["text"] == "one\n\ntwo"


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    docs = lambda a, b: spark.createDataFrame([(i, f"The old mill near town {i} stood. It was by the river in spring. "
                                                "Nobody went there after the flood.") for i in range(a, b)], "doc_id long, text string")
    docs(0, 3).write.parquet(src)
    schema = docs(0, 1).schema
    for lo, hi in ((3, 5), (5, 5)):
        inc.extract_triples(inc.stream_of(spark, src, schema), out, ck).awaitTermination()
        if hi > lo:
            docs(lo, hi).write.mode("append").parquet(src)
    got = spark.read.parquet(out)
    assert got.count() == got.select("doc_id").distinct().count() == 5
    rec, rck = str(tmp_path / "rec"), str(tmp_path / "rck")
    for _ in range(2):
        inc.recent_buffer(inc.stream_of(spark, src, schema, 1).select("doc_id"), 2, ["doc_id"], rec, rck).awaitTermination()
    assert sorted(r[0] for r in inc.latest(spark, rec).collect()) == [3, 4]


def test_sample_and_score(spark, tmp_path):
    sents = tmp_path / "s.jsonl"
    sents.write_text("\n".join(json.dumps(dict(doc_id="d", sentence_id=f"d_sent_{i}", text=f"Sentence {i} is by the mill in town."))
                               for i in range(9)))
    cli.sample(spark, str(sents), str(tmp_path / "gold"), 4, 3, 42, 20)
    gold = spark.read.json(str(tmp_path / "gold"))
    assert sorted(r[0] for r in gold.select("annotation_id").collect()) == [f"ann_{i:03d}" for i in range(4)]
    rel = [{"location_1": "mill", "spatial_indicator": "in", "location_2": "town", "semantic_type": ["REGION"]}]
    rows = lambda k: "\n".join(json.dumps({"annotation_id": f"ann_{i:03d}", "location_relations": rel if i < k else []}) for i in range(4))
    (tmp_path / "g.jsonl").write_text(rows(3))
    (tmp_path / "m.jsonl").write_text(rows(2))
    got = {r["scheme"]: r for r in cli.score(spark, str(tmp_path / "g.jsonl"), [str(tmp_path / "m.jsonl")], str(tmp_path / "o"))}
    assert (got["strict"]["tp"], got["strict"]["fp"], got["strict"]["fn"]) == (2, 0, 1)
    assert "| m | lenient | 1.000 | 0.667 | 0.800 | 2 | 0 | 1 |" in open(tmp_path / "o" / "scores.md").read()


def scripted(log, dead):
    """A client factory that answers from a script and fails where it is told to; calls go to a file, as tasks are processes of their own."""
    def make():
        def chat(system, user, temperature):
            with open(log, "a", encoding="utf-8") as out:
                out.write(json.dumps([user[:40], round(temperature, 2), "nothing before" in system]) + "\n")
            if "slow" in user and temperature < 0.12:
                raise TimeoutError("slow")
            if dead and dead in user:
                raise OSError("no route")
            facts = [dict(entity_1="Avon", entity_1_type="gpe", entity_1_class="Real", relation_type="north_of", entity_2="West Egg",
                          entity_2_class="fictional", confidence=0.8, distance_value=12, distance_unit="miles"),
                     dict(entity_1="Avon", relation_type="beside", entity_2="West Egg"),
                     dict(entity_1="New York", relation_type="near", entity_2="Avon", confidence="0.2")]
            return "Here:\n" + json.dumps({"relations": facts if "Avon" in user else []})
        return chat
    return make


def test_joint_extraction_with_dead_letters(spark, tmp_path):
    from terraweave.sources import chat
    raw = tmp_path / "raw"
    raw.mkdir()
    lines = [f"Avon lies north of West Egg on day {i}{'. It is slow' if i == 2 else ''}." for i in range(6)] + ["The blocked road led nowhere that day."] * 1
    (raw / "book.txt").write_text(" ".join(lines), encoding="utf-8")
    cfg = {"data_dir": str(tmp_path / "data"), "corpus": {"raw_dir": str(raw)},
           "relations": {"model": {"sentences_per_chunk": 2, "chunk_overlap": 0, "min_confidence": 0.55}}}
    load = lambda n: spark.read.parquet(str(tmp_path / "data" / n))
    model = lambda dead: chat.relation_model(scripted(str(tmp_path / "log"), dead), backoff=0.0, max_attempts=2)
    run = flows.Run(spark, cfg, extractor=model("blocked"))
    flows.clean(run)
    flows.joint(run)
    dead = load("failed_chunks").collect()
    assert len(dead) == 1 and dead[0]["runs"] == 1 and dead[0]["attempts"] == 2 and "no route" in dead[0]["last_error"]
    rows = load("candidates").collect()
    assert rows and {(r["entity_1"], r["relation_type"], r["entity_2"], r["entity_1_type"], r["entity_1_class"], r["entity_2_class"],
                      r["confidence"], r["distance_value"], r["distance_unit"]) for r in rows} == {
        ("Avon", "north_of", "West Egg", "GPE", "real", "fictional", 0.8, 12.0, "miles")}
    assert {r["canonical_name"]: r["type"] for r in load("entities").collect()} == {"Avon": "real", "West Egg": "fictional"}
    history = [a for r in load("joint_answers").collect() if r["_error"] is None for a in r["attempts"]]
    assert any(a["attempt"] == 1 and a["strict"] and a["temperature"] == pytest.approx(0.15) for a in history)  # the slow chunk
    calls = [json.loads(x) for x in open(tmp_path / "log", encoding="utf-8")]
    n = load("joint_answers").count()
    flows.joint(flows.Run(spark, cfg, extractor=model(None)))  # a later run asks for the dead letter alone
    more = [json.loads(x) for x in open(tmp_path / "log", encoding="utf-8")][len(calls):]
    assert len(more) == 1 and load("joint_answers").count() == n + 1
    assert load("failed_chunks").count() == 0 and load("candidates").count() == len(rows) + 1
    flows.joint(flows.Run(spark, cfg, extractor=model(None)))  # nothing left to ask
    assert load("joint_answers").count() == n + 1
