import json

import pytest
from pyspark.sql import functions as F

from terraweave.operators import extract, graph, scoring


def parsed(spark, raw, sentence="The park is near the river. The lake lies in the park."):
    df = spark.createDataFrame([(1, raw, sentence)], "id int, response string, sentence string")
    df = df.withColumn("location_relations", extract.parse_triples("response", accept_lists=True))
    rows = extract.valid_triples(extract.triple_rows(df, ["id", "sentence"]))
    return extract.first_of_equal_triples(rows, ["id"]).orderBy("ord").collect()


def t(a, cue, b, *types):
    out = {"location_1": a, "spatial_indicator": cue, "location_2": b}
    if types:
        out["semantic_type"] = list(types)
    return out


def body(*triples, key="location_relations"):
    return json.dumps({key: list(triples)})


NEAR = t("The park", "near", "the river", "DISTANCE")


@pytest.mark.parametrize("raw,n", [
    (body(NEAR), 1), (body(), 0), (body(NEAR, t("lake", "in", "park", "REGION")), 2),
    (body(NEAR, t("THE PARK", "Near", "the  RIVER", "DISTANCE")), 1), ("not json at all", 0),
    ("Sure!\n" + body(NEAR) + "\nbye", 1), (body(t("The park", "near", "")), 0), (body(t("the park", "near", "The Park")), 0),
    (body(t("The park", "near", "the moon")), 0), (json.dumps([NEAR]), 1), (body(NEAR, key="relations"), 1),
    (json.dumps({"location_relations": [], "relations": [NEAR]}), 1), ("[1, 2", 0), ("7", 0)])
def test_responses(spark, raw, n):
    assert len(parsed(spark, raw)) == n


def test_types(spark):
    get = lambda *x: parsed(spark, body(t("The lake", "in", "the park", *x)))[0]["semantic_type"]
    assert get() == ["REGION"] and get("BOGUS", "REGION") == ["REGION"] and get("region", "DISTANCE") == ["DISTANCE", "REGION"]
    bare = {**t("The lake", "in", "the park"), "semantic_type": "direction"}
    assert parsed(spark, body(bare))[0]["semantic_type"] == ["DIRECTION"]


def test_idioms_are_rejected(spark):
    s = "She was in love with the river."
    assert parsed(spark, body(t("She", "in", "love", "REGION")), s) == []


def relation(**kw):
    base = dict(relation_type="near", entity_1="West Egg", entity_1_type="LOC", entity_1_class="fictional",
                entity_2="New York", entity_2_type="GPE", entity_2_class="real", confidence="0.9",
                distance_value=None, distance_unit=None)
    return {**base, **kw}


@pytest.mark.parametrize("change,kept", [
    ({}, True), ({"relation_type": "beside"}, False), ({"entity_1": ""}, False), ({"entity_1": "X"}, False),
    ({"entity_2": "west  egg"}, False), ({"entity_2": None}, False), ({"entity_2": "None", "relation_type": "on_coast"}, True)])
def test_joint_validation(spark, change, kept):
    cols = list(relation())
    df = spark.createDataFrame([tuple(relation(**change).values())], ", ".join(f"{c} string" for c in cols))
    assert (extract.valid_relations(df).count() == 1) is kept


def test_joint_fields(spark):
    cols = list(relation())
    rows = [relation(confidence="5.0"), relation(confidence="x"), relation(confidence=None, distance_value="12.5", distance_unit="miles"),
            relation(entity_1_type="person", distance_value="far", distance_unit="leagues")]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} string" for c in cols))
    got = extract.valid_relations(df).collect()
    assert [r["confidence"] for r in got] == [1.0, 0.5, 0.5, 0.9]
    assert (got[2]["distance_value"], got[2]["distance_unit"]) == (12.5, "miles")
    assert (got[3]["entity_1_type"], got[3]["distance_value"], got[3]["distance_unit"]) == ("LOC", None, None)


def test_model_extractor_keeps_errors_in_the_row(spark):
    answer = body(NEAR)

    def make():
        def chat(system, user, temperature):
            if "boom" in user:
                raise OSError("no route")
            return answer
        return chat
    wins = spark.createDataFrame([(0, "fine"), (1, "boom")], "window_id long, sentence string")
    model = extract.ModelExtractor(make, max_retries=1, backoff=0.0, name="m")
    got = {r["window_id"]: r for r in model.attach(wins).collect()}
    assert len(got[0]["location_relations"]) == 1 and got[0]["_error"] is None
    assert got[1]["location_relations"] == [] and "no route" in got[1]["_error"]


def test_graph_degrees_and_summary(spark):
    rows = [("A", "in", "B"), ("A", "north of", "B"), ("B", "zz", "B"), (" ", "in", "B"), ("here", "12 miles from", "A")]
    df = spark.createDataFrame(rows, "location_1 string, spatial_indicator string, location_2 string").withColumn(
        "semantic_type", F.array().cast("array<string>")).withColumn("sentence_id", F.lit("s"))
    e = graph.edges(df)
    n = {r["entity"]: r for r in graph.nodes(e).collect()}
    assert sum(r["degree"] for r in n.values()) == 2 * e.count() == 8
    assert (n["B"]["in_degree"], n["B"]["out_degree"]) == (3, 1)
    assert n["here"]["entity_kind"] == "deictic" and n["A"]["entity_kind"] == "person_locus"
    s = {(r["section"], r["key"]): r["n"] for r in graph.summary(e).collect()}
    assert s[("edges", "")] == 4 and s[("nodes", "")] == 3
    assert sum(v for (sec, _), v in s.items() if sec == "rcc8") == 4
    top = graph.top_connected(graph.nodes(e), 2).orderBy("rank").collect()
    assert [r["entity"] for r in top] == ["B", "A"]
    hops = {(r["root"], r["entity"]): r["hop"] for r in graph.neighbourhood(
        e, spark.createDataFrame([("here",)], "entity string"), 2).collect()}
    assert hops == {("here", "here"): 0, ("here", "A"): 1, ("here", "B"): 2}


def test_greedy_matching(spark):
    rel = "array<struct<location_1:string,location_2:string,spatial_indicator:string,semantic_type:array<string>>>"
    r = lambda a, cue, b, *x: (a, b, cue, list(x))
    gold = [("1", [r("the big park", "in", "town", "REGION"), r("park", "in", "town")]), ("2", []), ("3", [r("a", "on", "b", "REGION")])]
    pred = [("1", [r("park", "IN", "Town", "DISTANCE"), r("big park", "in", "town"), r("x", "in", "y", "DISTANCE")]), ("2", [r("a", "on", "b")])]
    g = spark.createDataFrame(gold, f"annotation_id string, location_relations {rel}")
    p = spark.createDataFrame(pred, f"annotation_id string, location_relations {rel}")
    pairs = scoring.paired(g, p)
    o = scoring.overall(scoring.matched(pairs, "strict")).first()
    assert (o["tp"], o["fp"], o["fn"]) == (1, 3, 2)
    lenient = scoring.matched(pairs, "lenient")
    o = scoring.overall(lenient).first()
    assert (o["tp"], o["fp"], o["fn"]) == (2, 2, 1)
    hits = {r["annotation_id"]: r["hits"] for r in lenient.collect()}
    # the first prediction shares 1 of 3 tokens with gold 1, so it takes gold 2
    assert hits["1"] == [2, 1, 0]
    types = {r["semantic_type"]: (r["tp"], r["fp"], r["fn"]) for r in scoring.per_type(lenient).collect()}
    assert types == {"REGION": (1, 0, 1), "UNTYPED": (1, 1, 0), "DISTANCE": (0, 1, 0)}
    c = scoring.outcomes(lenient).first()
    assert (c["correct_empty_tp"], c["missed_empty"], c["halluc_on_empty"]) == (0, 1, 1)


def test_annotated_spans_feed_registry_and_coreference(spark):
    from terraweave.operators import entities as en, segment
    rows = [("d", [(0, "We reached Lake Avon by noon."), (1, "It was cold at Lake Avon then.")])]
    arrays = spark.createDataFrame(rows, "doc_id string, sents array<struct<idx:int,text:string>>")
    wins = segment.chunks(arrays)

    def make():
        def model(text):
            if "fail" in text:
                raise ValueError("no")
            out = [{"mention": "Lake Avon", "start": i, "end": i + 9, "label": "LOC", "cluster": 0}
                   for i in range(len(text)) if text.startswith("Lake Avon", i)]
            at = text.index("It")
            return out + [{"mention": "It", "start": at, "end": at + 2, "label": "PRON", "cluster": 0}]
        return model

    spans = extract.annotated_spans(extract.SpanAnnotator(make).attach(wins))
    got = {(r["mention"], r["sentence_id"], r["char_start"], r["char_end"]) for r in spans.collect()}
    assert got == {("Lake Avon", "d_sent_0", 11, 20), ("Lake Avon", "d_sent_1", 15, 24), ("It", "d_sent_1", 0, 2)}
    reg = en.span_registry(spans.withColumnRenamed("mention", "surface")).collect()
    assert [(r["entity_id"], r["canonical_name"], r["type"], r["mention_count"]) for r in reg] == [("e_0000", "Lake Avon", "real", 2)]
    ents = spark.createDataFrame([("Lake Avon", 0)], "canonical_name string, ord long")
    known = spark.createDataFrame([("Lake Avon", "d_sent_0")], "canonical_name string, sentence_id string")
    clusters = spans.withColumn("window", F.concat_ws("_", "doc_id", "window_id"))
    # the first mention of sentence 1 in cluster order is the name itself, so nothing is added
    assert en.propagate_coref(clusters, ents, known, "ord").count() == 0
    flipped = clusters.withColumn("pos", -F.col("pos"))
    new = en.propagate_coref(flipped, ents, known, "ord").collect()
    assert [(r["mention"], r["sentence_id"]) for r in new] == [("It", "d_sent_1")]


def test_scan_finds_what_the_cue_pattern_finds():
    import regex
    text = ("the cat in the house, a dog in front of the house; Anna to the left of an oak  near Rome north of in the the in a "
            "inside town underneath up on top of on it by by by the in front of")
    for bare in (False, True):
        plain = regex.compile("(?i)(?<!\\p{L})" + extract.cue_pattern(bare).removeprefix("(?i)"))
        fast = regex.compile(extract.scan_pattern(bare))
        for body in (text, text.upper(), text.replace(" ", "  "), text[::-1]):
            assert [m.groups() for m in fast.finditer(body)] == [m.groups() for m in plain.finditer(body)]
