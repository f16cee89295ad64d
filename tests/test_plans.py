"""What queries over large tables must not do twice, or at all."""

import pytest

from terraweave.plans import space_queries as sq

SF = "/root/testdata/sf0.001"
plan = lambda df: df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", [sq.total_energy, sq.underconstrained, sq.constraint_graph])
def test_constraints_without_ids_are_not_numbered(spark, query):
    assert "Window" not in plan(query(spark, SF))


@pytest.mark.parametrize("query", [sq.total_energy, sq.graph_commit])
def test_relations_are_hashed_not_sorted(spark, query):
    assert "SortMergeJoin" not in plan(query(spark, SF)) and plan(query(spark, SF)).count("ShuffledHashJoin") >= 3


def test_specs_are_derived_once(spark):
    assert not [f for f in sq.penalties(spark, SF).inputFiles() if "lineitem" in f]


def test_texts_are_read_once_for_candidates(spark):
    assert not [f for f in sq.relation_candidates(spark, SF).inputFiles() if "documents" in f]


def test_numbering_without_keys_shuffles_rows_once(spark):
    from terraweave.operators.ordering import with_position
    rows = spark.range(10).selectExpr("id", "nullif(id * 40000, 0) as at")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed = with_position(rows, [], "at")
        assert plan(placed).count("Exchange hashpartitioning") <= 3  # rows, counts of the blocks, their sums
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert [r["pos"] for r in placed.orderBy("id").collect()] == list(range(10))  # the one without an order comes first


def test_sampler_model_carries_only_what_is_evaluated(spark):
    kept, _, _ = sq._model(spark, SF)
    assert "source_relation_id" not in kept.columns and not kept.where("type = 'within'").head(1)


def test_model_gets_no_more_than_its_text(spark):
    asked = sq._asked(spark, SF)
    assert set(asked.columns) == {"doc_id", "chunk", "relations", "attempts", "_error"}
    assert [f for f in asked.inputFiles() if "documents" in f]  # nothing is written in between


def test_both_schemes_read_the_same_answers(spark):
    assert len({f.rsplit("/", 2)[-2] for f in sq.score_markdown(spark, SF).inputFiles()}) == 1
