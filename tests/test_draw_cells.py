"""Constraints in every sample, by blocks of samples and groups of constraints, against plain Python."""

import math
import random

import pytest

from terraweave.operators import diagnostics as dg, draw_cells, sampling as sm
from terraweave.operators.constraints import PARAMS

KINDS = ["near", "far", "north_of", "across", "distance_approx", "within", "on_coast", "co_occurrence", "west_of"]


def held(kind, p, q, near, target):
    d, hinge = math.dist(p, q), lambda v: max(0.0, v) ** 2
    value = {"near": hinge(d - near), "co_occurrence": hinge(d - near), "across": hinge(d - near), "far": hinge(50.0 - d),
             "north_of": hinge(q[1] + 1 - p[1]), "west_of": hinge(p[0] - q[0] + 1), "distance_approx": (d - target) ** 2 / 50}
    return value.get(kind, 0.0) < 0.1


def energy(kind, p, q, near, target):
    d, hinge = math.dist(p, q), lambda v: max(0.0, v) ** 2
    return {"near": hinge(d - near), "co_occurrence": hinge(d - near), "far": hinge(50.0 - d),
            "across": hinge(d - near) + 0.3 * hinge(q[0] + 1 - p[0]), "north_of": hinge(q[1] + 1 - p[1]),
            "west_of": hinge(p[0] - q[0] + 1), "distance_approx": (d - target) ** 2 / 50}[kind]


@pytest.fixture
def case(spark, monkeypatch):
    """Several groups and blocks, samples without some entities, ends that nobody has."""
    monkeypatch.setattr(draw_cells, "TERMS", 20)
    monkeypatch.setattr(draw_cells, "WIDTH", 16)
    rng = random.Random(5)
    ends = ["a", "b", "v0", "v1", "v2", "v3", "gone"]
    cons = [(f"c_{i:04d}", rng.choice(KINDS), rng.choice(ends), rng.choice([*ends, None]), 0.5 + i % 3,
             float(rng.randint(5, 40)), float(rng.randint(5, 40))) for i in range(150)]
    spots = {(s, f"v{e}"): (rng.uniform(-30, 30), rng.uniform(-30, 30)) for s in range(60) for e in range(4) if (s + e) % 7}
    fixed = {"a": (0.0, 5.0), "b": (-12.0, 3.0)}
    none = lambda *known: [known[0] if p == "d_near_km" else known[1] if p == "target_d_km" else None for p in PARAMS]
    table = spark.createDataFrame(
        [(*c[:5], None, *none(c[5], c[6])) for c in cons], "constraint_id string, type string, e1 string, e2 string, weight double, "
        "source_relation_id string, " + ", ".join(f"{p} double" for p in PARAMS))
    draws = spark.createDataFrame([(0, s, e, *p) for (s, e), p in spots.items()],
                                  "chain_id int, sample_id long, entity_id string, x double, y double")
    points = spark.createDataFrame([(e, e, *p) for e, p in fixed.items()], "entity_id string, name string, x double, y double")
    return cons, spots, fixed, table, draws, points


def test_scores_of_many_cells(case):
    cons, spots, fixed, table, draws, points = case
    got = {r["sample_id"]: r["score"] for r in dg.satisfaction_per_sample(table, points, draws).collect()}
    for s in range(60):
        at = lambda e: fixed.get(e) or spots.get((s, e))
        rows = [held(k, at(a), at(b) or at(a), near, target) for _, k, a, b, _, near, target in cons
                if at(a) and (b is not None or k == "on_coast")]
        assert got[s] == pytest.approx(sum(rows) / len(rows))


def test_energies_of_many_cells(spark, case):
    cons, spots, fixed, table, draws, points = case
    latent = spark.createDataFrame([(f"v{e}", "") for e in range(4)], "entity_id string, name string")
    got = {r["sample_id"]: r["energy"] for r in sm.sample_energies(table, latent, points, draws).collect()}
    for s in range(60):
        at = lambda e: fixed.get(e) or spots.get((s, e))
        want = sum(w * energy(k, at(a), at(b), near, target) for _, k, a, b, w, near, target in cons
                   if k not in ("within", "on_coast") and at(a) and at(b) and not (a in fixed and b in fixed))
        assert got[s] == pytest.approx(want, abs=1e-5)


def test_positions_are_not_multiplied_by_constraints(spark, case):
    """What is shuffled are constraints per block and positions per group, never a row per constraint and sample."""
    _, _, _, table, draws, points = case
    plan = dg.satisfaction_per_sample(table, points, draws)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (sample_id" not in plan and "CoGroup" in plan


def test_modes_inside_a_task_and_in_rounds(spark, monkeypatch):
    """Entities that fit a task stay there; larger ones go in rounds over all, to the same result."""
    rng = random.Random(2)
    rows = [(f"e{e}", rng.gauss(30 * (i % (e + 1)), 0.2), rng.gauss(0, 0.2)) for e in range(3) for i in range(60)]
    draws = spark.createDataFrame([*rows, ("e3", 1.0, 1.0), ("e3", 2.0, None)], "entity_id string, x double, y double")
    inside, rounds = [], dg._settled_rounds
    monkeypatch.setattr(dg, "_settled_rounds", lambda pts, *rest: inside.append(
        sorted(r[0] for r in pts.select("entity_id").distinct().collect())) or rounds(pts, *rest))
    got = {r["entity_id"]: r["num_modes"] for r in dg.mode_count(draws, max_k=3, starts=2).collect()}
    assert inside == [["e3"]] and [got[f"e{e}"] for e in range(3)] == [1, 2, 3]
    monkeypatch.setattr(dg, "POINTS", 10)
    assert {r["entity_id"]: r["num_modes"] for r in dg.mode_count(draws, max_k=3, starts=2).collect()} == got
    assert inside[1] == ["e0", "e1", "e2", "e3"]
