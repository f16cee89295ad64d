"""Merkle manifests and multiproofs against plain hashing."""

import zlib
from hashlib import sha256
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraweave.llm import merkle
from tests.llm.data import SCHEMA, rows

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def plain(data):
    """Rows (doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, source, lang, n_chars, text) rows."""
    kept = sorted(((r[2] is not None, (r[2] or "").encode(), r[0] is not None, r[0] or 0, leaf_of(r)), r) for r in data)
    groups = [[(k[-1], r) for k, r in g] for _, g in groupby(kept, key=lambda x: x[0][:2])]
    trees = [tree_of([leaf for leaf, _ in g]) for g in groups]
    top = tree_of([t[-1][0] for t in trees])
    out = []
    for g, (group, tree) in enumerate(zip(groups, trees)):
        for i, (leaf, row) in enumerate(group):
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None
            value = leaf_of((*row[:3], row[3] + 1, row[4])) if changed else leaf
            proof, folded = [], value
            for nodes, at in ((tree, i), (top, g)):
                for level in nodes[:-1]:
                    run = level[at & ~1:(at & ~1) + 2]
                    others = [x for j, x in enumerate(run) if j != at & 1]
                    proof += others
                    folded = digest(*(others + [folded] if at & 1 else [folded] + others))
                    at //= 2
            out.append((row[0], leaf, tree[-1][0], top[-1][0], digest(*proof), folded, folded == top[-1][0]))
    return out


def manifest_of(df):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.manifest(merkle.leaves(df, FIELDS, "doc_id", "lang", tampered, {"n_chars": F.col("n_chars") + 1}))


def proofs(df):
    return sorted((tuple(r) for r in merkle.prove(manifest_of(df)).collect()), key=str)


def test_all_proofs(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    want = plain([(r[0], r[3], r[2], r[4], r[1]) for r in data])
    assert proofs(df) == sorted(want, key=str)
    assert {r[-1] for r in want} == {True, False}


@pytest.mark.parametrize("shape", [(1,), (2, 1), (7, 64, 65, 1, 33)])
def test_many_levels(spark, monkeypatch, shape):
    """Blocks of eight nodes and runs of five leaves: several rounds, runs across blocks."""
    monkeypatch.setattr(merkle, "FAN", 3)
    monkeypatch.setattr(merkle, "RUN", 5)
    data = [(1000 * g + i, None, f"l{g}" if g else None, i, "t") for g, n in enumerate(shape) for i in range(n)]
    df = spark.createDataFrame(data, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    assert proofs(df) == sorted(plain(data), key=str)


def test_hot_group_and_repeated_rows(spark):
    """One group with a third of a table whose rows repeat."""
    data = [(i % 50, "s", "en" if i < 4000 else f"l{i % 90}", 1, "x") for i in range(12000)]
    df = spark.createDataFrame(data, "doc_id long, source string, lang string, n_chars long, text string").repartition(6)
    found = manifest_of(df)
    assert proofs(df) == sorted(plain(data), key=str)
    assert found.runs.agg(F.max("n")).first()[0] <= merkle.RUN


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    assert proofs(df) == []
    assert manifest_of(df).trees.count() == 0


def test_missing_is_least():
    """No node of the union can be left out, and all siblings can be derived."""
    rng = np.random.default_rng(3)
    for size in (1, 2, 3, 17, 64, 100):
        known = np.unique(rng.integers(0, size, rng.integers(1, 12)))
        need = {(level, int(i)) for level, places in merkle.missing(known, size) for i in places}
        given = {(0, int(i)) for i in known} | need
        level, n = 0, size
        while n > 1:
            on_path = {int(i) >> level for i in known}
            for i in on_path:
                assert i ^ 1 >= n or (level, i ^ 1) in given
            given |= {(level + 1, i >> 1) for i in on_path}
            level, n = level + 1, -(-n // 2)
        assert all((lv, i) not in {(lv, int(k) >> lv) for k in known} for lv, i in need)
