"""N-gram join, suffix dedup and decontamination against brute force."""

import random
import re

import numpy as np
import pytest

from terraweave.llm import components, decontaminate, ngram_join, suffix_arrays, suffix_dedup
from terraweave.llm.suffix_arrays import batch_suffix_arrays, permuted_prefixes

from .data import SCHEMA, rows, sentence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(4)


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else zip(*[w[i:] for i in range(5)]))


def classes(data):
    sets = [shingle_set(t) for _, t in data]
    top = list(range(len(data)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i
    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i), d) if s else d) for i, ((d, _), s) in enumerate(zip(data, sets))), key=str)


def test_join_equals_brute_force(docs):
    got = ngram_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == classes([(r.doc_id, r.text) for r in docs.collect()])


def test_join_of_chains_and_groups(spark):
    rng = random.Random(1)
    base, data = sentence(rng, 100).split(), []
    for i in range(60):  # a chain: neighbours are near, the ends are not
        base[i] = f"new{i}"
        data.append((1000 - i, " ".join(base)))
    near = sentence(rng, 300).split()
    for i in range(60):
        words = list(near)
        words[rng.randrange(300)] = f"w{i}"
        data.append((i, " ".join(words)))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = ngram_join.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == classes(data)


def test_join_of_nothing(docs):
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0
    assert ngram_join.near_duplicates(docs.where("text is null")).count() == 2


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 100), (7, 7)], "a long, b long")
    got = {r.id: r.comp for r in components.components(links).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[200] == 100


def removed(data):
    first, out = {}, []
    ranked = [(2 ** 63 - 1 if d is None else d, (t or "").encode()) for d, t in data]
    for d, b in ranked:
        for i in range(len(b) - 49):
            first[b[i:i + 50]] = min(d, first.get(b[i:i + 50], d))
    for (d, b), (key, _) in zip(ranked, data):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i:i + 50]] < d:
                gone[i:i + 50] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((key, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), kept))
    return sorted(out, key=str)


def test_suffix_dedup_equals_brute_force(docs):
    got = suffix_dedup.remove(suffix_dedup.mark(docs)).collect()
    want = removed([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str) == want
    assert sum(w[2] for w in want) > 1000


def test_suffix_dedup_of_periodic_texts(spark):
    data = [(1, "ab" * 60), (2, "ab" * 30 + "z" + "ab" * 24), (3, "a" * 49), (4, "a" * 49), (5, "q" * 200), (6, "q" * 50 + "b"),
            (7, "é" * 25), (8, "é" * 26)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = suffix_dedup.remove(suffix_dedup.mark(df)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str) == removed(data)
    assert suffix_dedup.remove(suffix_dedup.mark(df.limit(0))).count() == 0


@pytest.mark.parametrize("letters, longest", [(1, 30), (2, 14), (3, 40), (26, 60)])
def test_suffix_arrays(letters, longest):
    rng = random.Random(letters)
    strings = [[rng.randint(1, letters) for _ in range(rng.randint(0, longest))] + [0] for _ in range(150)]
    sizes = np.array([len(s) for s in strings])
    text = np.zeros((len(strings), sizes.max()), np.int64)
    for i, s in enumerate(strings):
        text[i, :len(s)] = s
    sa = batch_suffix_arrays(text, sizes)
    common = permuted_prefixes(text, sa, 9)
    for i, s in enumerate(strings):
        order = sorted(range(len(s)), key=lambda k: s[k:])
        assert sa[i, :len(s)].tolist() == order
        for a, b in zip(order, order[1:]):
            n = next((k for k in range(9) if s[a + k:a + k + 1] != s[b + k:b + k + 1] or a + k >= len(s)), 9)
            assert common[i, b] == n


def test_wide_strings_are_sorted_to_depth(monkeypatch):
    rng = random.Random(8)
    strings = [[rng.randint(1, 3) for _ in range(rng.randint(1, 300))] + [0] for _ in range(20)]
    sizes = np.array([len(s) for s in strings])
    text = np.zeros((20, sizes.max()), np.int64)
    for i, s in enumerate(strings):
        text[i, :len(s)] = s
    monkeypatch.setattr(suffix_arrays, "WIDE", 10)
    sa = suffix_arrays.sorted_suffixes(text, sizes, 9)
    for i, s in enumerate(strings):
        got = [s[k:k + 9] for k in sa[i, :len(s)]]
        assert got == sorted(got) and sorted(sa[i, :len(s)]) == list(range(len(s)))


def plain_alignment(a, b):
    grid, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            grid[i][j] = max(0, grid[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), grid[i - 1][j] - 1, grid[i][j - 1] - 1)
            best = max(best, grid[i][j])
    return best


def test_alignment():
    rng = random.Random(4)
    pick = lambda n: np.array([rng.randint(2, 8) for _ in range(rng.randint(1, n))], np.uint64)
    a, b = [pick(20) for _ in range(50)], [pick(45) for _ in range(50)]
    scores, ends = decontaminate.smith_waterman(a, b)
    assert scores.tolist() == [plain_alignment(x.tolist(), y.tolist()) for x, y in zip(a, b)]
    for x, y, s, e in zip(a, b, scores, ends):
        assert plain_alignment(x.tolist(), y[:e].tolist()) == s


def test_leaks(spark):
    rng = random.Random(9)
    items = [(i, sentence(rng, 30)) for i in range(8)] + [(8, "too short"), (9, None), (None, sentence(rng, 30))]
    edited = items[1][1].split()
    for i in range(4, 30, 6):
        edited[i] = "other"
    half = " ".join(items[2][1].split()[:10])
    docs = [(1, sentence(rng, 50) + "\n" + items[0][1].upper() + "! " + sentence(rng, 500)),
            (2, sentence(rng, 20) + " ".join(["", *edited, ""]) + sentence(rng, 20)), (3, half + sentence(rng, 80)),
            (4, sentence(rng, 400)), (5, None), (6, ""), (None, items[3][1]), (7, items[0][1] + " " + items[4][1]),
            (1, "same id, clean")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(df, bench).collect()}
    assert set(got) == {(1, 0), (2, 1), (None, 3), (7, 0), (7, 4)}
    assert got[1, 0] == 1 and 0.5 <= got[2, 1] < 1
    assert {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(df, bench, block_keys=40).collect()} == got
    clean = decontaminate.keep_clean(df, bench)
    assert sorted(r.doc_id for r in clean.collect()) == [3, 4, 5, 6] and clean.columns == df.columns
    assert decontaminate.leaks(df.limit(0), bench).count() == 0
    assert decontaminate.keep_clean(df, bench.limit(0)).count() == len(docs)


def test_an_edited_copy_beside_an_exact_one(spark):
    """Every score that plain alignment of whole documents reaches is found, whatever other documents hold."""
    rng = random.Random(4)
    items = [(i, sentence(rng, 15 + 12 * (i % 3))) for i in range(30)] + [(0, sentence(rng, 20)), (0, sentence(rng, 25))]
    docs, near = [], []
    for k, (_, text) in enumerate(items):
        own = text.split()
        docs.append((2 * k, text))
        for i in sorted(rng.sample(range(len(own)), len(own) // 3), reverse=True):
            own[i:i + 1] = [f"new{i}"] if k % 4 else [own[i], f"new{i}"] * (1 + (k % 8 == 4 and i % 2))
        near.append((2 * k + 1, sentence(rng, 9) + " " + " ".join(own) + " " + sentence(rng, 9)))
    docs += near + [(1000 + i, t) for i in range(5) for _, t in near]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    grams = lambda w: set(zip(w, w[1:], w[2:]))
    split = lambda t: t.lower().split()
    for d, text in docs:
        for i, item in items:
            a, b = split(item), split(text)
            if grams(a) & grams(b) and (score := plain_alignment(a, b)) >= len(a):
                want[d, i] = max(want.get((d, i), 0), score / (2 * len(a)))
    assert sum(d % 2 for d, _ in want if d < 1000) > 15
    assert {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(df, bench).collect()} == want


def test_fragments_find_shared_keys_in_bounded_memory():
    import tracemalloc

    import numpy as np

    from terraweave.llm.shared_keys import _shared

    rng = np.random.default_rng(4)
    few = [(np.arange(5) + 10 * i, rng.integers(0, 40, 30).astype("<u4"), rng.choice([0, 1, 2, 3, 4, 65535], 30).astype("<u2"))
           for i in range(4)]
    rows = [(int(k), None if o == 65535 else int(table[o])) for table, keys, owner in few for k, o in zip(keys, owner)]
    times = {k: sum(1 for other, _ in rows if other == k) for k, _ in rows}
    ids, doc, low = _shared(few)
    assert sorted(zip(low.tolist(), ids[doc].tolist())) == sorted((k, i) for k, i in rows if i is not None and times[k] > 1)
    n = 1 << 16
    many = [(np.arange(300) + 300 * i, rng.integers(0, 1 << 32, n).astype("<u4"), rng.integers(0, 300, n).astype("<u2")) for i in range(32)]
    tracemalloc.start()
    _shared(many)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * n * 32


def test_anchor_keys_are_dealt_evenly_to_fragments():
    import numpy as np

    from terraweave.llm.shared_keys import _fragment

    keys = suffix_dedup.anchors([np.random.default_rng(5).bytes(1 << 18)], 50)[2]
    held = np.bincount(_fragment(keys, 16).astype(int), minlength=16)
    assert held.max() < 2 * held.min()


def test_shared_keys_are_listed_in_one_row_per_document(spark):
    import numpy as np

    from terraweave.llm.shared_keys import codes, shared_lists
    from terraweave.llm.tokens import shingles

    one = " ".join(f"w{i}" for i in range(60))
    texts = [one, one + " x", "alone in the world", one + " y z", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "uid long, text string").repartition(3)
    got = {r.uid: r.codes for r in shared_lists(rows, lambda t: shingles(t, 5), 7).collect()}
    assert shared_lists(rows, lambda t: shingles(t, 5), 7).count() == len(got) == 3
    want = np.unique(codes(shingles([one], 5)[0], 7))
    assert all(np.array_equal(np.unique(np.frombuffer(got[i], "<u8")), want) for i in (0, 1, 3))


def test_batches_to_workers_are_of_bounded_bytes(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    from terraweave.llm.common import BATCH_BYTES, bounded_batches
    from terraweave.session import cut

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    rows = spark.range(0, 64, 1, 1).select(F.repeat(F.lit("x"), 1 << 18).cast("binary").alias("packed"))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    with bounded_batches(spark):
        got = cut(rows.mapInArrow(sizes, "n long"))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
    assert got.agg(F.sum("n")).first()[0] >= 64 << 18
    assert got.agg(F.max("n")).first()[0] <= BATCH_BYTES + (2 << 18)
