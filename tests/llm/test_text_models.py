"""Token store, SentencePiece and Katz."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraweave.llm import katz, sentence_pieces, token_store
from terraweave.llm.tokens import shingles, words

from .data import SCHEMA, rows

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " a  b", "a\n\n\nb  \n c", "x\x1cy !\x1c?", "<|endoftext|> hi<|endoftext|>", "it's  don't\t\tx", "  ", "a \n",
       "é ü\r\n z", "I'll 'x' \"y's\" a_b c2d …! (x)…", "ﬁx²,½!", "d́e, f́!",
       "日本。x, y \U0001f600"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(4)


def test_units_encode_like_whole_texts():
    coder = token_store.Encoder(BPE, cache_bytes=2000)
    whole = coder.tokenizer.encode_batch(ODD + [r[1] or "" for r in rows()], add_special_tokens=False)
    assert [np.frombuffer(x, coder.dtype).tolist() for x in coder.encode(ODD + [r[1] or "" for r in rows()])] == \
        [e.ids for e in whole]


@pytest.mark.parametrize("high", [3, 255, 256, 70_000, 2 ** 32 - 1])
def test_codes(high):
    rng = np.random.default_rng(high)
    ids = rng.integers(0, high, 5000, endpoint=True).astype(np.uint32)
    ids[rng.integers(0, 5000, 2000)] = 1
    codes = token_store.Codes(token_store.dac_bytes(ids))
    assert len(codes) == 5000
    assert all(codes.id_at(i) == ids[i] for i in range(0, 5000, 37))
    for lo, hi in ((0, 5000), (511, 513), (4999, 5000), (7, 7), (1024, 3000)):
        assert (codes.ids(lo, hi) == ids[lo:hi]).all()
    assert len(token_store.Codes(token_store.dac_bytes(np.zeros(0, np.uint32)))) == 0


def test_token_files(docs):
    folder, manifest = token_store.store(docs, BPE)
    found = token_store.with_global_start(token_store.digests(token_store.read_documents(docs.sparkSession, folder)), manifest)
    got = sorted(((r.doc_id, r.n_tokens, r.ids_crc32, r.start) for r in found.collect()), key=lambda r: r[3])
    coder, want = token_store.Encoder(BPE), []
    for r in docs.collect():
        ids = np.frombuffer(coder.encode([r.text or ""])[0] + np.array([2], coder.dtype).tobytes(), coder.dtype)
        want.append((r.doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
    assert sorted((g[:3] for g in got), key=str) == sorted(want, key=str)
    assert [g[3] for g in got] == np.cumsum([0, *(g[1] for g in got)])[:-1].tolist()
    ids = [g[0] for g in got]
    assert ids == [None, None, *sorted(i for i in ids if i is not None)]


def test_token_files_of_nothing(docs):
    folder, manifest = token_store.store(docs.limit(0), BPE)
    assert token_store.with_global_start(
        token_store.digests(token_store.read_documents(docs.sparkSession, folder)), manifest).count() == 0


def best_score(model, word):
    score = {p: float(s) for p, s, t in zip(model.pieces, model.scores, model.types) if t == sentence_pieces.NORMAL}
    best = [0.0] + [-math.inf] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(max(0, j - model.longest), j):
            best[j] = max(best[j], best[i] + score.get(word[i:j], -math.inf))
        best[j] = max(best[j], best[j - 1] + float(model.lowest) if word[j - 1] not in score else -math.inf)
    return best[-1]


def test_viterbi_finds_the_best_score():
    model = sentence_pieces.model(PIECES)
    some = ["▁the", "▁onanshation", "▁▁▁x", "▁z不☃q", "thereof", "▁" * 40, "a" * 70]
    for word, ids in zip(some, model.segment(some)):
        pieces, score, i = [model.pieces[x] for x in ids], 0.0, 0
        while i < len(pieces):
            if model.types[ids[i]] == sentence_pieces.BYTE:
                lead = int(pieces[i][3:5], 16)
                i += 1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4
                score += float(model.lowest)
            else:
                score, i = score + float(model.scores[ids[i]]), i + 1
        assert score == pytest.approx(best_score(model, word), rel=1e-5)
        assert b"".join(model.byte_table[x] for x in ids).decode() == word.replace("▁", " ")


def test_pieces_round_trip(docs):
    coded = sentence_pieces.decode(sentence_pieces.encode(docs, PIECES), PIECES)
    assert coded.columns == [*docs.columns, "ids", "decoded"]
    got = coded.collect()
    assert len(got) == docs.count()
    assert all(r.decoded == (r.text or "") for r in got)
    assert all(r.ids == [] for r in got if not r.text)
    odd = docs.sparkSession.createDataFrame([(x,) for x in ODD], "text string")
    assert all(r.decoded == r.text for r in sentence_pieces.decode(sentence_pieces.encode(odd, PIECES), PIECES).collect())
    assert sentence_pieces.encode(docs.limit(0), PIECES).count() == 0


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_katz(data):
    """data: (id, text, train); checks normalisation, gives (id, n_tokens, n_known, N, base, score)."""
    split = [(d, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None], tr) for d, t, tr in data]
    one, two = Counter(), Counter()
    for _, w, tr in split:
        if tr:
            one.update(w)
            two.update(zip(w, w[1:]))

    def factors(counts):
        n = Counter(counts.values())
        return katz.Discounts.from_counts([n[r] for r in range(1, 7)]).factors
    d1, d2 = factors(one), factors(two)
    cut = lambda d, r: d[r - 1] * r if r <= 5 else r
    total, kept = sum(one.values()), sum(cut(d1, r) for r in one.values())
    p1 = lambda w: cut(d1, one[w]) / (total + 1) if w in one else 1 - kept / (total + 1)
    size, mass, below = Counter(), Counter(), Counter()
    for (v, w), c in two.items():
        size[v] += c
        mass[v] += cut(d2, c)
        below[v] += p1(w)

    def p2(w, v):
        if v not in size:
            return p1(w)
        if (v, w) in two:
            return cut(d2, two[v, w]) / (size[v] + 1)
        return (1 - mass[v] / (size[v] + 1)) / (1 - below[v]) * p1(w)
    for v in list(size)[:5]:
        assert sum(p2(w, v) for w in one) + p2("never seen", v) == pytest.approx(1)
    out = []
    for d, w, _ in split:
        score = math.log10(p1(w[0])) + sum(math.log10(p2(b, a)) for a, b in zip(w, w[1:]))
        base = sum(math.log10((one[x] + 1) / (total + len(one) + 1)) for x in w)
        out.append((d, len(w), sum(x in one for x in w), total, base, score))
    return out


def test_katz_equals_brute_force(docs):
    train = F.crc32(F.coalesce(F.col("doc_id"), F.lit(0)).cast("string").cast("binary")) % 3 != 1
    scores, model = katz.learn_and_score(docs, train)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in scores.collect()), key=str)
    want = sorted(brute_katz([(r.doc_id, r.text, r.t) for r in docs.withColumn("t", train).collect()]), key=str)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want):
        assert g[4:] == pytest.approx(w[4:], rel=1e-9)
    alphas = docs.sparkSession.read.parquet(f"{model.folder}/alphas")
    assert alphas.where("alpha <= 0 or alpha is null").count() == 0


def test_unseen_pairs_are_shuffled_once_to_their_weights(docs):
    scores, _ = katz.learn_and_score(docs, F.col("doc_id") % 3 != 1)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a#" in plan and not re.search(r"hashpartitioning\(a#\d+L?, b#", plan)


def test_katz_of_nothing(docs):
    assert katz.learn_and_score(docs.limit(0), F.lit(True))[0].count() == 0
    scores = katz.learn_and_score(docs, F.lit(False))[0].collect()
    assert len(scores) == docs.count() and all(r.n_known == 0 and r.train_tokens == 0 for r in scores)


def test_discounts():
    d = katz.Discounts.from_counts([100, 40, 20, 12, 8, 5]).factors
    share = 6 * 5 / 100
    assert d[0] == pytest.approx((2 * 40 / 100 - share) / (1 - share))
    assert katz.Discounts.from_counts([0] * 6).factors == (0.5, 0.75, 1 - 0.5 / 3, 0.875, 0.9)


def test_words_and_shingles():
    texts = ["A b\tc\x0bd", None, "", "a B c d e f", "averyveryverylongword" * 50 + " x", " lead"]
    keys, bounds = words(texts)
    assert np.diff(bounds).tolist() == [4, 0, 0, 6, 2, 1]
    assert (keys[0:4] == keys[4:8]).all() and len(set(keys.tolist())) == 9
    grams, owner = shingles(texts, 5)
    assert np.bincount(owner, minlength=6).tolist() == [1, 0, 0, 2, 1, 1]


def test_unit_cache():
    """Ids come in order whether units are new, in the young or in the old generation; the bytes stay bounded."""
    from terraweave.llm.unit_cache import UnitCache

    rng = random.Random(3)
    asked = []

    def encode(units):
        asked.extend(units)
        return [np.arange(len(u), dtype="<u2") + ord(u[0]) for u in units]

    cache = UnitCache(4000, "<u2")
    for _ in range(60):
        units = ["abcdefgh"[rng.randrange(8)] * rng.randrange(1, 9) + str(rng.randrange(30)) for _ in range(rng.choice([0, 1, 90]))]
        ids, sizes = cache.encode(units, encode)
        assert ids.tolist() == [ord(u[0]) + i for u in units for i in range(len(u))] and sizes.tolist() == [len(u) for u in units]
        assert cache.young.nbytes + cache.old.nbytes < 3 * 4000
    assert len(asked) > len(set(asked)) > 100  # some left and came again
