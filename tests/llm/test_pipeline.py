"""The corpus pipeline against plain Python over a small table."""

import random
import re
from collections import Counter


import corpus_pipeline
from terraweave.llm import sentence_pieces

from .data import sentence
from .test_native import repeated
from .test_pairs import shingle_set

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table():
    rng = random.Random(11)
    items = [(i, sentence(rng, 30)) for i in range(4)]
    rows = []
    for i in range(60):
        lines = [sentence(rng, 25) for _ in range(3)]
        if i % 2:
            lines.insert(1, "menu of the site that all pages of it carry")
        rows.append((i, "\n".join(lines), "en", "big" if i < 50 else "small"))
    rows[7] = (7, rows[3][1], "en", "big")
    rows[8] = (8, rows[3][1].replace("\n", "\nedited ", 1), "en", "small")
    rows[20] = (20, rows[20][1] + "\n" + items[2][1], "en", "big")
    rows[21] = (21, items[0][1].upper() + " " + rows[21][1], None, None)
    rows += [(60, None, "en", "big"), (61, "", "en", None), (62, "too short", "en", "big"), (63, "a# b$ c% " * 20, "en", "big"),
             (64, "again and again it says the same eight words " * 12, "en", "big"), (None, sentence(rng, 70), None, None)]
    rng.shuffle(rows)
    return [(*r, len(r[1] or "")) for r in rows], items


def kept_by_rules(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    n, size = len(words), len(text or "")
    return not (
        n < 20 or 100 * repeated(words) > 30 * n or 10 * sum(text.count(c) for c in "#*$%&|<>") > n
        or size < 3 * n or size > 16 * n or 10 * sum(not re.search(r"[^\W\d_]", w) for w in words) > 3 * n
        or 10 * (len(lines) - len(set(lines))) > 3 * len(lines) or 2 * sum(c.isupper() for c in text) > size)


def brute(rows, items):
    rows = [r for r in rows if kept_by_rules(r[1])]
    pages, total = Counter(), Counter(r[3] for r in rows)
    for r in rows:
        pages.update((r[3], line.strip()) for line in set(r[1].split("\n")) if line.strip())
    menu = {k for k, n in pages.items() if n >= 5 and n > 0.1 * total[k[0]]}
    rows = [(r[0], "\n".join(x for x in r[1].split("\n") if (r[3], x.strip()) not in menu), r[2], r[3]) for r in rows]
    sets = [shingle_set(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * len(sets[i] | sets[j]) and sets[i] and group[i] != group[j]:
                old = group[i]
                group = [group[j] if g == old else g for g in group]
    least = {}
    for g, r in zip(group, rows):
        if r[0] is not None:
            least[g] = min(r[0], least.get(g, r[0]))
    rows = [r for g, r in zip(group, rows) if r[0] is None or r[0] == least[g]]
    plain = lambda t: " ".join(re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+", t.lower()))
    rows = [r for r in rows if not any(plain(t) in plain(r[1]) for _, t in items)]
    return {(d, t, lang, source, len(t)) for d, t, lang, source in rows}


def test_pipeline(spark, tmp_path):
    rows, items = table()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in got} == brute(rows, items)
    assert len(got) > 30
    model = sentence_pieces.model(corpus_pipeline.public_tokenizers.path("piece_bpe_32k.model"))
    for r in got:
        assert r.round_trip and r.n_pieces == len(r.ids)
        assert sum(len(model.byte_table[i]) for i in r.ids) == len(r.text.encode()) + 1


def test_one_of_many_copies_comes_out_whole(spark, tmp_path):
    rng = random.Random(3)
    copied = "\n".join(sentence(rng, 25) for _ in range(3))
    rows = [(i, copied if i % 3 == 1 else "\n".join(["menu of the site", *(sentence(rng, 25) for _ in range(3))])) for i in range(60)]
    spark.createDataFrame([(*r, "en", "site", len(r[1])) for r in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, sentence(rng, 30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r.text for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: t.removeprefix("menu of the site\n") for i, t in rows if i % 3 != 1 or i == 1}


def test_one_row_of_a_group_stays_whatever_its_ids(spark):
    rng = random.Random(8)
    texts = [sentence(rng, 60) for _ in range(5)]
    near = lambda t, k: f"{t} end{k}"
    rows = [(None, texts[0]), (None, near(texts[0], 1)), (None, near(texts[0], 2)),  # null ids only
            (5, texts[1]), (5, near(texts[1], 1)), (9, near(texts[1], 2)),  # the smallest id twice
            (7, texts[2]), (7, texts[2]), (7, texts[2]),  # repeated rows, alone
            (None, texts[3]), (3, near(texts[3], 1)), (3, near(texts[3], 1)), (4, texts[3]),
            (6, texts[4]), (None, ""), (8, "")]
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in rows], SCHEMA).repartition(3)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert len(got) == 7 and {(7, texts[2]), (3, near(texts[3], 1)), (6, texts[4]), (None, ""), (8, "")} <= set(got)
    assert sum(d is None and t.startswith(texts[0]) for d, t in got) == 1
    assert sum(d == 5 and t.startswith(texts[1]) for d, t in got) == 1


def test_pipeline_of_nothing(spark, tmp_path):
    rows, items = table()
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "near_duplicates", "decontamination", "sentence_pieces"]
    assert corpus_pipeline.ORACLE_SQL is None
