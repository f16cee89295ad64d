import random

from pyspark.sql import functions as F

from terraweave.operators import ordering, segment


def arrays(spark, docs):
    rows = [(d, [(i, t) for i, t in enumerate(s)]) for d, s in docs.items()]
    return spark.createDataFrame(rows, "doc_id string, sents array<struct<idx:int,text:string>>")


def test_sentences_and_repeats(spark):
    docs = spark.createDataFrame([("d", "Alpha beta one. Alpha beta one.\nGamma delta two! x. Was it so?  Alpha beta one.")],
                                 "doc_id string, text string")
    rows = segment.sentences(segment.sentence_arrays(docs)).orderBy("sent_idx").collect()
    assert [r["text"] for r in rows] == ["Alpha beta one.", "Gamma delta two!", "Was it so?", "Alpha beta one."]
    assert [r["sentence_id"] for r in rows] == [f"d_sent_{i}" for i in range(4)]
    every = segment.sentences(segment.sentence_arrays(docs, dedup=None))
    kept = segment.first_of_repeats_rows(every, "doc_id", "sent_idx", "text").orderBy("sent_idx").collect()
    assert [r["sent_idx"] for r in kept] == [0, 2, 3]      # ids keep their gaps


def test_windows_drop_tail_chunks_keep_it(spark):
    long = "sentence number %02d is long enough"
    df = arrays(spark, {"a": [long % i for i in range(7)], "b": [long % 0]})
    for size, stride in ((3, 3), (3, 2), (6, 4)):
        got = segment.windows(df, size, stride).collect()
        want = [[f"a_sent_{j}" for j in range(i, i + size)] for i in range(0, 7 - size + 1, stride)]
        assert sorted(r["sentence_ids"] for r in got) == sorted(want)
    got = {r["chunk_id"]: len(r["sentence_ids"]) for r in segment.chunks(df).collect()}
    assert got == {"a_chunk_0000": 6, "a_chunk_0001": 3, "b_chunk_0000": 1}


def test_row_windows_equal_array_windows(spark):
    long = "sentence number %02d is long enough"
    df = arrays(spark, {"a": [long % i for i in range(11)]})
    rows = segment.sentences(df)
    for size, stride in ((3, 3), (4, 1)):
        a = {(r["window_id"], r["sentence"]) for r in segment.windows(df, size, stride).collect()}
        b = {(r["window_id"], r["sentence"]) for r in segment.windows_rows(
            rows, "doc_id", "sent_idx", "text", size, stride).collect()}
        assert a == b


def test_token_budgets(spark):
    rng = random.Random(1)
    sizes = [rng.randint(1, 9) for _ in range(40)]
    df = arrays(spark, {"a": [" ".join(["w"] * n) for n in sizes]})
    chunks = [(r["first_idx"], r["n_sents"], r["n_tokens"]) for r in segment.budget_chunks(df, 12).orderBy("chunk").collect()]
    assert sum(c[1] for c in chunks) == 40
    for (a, n, t), nxt in zip(chunks, chunks[1:]):
        assert t <= 12 or n == 1
        assert t + sizes[nxt[0]] > 12                     # greedy: the next sentence did not fit
    wins = [(r["first_pos"], r["n_sents"]) for r in segment.budget_windows(df, 12, 2).orderBy("win").collect()]
    for (a, n), (b, _) in zip(wins, wins[1:]):
        assert b == a + max(1, n - 2)
    assert sum(wins[-1]) == 40


def test_spans(spark):
    df = arrays(spark, {"a": ["One two.", "Three\nfour five."]})
    b = df.select(segment.boundaries(F.col("sents"), F.col("doc_id")).alias("b"))
    to = lambda s, e, fb=True: b.select(segment.to_sentence(F.lit(s), F.lit(e), F.col("b"), fb).alias("s")).first()["s"]
    assert tuple(to(9, 14)) == ("a_sent_1", 0, 5)
    assert tuple(to(4, 99)) == ("a_sent_0", 4, 8)          # end is clamped
    assert tuple(to(8, 9)) == ("a_sent_1", -1, 0)          # the joining blank falls back to the last
    assert to(8, 9, False) is None
    toks = spark.createDataFrame([(["ab", "zz", "cd"], "ab  cd")], "t array<string>, s string")
    got = toks.select(segment.token_offsets(F.col("t"), F.col("s")).alias("o")).first()["o"]
    assert [tuple(x) for x in got] == [(0, 2), (4, 6), (6, 8)]


def test_blocked_ordering_with_a_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o long").withColumn("v", (F.col("o") % 4).cast("string"))
    pos = ordering.with_position(df, ["k"], "o", block=32).collect()
    prev = {(r["k"], r["o"]): r["prev"] for r in ordering.with_previous(df, ["k"], "o", "v", block=32).collect()}
    sums = {(r["k"], r["o"]): r["s"] for r in ordering.with_running_sum(
        df.withColumn("x", F.col("o").cast("double")), ["k"], "o", {"x": "s"}, block=32).collect()}
    by = {}
    for k, o in rows:
        by.setdefault(k, []).append(o)
    for r in pos:
        seq = by[r["k"]]
        i = seq.index(r["o"])
        assert r["pos"] == i
        assert prev[(r["k"], r["o"])] == (str(seq[i - 1] % 4) if i else None)
        assert sums[(r["k"], r["o"])] == sum(seq[:i])


def test_global_positions(spark):
    names = [f"n{(i * 7919) % 1000:04d}" for i in range(1000)]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = ordering.with_global_position(df, ["name"]).orderBy("pos").collect()
    assert [r["name"] for r in got] == sorted(names)
    assert [r["pos"] for r in got] == list(range(1000))


def test_draw_windows(spark):
    import pytest
    df = arrays(spark, {"a": ["sentence number %02d is long enough" % i for i in range(9)]})
    w = segment.windows(df, 3, 1)
    a, b = (segment.draw_windows(w, 5).orderBy("annotation_id").collect() for _ in range(2))
    assert a == b and len({r["window_id"] for r in a}) == 5
    for short in (w.limit(4), w.limit(0)):
        with pytest.raises(ValueError, match="fewer than"):
            segment.draw_windows(short, 5)


def test_null_keys_and_orders_keep_their_rows(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", None, "y"), (None, 3, "z"), (None, 3, "z")], "k string, o long, v string")
    assert ordering.with_position(df, ["k"], "o").count() == 4
    assert ordering.with_previous(df, ["k"], "o", "v").count() == 4
    assert ordering.with_running_sum(df.withColumn("one", F.lit(1.0)), ["k"], "o", {"one": "s"}).count() == 4


def test_repeats_compare_whole_lines(spark):
    lines = ["same words", "same start, other end", "same start, other end", "same words"]
    rows = [("c", t, i, line) for t in range(3000, 3002) for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "k string, t long, i int, v string").withColumn("ord", F.struct("t", "i"))
    kept = segment.drop_repeats_rows(df, "k", "ord", "v", coarse=F.floor(F.col("t") / 1024))
    got = [(r.ord.t, r.ord.i) for r in kept.orderBy("ord").collect()]
    assert got == [(3000, 0), (3000, 1), (3000, 3), (3001, 1), (3001, 3)]
