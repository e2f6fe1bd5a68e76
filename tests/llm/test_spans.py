import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm.spans import MIN_CHARS, anchors, shared_chars


def by_hand(docs):
    """Marks every position of every stretch that another document holds."""
    where = {}
    for d, t in docs:
        for i in range(len(t or "") - MIN_CHARS + 1):
            where.setdefault(t[i : i + MIN_CHARS], set()).add(d)
    out = {}
    for d, t in docs:
        mark = np.zeros(len(t or ""), dtype=bool)
        for i in range(len(t or "") - MIN_CHARS + 1):
            if len(where[t[i : i + MIN_CHARS]]) > 1:
                mark[i : i + MIN_CHARS] = True
        if mark.any():
            out[d] = int(mark.sum())
    return out


def random_corpus(seed, n=40):
    rng = np.random.default_rng(seed)
    letters = list("abcdefgh \U0001f33dé\n")
    word = lambda k: "".join(rng.choice(letters, k))
    shared = [word(int(rng.integers(250, 900))) for _ in range(6)]
    docs = []
    for d in range(n):
        t = ""
        for _ in range(rng.integers(1, 6)):
            s = shared[0 if rng.random() < 0.4 else rng.integers(6)]
            a = int(rng.integers(0, 80)) if rng.random() < 0.7 else 0
            t += word(int(rng.integers(0, 300))) + (s[a : len(s) - int(rng.integers(0, 60))] if rng.random() < 0.7 else "")
        docs.append((d, t))
    return docs


@pytest.mark.parametrize("limit", [4096, 3, 8, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, limit):
    docs = random_corpus(seed) + [(900, None), (901, ""), (902, "x" * 1000), (903, "x" * 700), (904, "ab" * 500), (905, docs_tail := random_corpus(seed)[3][1]), (906, docs_tail + "z")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h", F.lit("clash"))
    assert {r.doc_id: r.shared_chars for r in shared_chars(df, group_limit=limit).collect()} == by_hand(docs)


def test_a_common_beginning_of_many(spark):
    """One prefix before many continuations, and one text that a third of the rows are."""
    rng = np.random.default_rng(8)
    word = lambda k: "".join(rng.choice(list("abcdefgh "), k))
    head, boiler = word(330), word(500)
    docs = [(i, boiler if i % 3 == 0 else head[: 60 + i] + word(400) if i % 3 == 1 else word(100) + head[i:] + word(50)) for i in range(90)]
    want = by_hand(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for limit in (5, 40):
        assert {r.doc_id: r.shared_chars for r in shared_chars(df, group_limit=limit).collect()} == want


def test_test_data(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert {r.doc_id: r.shared_chars for r in shared_chars(df).collect()} == by_hand([(r.doc_id, r.text) for r in df.collect()])


def test_long_text_and_pieces(monkeypatch):
    import sheaf.llm.spans as s

    rng = np.random.default_rng(3)
    t = "".join(rng.choice(list("abcdefghij "), 30_000))
    whole = {(int(k), int(a)) for x in anchors(["short", t, t[:5000]]) for k, a in zip(x[0], x[1])}
    monkeypatch.setattr(s, "_PIECE", 4000)
    assert {(int(k), int(a)) for x in anchors(["short", t, t[:5000]]) for k, a in zip(x[0], x[1])} == whole
    at = sorted(a for k, a in whole if k == 1)
    assert max(np.diff(at)) <= MIN_CHARS - s.PREFIX + 1


def test_empty(spark):
    assert shared_chars(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = spark.createDataFrame([(1, "q" * 400), (1, "q" * 400)], "doc_id long, text string")
    assert shared_chars(twice).count() == 0
