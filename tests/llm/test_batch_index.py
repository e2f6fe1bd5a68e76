import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm.batch_index import BatchIndex, below, repeats, segments, substrings, within

SCHEMA = "row_id long, batch_id int, article_id string, title string, gkg_date timestamp"


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        e, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            e, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, e + (x != y))
    return d[-1]


def by_hand(rows):
    split = lambda t: None if t is None else [w.lower() for w in re.findall(r"[^\W_]+", t)]
    key = lambda x: re.sub(r"[\W_]+", "", (x or "").lower().replace("ß", "ss"))
    cut = [(r[0], r[1], key(r[2]), split(r[3]), r[4]) for r in rows]
    out = set()
    for r, b, k, w, at in cut:
        for _, b2, k2, w2, at2 in cut:
            if b is not None and b2 is not None and b2 < b and ((k and k == k2) or (None not in (w, w2, at, at2) and abs(at - at2) <= timedelta(hours=240) and abs(len(w) - len(w2)) <= 2 and distance(w, w2) <= 2)):
                out.add(r)
                break
    return out


def corpus(seed, n=220):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(9)]
    base = [list(rng.choice(vocab, int(rng.integers(0, 12)))) for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(base[0 if rng.random() < 0.35 else rng.integers(12)])
        for _ in range(rng.integers(0, 5)):
            at = int(rng.integers(0, len(w) + 1))
            w[at : at + int(rng.integers(0, 2))] = list(rng.choice(vocab, int(rng.integers(0, 2))))
        t = " ".join(w) if rng.random() < 0.5 else ("  ".join(w)).upper() + " !"
        day = datetime(2023, 1, 1) + timedelta(hours=int(rng.integers(0, 24 * 90)))
        rows.append((i, int(rng.integers(1, 14)) if rng.random() < 0.97 else None, f"ID-{i}" if rng.random() < 0.8 else (None if rng.random() < 0.3 else f"{{id {rng.integers(n)}}}"), t if rng.random() < 0.95 else None, day if rng.random() < 0.97 else None))
    return rows + rows[:3]


@pytest.mark.parametrize("seed,hot", [(1, 1000), (2, 1000), (3, 4), (4, 2), (5, 8)])
def test_against_brute_force(spark, seed, hot):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("tk", F.lit("clash")).withColumn("words", F.lit(1))
    got = [r.row_id for r in repeats(df, hot=hot, per_load=100).collect()]
    assert set(got) == by_hand(rows) and len(got) == len(set(got))


def test_several_batches_a_load(spark, per_load=5):
    rows = corpus(8, 120)
    got = [r.row_id for r in repeats(spark.createDataFrame(rows, SCHEMA), per_load=per_load, hot=6).collect()]
    assert set(got) == by_hand(rows) and len(got) == len(set(got))


def test_batches_one_by_one_in_new_sessions(spark, tmp_path):
    rows = [r for r in corpus(7, 120) if r[1] is not None]
    df = spark.createDataFrame(rows, SCHEMA)
    index, got = BatchIndex(spark, f"{tmp_path}/index"), set()
    for b in (4, 8, 13):
        got |= {r.row_id for r in index.load(df.filter((F.col("batch_id") <= b) & (F.col("batch_id") > b - 5))).collect()}
        (tmp_path / "index" / "ids" / f"load={b}").mkdir(exist_ok=True)  # as a failed load would leave it
        index = BatchIndex.open(spark, f"{tmp_path}/index")
    assert got == by_hand(rows)
    index.drop()
    assert not (tmp_path / "index").exists()


def test_work_follows_the_batch_not_the_history(spark, tmp_path):
    def rows_read(months):
        index = BatchIndex(spark, f"{tmp_path}/h{months}")
        history = [(i, 1, f"a{i}", f"story {i} of the {i % 7} mills", datetime(2020, 1, 1) + timedelta(days=30 * (i % months))) for i in range(200 * months)]
        index.load(spark.createDataFrame(history, SCHEMA))
        index.load(spark.createDataFrame([(10**6, 2, "new", "story 0 of the 0 big mills", datetime(2020, 1, 2))], SCHEMA))
        used = index.segments.read().filter("load <= 2").filter(F.col("g").isin([r.g for r in index.segments.read().filter("load = 2").select("g").distinct().collect()])).count()
        return used, index.segments.read().count()

    (small, all_small), (large, all_large) = rows_read(4), rows_read(16)
    assert small == large and all_large > 3 * all_small


def test_empty(spark):
    assert repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_title(spark):
    t = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, 1, None, t, datetime(2023, 1, 1)), (2, 2, None, t + " y z", datetime(2023, 1, 2)), (3, 3, None, t + " y z u v w", datetime(2023, 1, 2))]
    assert {r.row_id for r in repeats(spark.createDataFrame(rows, SCHEMA)).collect()} == {2}


def test_segments_meet():
    rng = np.random.default_rng(0)
    for _ in range(3000):
        a = list(rng.integers(0, 4, int(rng.integers(1, 9))))
        b = list(a)
        for _ in range(rng.integers(0, 3)):
            at = int(rng.integers(0, len(b) + 1))
            b[at : at + int(rng.integers(0, 2))] = list(rng.integers(0, 4, int(rng.integers(0, 2))))
        assert within(list(map(str, a)), list(map(str, b))) == (distance(a, b) <= 2)
        if len(a) <= len(b) and max(len(a), len(b)) > 2 and distance(a, b) <= 2:
            segs = segments(len(a))
            met = [(i, p) for i, p, q in substrings(len(b), len(a)) if b[p:q] == a[segs[i][0] : segs[i][1]]]
            assert met
            deeper = False
            for i, p in met:
                used = [(*segs[i], p)]
                rest = max(len(a), len(b)) - (segs[i][1] - segs[i][0])
                deeper |= rest <= 2 or any(b[q : q + e - s] == a[s:e] for _, s, e, starts in below(len(a), len(b), used) for q in starts)
            assert deeper
