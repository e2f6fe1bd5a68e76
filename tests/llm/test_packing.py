import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm.packing import CAPACITY, best_fit, configurations, encoder, pack


def holds(out, texts, capacity):
    """Every text is there once, in order, whole unless longer than a container; nothing overflows. Gives containers over the least possible."""
    enc = encoder()
    n = {d: len(enc.encode_ordinary(t)) for d, t in texts if d is not None and t}
    assert set(out.doc_id) == {d for d in n if n[d]}
    for d, g in out.groupby("doc_id"):
        g = g.sort_values("piece")
        assert g.tokens.sum() == n[d] and len(g) == -(-n[d] // capacity) and (g.start == np.concatenate([[0], g.tokens.cumsum()[:-1]])).all()
    used = out.groupby("container_id").tokens.sum()
    assert used.max() <= capacity
    return len(used) / -(-sum(n.values()) // capacity)


@pytest.mark.parametrize("sf,most", [("sf0.01", 1.03), ("sf0.1", 1.01)])
def test_documents(spark, sf, most):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    assert holds(pack(docs).toPandas(), [(r.doc_id, r.text) for r in docs.collect()], CAPACITY) <= most


def test_edges(spark):
    texts = [(1, None), (2, ""), (3, "word " * 5000), (4, "a"), (5, "a"), (None, "x")] + [(10 + i, "corn " * 300) for i in range(40)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("tokens", F.lit("clash")).withColumn("rank", F.lit(1))
    holds(pack(df).toPandas(), texts, CAPACITY)
    assert pack(df.limit(0)).count() == 0
    twice = pack(df.filter("doc_id = 4").union(df.filter("doc_id = 4"))).collect()
    assert [(r.doc_id, r.container_id) for r in twice] == [(4, 0)] * 2


def test_configurations_cover_demand():
    rng = np.random.default_rng(0)
    for k in (1, 2, 7, 20):
        sizes = sorted(rng.choice(np.arange(60, 1000), k, replace=False).tolist(), reverse=True)
        demand = rng.integers(1, 400, k).tolist()
        got = configurations(sizes, demand, 1000)
        assert [sum(n * c[g] for n, c in got) for g in range(k)] == demand
        assert all(np.dot(c, sizes) <= 1000 for _, c in got)
        assert sum(n for n, _ in got) <= np.dot(sizes, demand) / 1000 * (1.9 if k < 3 else 1.2) + k


def test_best_fit_places_each_once():
    rng = np.random.default_rng(1)
    room, small = {int(r): int(rng.integers(1, 9)) for r in rng.integers(0, 300, 20)}, {int(s): int(rng.integers(1, 200)) for s in rng.integers(1, 64, 15)}
    steps, new = best_fit(room, small, 512)
    used = {}
    for s, lo, hi, own, first, each in steps:
        for t in range(lo, hi):
            used.setdefault((own, first + (t - lo) // each), []).append(s)
    assert all(sum(v) <= (512 if k[0] < 0 else k[0]) and k[1] < (new if k[0] < 0 else room[k[0]]) for k, v in used.items())
    for s, n in small.items():
        assert sorted(t for x in steps if x[0] == s for t in range(x[1], x[2])) == list(range(n))
