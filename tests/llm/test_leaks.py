import re

import numpy as np

from sheaf.llm.leaks import MIN_WORDS, WuManber, leaked_items


def by_hand(docs, items):
    split = lambda t: [w.lower() for w in re.findall(r"[^\W_]+", t)]
    out = set()
    for d, t in docs:
        if t is None or d is None:
            continue
        w = split(t)
        have = {tuple(w[i : i + MIN_WORDS]) for i in range(len(w) - MIN_WORDS + 1)}
        for i, x in items:
            v = split(x or "")
            if any(tuple(v[k : k + MIN_WORDS]) in have for k in range(len(v) - MIN_WORDS + 1)):
                out.add((d, i))
    return out


def test_wu_manber_finds_all():
    rng = np.random.default_rng(0)
    text = "".join(rng.choice(list("ab "), 3000))
    patterns = sorted({text[a : a + n] for a, n in zip(rng.integers(0, 2900, 60), rng.integers(12, 40, 60))} | {"zzzzzzzzzzzzz", "ababababababab"})
    for block in (1, 2, 5, 12):
        assert WuManber(patterns, block).occurring(text) == {k for k, p in enumerate(patterns) if p in text}
    assert WuManber([]).occurring("abc") == set()


def test_leaks(spark):
    rng = np.random.default_rng(2)
    vocab = [f"w{i}" for i in range(12)] + ["Été", "ÜBER", "x1"]
    say = lambda n: " ".join(rng.choice(vocab, n))
    items = [(i, say(int(rng.integers(5, 40)))) for i in range(30)] + [(90, None), (91, "")]
    docs = [(d, say(20) + "\n-- " + items[int(rng.integers(30))][1].upper().replace(" ", ", ") + "_" + say(5)) for d in range(60)] + [(70, None), (71, ""), (72, say(30_000)), (1, items[0][1])]
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = by_hand(docs, items)
    for block in (20_000, 7):
        got = [(r.doc_id, r.item_id) for r in leaked_items(a, b, block_items=block).collect()]
        assert set(got) == want and len(got) == len(want)
    assert leaked_items(a, b.limit(0)).count() == 0 == leaked_items(a.limit(0), b).count()


def test_test_data(spark):
    a, b = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "eval_items"))
    got = {(r.doc_id, r.item_id) for r in leaked_items(a, b).collect()}
    assert got == by_hand([(r.doc_id, r.text) for r in a.collect()], [(r.item_id, r.text) for r in b.collect()]) and got
