import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from sheaf.llm.scans import HEADERS, REPEATED, Editor, Perceptron, Sketch, Tagger, as_number, break_features, doubtful, groups, header, laid_out, letters, line_features, misread, operations, page_number, repaired, train, words_of, wrapped

SENTENCES = ["Heavy rain delayed planting across the northern valleys near Griosland on Monday.", "Traders reported that late-planted corn prices moved sharply before the weekend.", "Inspectors counted 1530 bushels of soybeans and observed steady progress.", "Growers expect warmer weather, although heavier ground remains saturated.", "The forecast turned drier, which slowed nitrogen application around Zabamthorpe.", "About 62 percent of the silage corn was rated better than expected by midweek."]
TABLE = "Stage           This week  Last week\nPlanted                84         52\nMature                 45         18"


def clean_text(rng):
    return " ".join(rng.choice(SENTENCES) for _ in range(8))


@pytest.fixture(scope="module")
def bulletins():
    rng = random.Random(4)
    rows = [(i, clean_text(rng), TABLE, clean_text(rng)) for i in range(60)]
    noisy = {
        100: ("Heavy rain delayed plan-\nting across the northern val¬\nleys near Griosland on Monday.", {"hyphen"}, "Heavy rain delayed planting across the northern valleys near Griosland on Monday."),
        101: ("Traders reportcd that late-\nplanted c0rn prices moved\nsharply before the wcekend.", {"char"}, "Traders reported that late-planted corn prices moved sharply before the weekend."),
        102: ("Inspectors counted 1530 bushels of\nMarket Grain Letter | May 4, 2023 | Page 7\nsoybeans and observed steady progress.", {"header"}, "Inspectors counted 1530 bushels of soybeans and observed steady progress."),
        103: ("Growers expect warmer weather, although\n- 12 -\nheavier ground remains saturated.", {"pageno"}, "Growers expect warmer weather, although heavier ground remains saturated."),
        104: ("About 62 percent of the silage corn was\nrated better than expected by midweek.", set(), "About 62 percent of the silage corn was rated better than expected by midweek."),
    }
    return rows + [(k, t, TABLE.replace("84", "B4") if k == 101 else TABLE, None) for k, (t, _, _) in noisy.items()] + [(200, None, None, None), (201, "", "", "x")], noisy


def test_repair(spark, bulletins):
    rows, noisy = bulletins
    df = spark.createDataFrame(rows, "id long, body string, record string, summary string")
    out = {(r.id, r.field_name): r for r in repaired(df, "id", ["body", "record"], ["summary"]).collect()}
    for k, (_, kinds, text) in noisy.items():
        assert set(out[k, "body"].kinds) == kinds and out[k, "body"].text == text
        assert out[k, "record"].text == TABLE and set(out[k, "record"].kinds) == ({"char"} if k == 101 else set())
    assert all(not r.kinds and r.text == dict((x[0], x[1]) for x in rows)[r.id] for (i, f), r in out.items() if i < 100 and f == "body")
    assert (200, "body") not in out and out[201, "body"].text == ""


def test_exact_vocabulary_gives_the_same(spark, bulletins):
    """With more keys than the sketch may hold, levels come by joins."""
    df = spark.createDataFrame(bulletins[0], "id long, body string, record string, summary string")
    rows = lambda **k: sorted((r.id, r.field_name, r.text, tuple(r.kinds)) for r in repaired(df, "id", ["body", "record"], ["summary"], train_texts=20, **k).collect())
    assert rows(most_cells=0) == rows()


@pytest.fixture(scope="module")
def clean_bulletins():
    b = pd.read_parquet("/root/testdata/sf0.1/wwcb_core_text.parquet", columns=["weather_highlights"]).weather_highlights
    texts = [t for t in b if t and not wrapped(t)][:600]
    cells = np.zeros(1 << 20, dtype=np.uint8)
    for t in texts[:400]:
        for w in words_of(t):
            cells[Sketch.places("w" + w, len(cells))] = 4
    return texts, Sketch(cells)


def test_held_out_accuracy(clean_bulletins):
    """Noise put into held-out texts of the test data is undone."""
    texts, sketch = clean_bulletins
    editor = Editor(train(texts[:100], [], sketch), sketch)
    rng = random.Random(1)
    right = tried = false = 0
    for t in texts[400:]:
        for w in words_of(t):
            if w.isalpha() and editor.known(w) and len(w) > 3:
                bad = misread(w, rng)
                if bad != w and not editor.known(bad):
                    tried += 1
                    right += editor.word(bad) == w
                false += editor.word(w) != w
    assert right / tried > 0.95 and false == 0


@pytest.mark.parametrize("half", [0, 1])
def test_held_out_layouts(clean_bulletins, half):
    """Headers of forms that training hasn't seen are found, whole texts are restored."""
    texts, sketch = clean_bulletins
    editor = Editor(train(texts[:150], [], sketch, HEADERS[half::2]), sketch)
    rng = random.Random(5)
    names = sorted({w for t in texts[:50] for w in words_of(t) if w.isalpha() and len(w) > 3})
    names = rng.sample(names, 4)  # few names, so that they repeat from page to page, as a publication's do
    pages = [laid_out(t, rng, names, HEADERS[1 - half :: 2])[0] for t in texts[400:]]
    cells = np.frombuffer(sketch.cells, dtype=np.uint8).copy()
    for k, m in Counter(k for page in pages for k in {letters(x) for x, _ in page if doubtful(x)}).items():
        if m >= REPEATED:
            cells[Sketch.places("s" + k, len(cells))] = 1 + int(np.log2(m))
    editor = Editor(editor.models, Sketch(cells))
    found = n = same = 0
    for t, page in zip(texts[400:], pages, strict=True):
        text, kinds = editor.edit("\n".join(x for x, _ in page))
        if "header" in {label for _, label in page}:
            n, found = n + 1, found + ("header" in kinds)
        same += "".join(text.split()) == "".join(t.split())
    assert found / n >= 0.9 and same / len(texts[400:]) > 0.7


def test_no_length_is_too_long(clean_bulletins):
    texts, sketch = clean_bulletins
    editor = Editor(train(texts[:100], [], sketch), sketch)
    number = "1" * 40 + "O5"
    known = "moisture-" * 6 + "moisture"
    for p in Sketch.places("w" + known, sketch.mask + 1):
        sketch.cells = sketch.cells[:p] + b"\x04" + sketch.cells[p + 1 :]
    assert editor.word(number) == "1" * 40 + "05" and editor.word(known.replace("sture", "stvre", 1).replace("stvre", "sture").replace("moi", "mo1", 1)) == known
    wide = "rain " * 40 + "and\nmore of it after that fell on the fields\nof the whole county for days"
    assert wrapped(wide) and not wrapped("rain " * 40 + "\n\n" + "rain " * 40)
    assert editor.word("c0" * 3000)


def test_parts():
    assert as_number("1O5") == "105" and as_number("S0") == "50" and as_number("5-yr") is None and as_number("105") is None and as_number("I") is None
    assert as_number("1" * 20 + "O") == "1" * 20 + "0"
    assert operations("m", "rn") == ("rm", "d") and operations("rn", "m") == ("rr+in",) and operations("o", "0") == ("ro",) and operations("li", "h") == ("rl+ii",)
    assert (1, 2, "o", ("ro",)) in groups("c0m") and (0, 2, "m", ("rm", "d")) in groups("rn")
    tagger = Tagger(["x", "y"])
    for _ in range(5):
        tagger.learn(["a"], "y")
    assert tagger.averaged().best(["a"]) == "y" and tagger.averaged().best(["a"], ["x"]) == "x"
    rng = random.Random(2)
    assert len({header(rng, ["corn", "rain"]) for _ in range(50)}) > 10 and page_number(rng)
    assert "since0" in line_features(["a", "7", "b"], 1, 1, 0, 0, 1)
    p = Perceptron()
    for _ in range(5):
        p.learn([[("a", 1)], [("b", 1)]], 1)
    assert p.averaged().best([[("a", 1)], [("b", 1)]]) == 1
    assert break_features("cen", "-", "tral", lambda w: 0)
    assert not wrapped("one line") and not wrapped("a\n\nb") and wrapped("a b\nc d")


def test_empty_and_long(spark):
    df = spark.createDataFrame([], "id long, body string, record string, summary string")
    assert repaired(df, "id", ["body"], ["summary"]).count() == 0
    long = "\n".join(["word again and again"] * 5_000)
    out = repaired(spark.createDataFrame([(1, long, None, None), (1, long, None, None)], df.schema), "id", ["body", "record"], []).collect()
    assert len(out) == 2 and all(r.text.count("again") == 10_000 for r in out)
