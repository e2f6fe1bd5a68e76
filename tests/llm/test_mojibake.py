import pytest
from pyspark.sql import functions as F

from sheaf.llm.mojibake import atoms, garbled, readings, restore, undo


def misread(t, wrote, read):
    return "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in t.encode(wrote))


@pytest.mark.parametrize("text", ["Dürre über Köln – “Ernte”…", "Été à Paris, près d’ici", "avança não", "ASCII only"])
def test_chains_are_undone(text):
    for chain, read in [("utf8_as_cp1252", "cp1252"), ("utf8_as_latin1", "latin-1"), ("utf8_as_mac", "mac-roman"), ("utf8_as_cp437", "cp437"), ("utf8_as_cp1251", "cp1251")]:
        bad = misread(text, "utf-8", read)
        assert undo(chain, bad) == (text if bad != text else None)
    twice = misread(misread(text, "utf-8", "cp1252"), "utf-8", "cp1252")
    assert undo("utf8_as_cp1252_twice", twice) == (text if twice != text else None)


def test_genuine_letters_have_no_other_reading():
    for run in "éüàçãÉ–”“ñ½°«":
        assert len(readings("a", run, "b")) == 1
    assert atoms("é") == [(" ", "é", " ")] and atoms("") == []


def test_found_and_restored(spark):
    good = ["Récolte de blé à Paris", "Dürre über Köln – Ernte später", "São avançado não à vista", "HECTARES PRÈS DE LYON VÃO", "plain headline", "Été sec à Rome – café"]
    rows = [(i, good[i % 6], f"s{i % 3}" if i % 7 else None) for i in range(240)]
    rows += [(1000, misread(good[0], "utf-8", "cp1252"), "s1"), (1001, misread(good[1], "utf-8", "mac-roman"), None), (1002, misread(misread(good[2], "utf-8", "cp1252"), "utf-8", "cp1252"), "s2"), (1003, good[0].encode("cp1252").decode("cp1251"), "s2"), (1004, "R�colte de blé", "s0"), (1005, "D?rre über K?ln", "s0"), (1006, None, "s0"), (1007, "", "s1"), (1008, "x" * 50_000 + misread("é", "utf-8", "cp437"), "s1")]
    df = spark.createDataFrame(rows, "row_id long, title string, domain string").withColumn("source", F.lit("clash")).withColumn("chain", F.lit(1))
    found = garbled(df, "row_id", ["title"], "domain")
    out = {r.row_id: r for r in restore(df, found, "row_id", "title").collect()}
    assert set(out) == {1000, 1001, 1002, 1003, 1004, 1005, 1008}
    assert [out[1000 + k].restored for k in range(6)] == [good[0], good[1], good[2], good[0], None, None]


def test_empty(spark):
    df = spark.createDataFrame([], "row_id long, title string, domain string")
    assert garbled(df, "row_id", ["title"], "domain").count() == 0
