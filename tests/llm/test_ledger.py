from pyspark.sql import functions as F

from sheaf.llm.ledger import Ledger, canonical_url, digest, letters_and_digits

ROWS = [
    (5, "Maize up 3%", "https://H.example/a-b/?x=1&y=2"), (2, "  MAIZE – up: 3 ", "HTTPS://h.example//a_b?Y=2&X=1"), (9, "Maize up 3", "https://h.example/a-b?x=12"),
    (3, "Größe", "u"), (4, "GRÖSSE", "U/"), (6, None, "u"), (7, "t", None), (8, "!!", "?"), (1, "", ""), (10, "z" * 200_000, "u"), (11, "Z" * 200_000, "u"), (11, "Z" * 200_000, "u"),
]


def counted(ledger):
    return sorted((r.first_id, r.n_copies) for r in ledger.rows().collect())


def test_ledger(spark):
    df = spark.createDataFrame(ROWS, "row_id long, title string, url string").withColumn("key", F.lit("clash")).withColumn("n_copies", F.lit(1))
    key = digest(letters_and_digits(F.col("title")), canonical_url(F.col("url")))
    want = [(1, 2), (2, 2), (3, 2), (9, 1), (10, 3)]
    assert counted(Ledger(spark).update(df, key, F.col("row_id"))) == want
    steps = Ledger(spark, buckets=3)
    for k in range(3):
        steps.update(df.filter(F.pmod("row_id", F.lit(3)) == k), key, F.col("row_id"))
    assert counted(steps) == want
    assert counted(steps.update(df.limit(0), key, F.col("row_id"))) == want
    again = Ledger.open(spark, steps.path)
    assert counted(again) == want and counted(again.update(df.filter("row_id = 9"), key, F.col("row_id"))) == [x if x[0] != 9 else (9, 2) for x in want]
    assert counted(Ledger(spark)) == [] == counted(Ledger(spark).update(df.limit(0), key, F.col("row_id")))


def test_only_the_groups_met_are_written_and_none_is_shuffled(spark, tmp_path, capsys):
    df = spark.range(1000).select(F.col("id").alias("row_id"), F.unhex(F.md5(F.col("id").cast("string"))).alias("key"))
    ledger = Ledger(spark, f"{tmp_path}/l", groups=16).update(df, F.col("key"), F.col("row_id"))
    ledger.update(df.filter("row_id = 5"), F.col("key"), F.col("row_id"))
    assert sorted(ledger.about["held"].values()) == [1] * 15 + [2]
    assert len(list((tmp_path / "l" / "rows").glob("grp=*/version=*"))) == 16
    assert ledger.rows().filter("n_copies = 2").count() == 1 and ledger.rows().count() == 1000
    ledger.rows([3]).join(df.groupBy("key").count(), "key", "full_outer").explain()
    plan = capsys.readouterr().out
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
    ledger.drop()
    assert not (tmp_path / "l").exists()
