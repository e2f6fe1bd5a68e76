"""Queries over the news headlines: p6, p7 and p4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.batch_index import repeats
from sheaf.llm.ledger import Ledger, canonical_url, digest, letters_and_digits, loads
from sheaf.llm.mojibake import garbled, restore
from sheaf.runtime import read, stored

WEEKS = 26


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines whose title was read with the wrong encoding, or lost characters in one."""
    return garbled(read(spark, sf_dir, "news_headlines"), "row_id", ["title"], "domain").select("row_id").distinct()


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the likeliest misreading and, where nothing was lost, the title as first written."""
    news = read(spark, sf_dir, "news_headlines")
    return restore(news, garbled(news, "row_id", ["title"], "domain"), "row_id", "title")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of headlines that are one article but for formatting: the first row and the number of copies.

    The weekly batches go into a ledger in order, WEEKS of them a load.
    """
    news = read(spark, sf_dir, "news_headlines")
    key = digest(letters_and_digits(F.col("title")), canonical_url(F.col("url")))
    ledger = Ledger(spark)
    try:
        for part in loads(news, "batch_id", WEEKS):
            ledger.update(news.filter(part), key, F.col("row_id"))
        return stored(ledger.rows().filter("n_copies >= 2").select(F.col("first_id").alias("row_id"), "n_copies"), "p6")
    finally:
        ledger.drop()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines that repeat or nearly repeat one of an earlier weekly batch; the batches go into an index in order, WEEKS of them a load."""
    return repeats(read(spark, sf_dir, "news_headlines"), per_load=WEEKS)


QUERIES = {"p4_found": p4_found, "p4_restored": p4_restored, "p6_found": p6_found, "p7_found": p7_found}
_CANON = "regexp_replace(replace(lower({}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
ORACLE = {
    "p6_found": f"""
 WITH k AS (SELECT row_id, {_CANON.format('title')} AS t, {_CANON.format("split_part(url, '?', 1)")} AS u,
  CASE WHEN position('?' IN url) > 0 THEN array_to_string(list_sort(list_transform(regexp_split_to_array(substr(url, position('?' IN url) + 1), '[&;]'), lambda x: {_CANON.format('x')})), '') ELSE '' END AS q
  FROM news_headlines WHERE title IS NOT NULL AND url IS NOT NULL)
 SELECT min(row_id) AS row_id, count(*) AS n_copies FROM k GROUP BY t, u || q HAVING count(*) > 1""",
    # words are told apart by four codes of one character each; two titles are near if they are under all four
    "p7_found": f"""WITH r AS (SELECT row_id, batch_id, gkg_date, {_CANON.format('article_id')} AS idk, CASE WHEN title IS NOT NULL THEN regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}]+') END AS w FROM news_headlines WHERE batch_id IS NOT NULL),
 firsts AS (SELECT idk, min(batch_id) AS first FROM r WHERE idk <> '' GROUP BY idk),
 t AS (SELECT row_id, batch_id, gkg_date, w, {', '.join(f"coalesce(array_to_string(list_transform(w, lambda x: chr((33 + hash(x || '{k}') % 94)::INT)), ''), '') AS c{k}" for k in range(4))} FROM r WHERE w IS NOT NULL AND gkg_date IS NOT NULL),
 near AS (SELECT DISTINCT a.row_id FROM t a JOIN t b ON b.batch_id < a.batch_id AND b.gkg_date BETWEEN a.gkg_date - INTERVAL 240 HOUR AND a.gkg_date + INTERVAL 240 HOUR AND abs(len(a.w) - len(b.w)) <= 2 WHERE {' AND '.join(f'levenshtein(a.c{k}, b.c{k}) <= 2' for k in range(4))})
 SELECT row_id FROM near UNION SELECT row_id FROM r JOIN firsts USING (idk) WHERE first < batch_id""",
}
