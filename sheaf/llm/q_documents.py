"""Queries over the documents: p8, p9 and p10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.leaks import leaked_items
from sheaf.llm.packing import CAPACITY, pack
from sheaf.llm.spans import shared_chars
from sheaf.runtime import read


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document, or piece of one longer than a container, goes."""
    return pack(read(spark, sf_dir, "documents"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each container with its pieces, tokens and room left over."""
    used = p8_pack(spark, sf_dir).groupBy("container_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("tokens").alias("used"))
    return used.withColumn("room", F.lit(CAPACITY) - F.col("used"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold part of a test item, with the item."""
    return leaked_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"))


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leaked test item with the number of documents that hold part of it."""
    return p9_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share long spans with others, and how many of their characters."""
    return shared_chars(read(spark, sf_dir, "documents"))


QUERIES = {"p8_pack": p8_pack, "p8_containers": p8_containers, "p9_found": p9_found, "p9_items": p9_items, "p10_found": p10_found}
_GRAMS = "SELECT {0}, w, unnest(range(1, len(w) - 11)) AS i FROM (SELECT {0}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {1} WHERE text IS NOT NULL) WHERE len(w) >= 13"
_LEAKS = f"d AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 12], ' ') AS g FROM ({_GRAMS.format('doc_id', 'documents')})), e AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 12], ' ') AS g FROM ({_GRAMS.format('item_id', 'eval_items')})), leaks AS (SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (g))"
ORACLE = {
    "p9_found": f"WITH {_LEAKS} SELECT doc_id, item_id FROM leaks",
    "p9_items": f"WITH {_LEAKS} SELECT item_id, count(*) AS n_docs FROM leaks GROUP BY item_id",
    # every start of a stretch, by digest; a character counts if the last shared start at or before it is near enough
    "p10_found": """WITH s AS (SELECT doc_id, length(text) AS n, unnest(range(1, length(text) - 318)) AS i, text FROM documents WHERE length(text) >= 320), k AS (SELECT doc_id, i, md5_number(substr(text, i, 320)) AS h FROM s),
 shared AS (SELECT h FROM k GROUP BY h HAVING min(doc_id) <> max(doc_id)), starts AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM k SEMI JOIN shared USING (h))
 SELECT doc_id, sum(least(320, coalesce(next - i, 320)))::BIGINT AS shared_chars FROM starts GROUP BY doc_id""",
}
