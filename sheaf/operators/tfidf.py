"""Term weights of texts, in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that carry no subject.
STOP_WORDS = ["a", "about", "above", "after", "all", "also", "an", "and", "are", "as", "at", "be", "because", "but", "by", "for", "from", "has", "have", "in", "into", "is", "it", "its", "more", "near", "not", "of", "on", "or", "out", "over", "since", "so", "some", "than", "that", "the", "their", "there", "they", "this", "to", "under", "was", "were", "which", "while", "with", "yet"]


def tfidf(df: DataFrame, text_id: str, text: str, features: int = 50, train: Column | None = None, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """(text_id, term, weight): words and pairs of neighbouring words, the most frequent in the corpus, smoothed idf, length 1.

    Terms and their frequencies are those of the rows for which train holds (all if None), so
    that nothing of a test row is known. Words are of two or more letters, digits and
    underscores of any script. The vocabulary has at most `features` terms and is all that is
    broadcast. Ties go to the lesser term.
    """
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[\\p{L}\\p{N}_]{2,}"), F.lit(0)), lambda w: ~w.isin(stop_words))
    x = df.select(F.col(text_id).alias("id"), words.alias("w"), (F.lit(True) if train is None else F.coalesce(train, F.lit(False))).alias("train"))
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    counts = x.select("id", "train", F.explode(F.concat("w", pairs)).alias("term")).groupBy("id", "train", "term").agg(F.count(F.lit(1)).alias("tf"))
    vocabulary = counts.filter("train").groupBy("term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("df")).orderBy(F.desc("n"), "term").limit(features)
    n = x.filter("train").agg(F.count(F.lit(1)).alias("docs"))
    idf = vocabulary.join(F.broadcast(n)).select("term", (F.ln((1.0 + F.col("docs")) / (1.0 + F.col("df"))) + 1).alias("idf"))  # one row
    raw = counts.join(F.broadcast(idf), "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("u"))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("u") * F.col("u"))).alias("norm"))
    return raw.join(norm, "id").select(F.col("id").alias(text_id), "term", (F.col("u") / F.col("norm")).alias("weight"))
