"""Headlines, reports and scores by week."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions import text as X
from sheaf.functions.calendar import friday


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an ascending order, nulls first; keys of null are one group. Combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__x")).select(*keys, "__x.*")


def numbered(df: DataFrame, keys: list[str], number: str, out: str, block: int = 1 << 16) -> DataFrame:
    """df with out, the place 1, 2, ... of a row within its keys by a whole number, ties in any order.

    Rows are numbered in blocks of the number's range and the blocks' counts added up, so that a
    frequent key is as many tasks as it has blocks.
    """
    cut = df.withColumn("__b", F.floor(F.col(number) / block))
    w = Window.partitionBy(*keys).orderBy("__b")
    counts = cut.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__c")).withColumn("__before", F.sum("__c").over(w) - F.col("__c")).drop("__c")
    local = cut.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(number)))
    return local.join(counts, [*keys, "__b"]).withColumn(out, F.col("__before") + F.col("__n")).select(*df.columns, out)


def last_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", rank).filter(F.col("__n") <= n).drop("__n")


@dataclass(frozen=True)
class Terms:
    """Term lists of the headline query."""

    topics: tuple[str, ...] = tuple(X.TOPICS)
    required: tuple[str, ...] = tuple(X.REQUIRED)
    weather: tuple[str, ...] = tuple(X.WEATHER)
    context: tuple[str, ...] = tuple(X.AG_CONTEXT)
    exclude: tuple[str, ...] = tuple(X.EXCLUDE)
    locations: tuple[str, ...] = tuple(X.LOCATIONS)


def headline_query(pages: DataFrame, headline: Column, url: str, themes: str, places: str, at: str, keep: list[str], terms: Terms = Terms(), expanded: bool = True, most: int | None = None) -> DataFrame:  # noqa: B008
    """(keep..., headline_raw, match_type): headlines about the crop near the places asked for, distinct, in order of time.

    Required, weather and excluded terms are looked for in the headline; context and topics in
    headline, themes and url together; places as parts of the page's locations. A headline
    counts with a required term or (expanded) with a weather term in an agricultural context;
    it must also have a topic, a place and no excluded term. Pages without headline fall away.
    """
    lists = {k: list(v) for k, v in vars(terms).items()}
    text = lambda *c: F.lower(F.concat_ws(" ", *[F.coalesce(x, F.lit("")) for x in c]))
    df = pages.withColumn("headline_raw", headline).filter(F.trim("headline_raw") != "")
    df = df.withColumns({"__h": text(F.col("headline_raw")), "__s": text(F.col("headline_raw"), F.col(themes), F.col(url)), "__p": text(F.col(places))})
    direct = X.any_word(F.col("__h"), lists["required"])
    weather = X.any_word(F.col("__h"), lists["weather"]) & X.any_word(F.col("__s"), lists["context"])
    kept = df.filter(((direct | weather) if expanded else direct) & X.any_word(F.col("__s"), lists["topics"]) & ~X.any_word(F.col("__h"), lists["exclude"]) & X.contains_any(F.col("__p"), [x.lower() for x in lists["locations"]]))
    out = kept.select(*keep, "headline_raw", F.when(direct, "direct_corn").when(weather, "weather_ag").otherwise("other").alias("match_type")).distinct().orderBy(at)
    return out if most is None else out.limit(most)


def weighted_weekly(scores: DataFrame, week: Column, weight: str, columns: list[str], least: float = 0.0) -> DataFrame:
    """Weekly means weighted by a column's values of 0 and more; null scores count as 0, no weight gives 0. The weight itself is a plain mean."""
    w = F.greatest(F.coalesce(F.col(weight), F.lit(0.0)), F.lit(0.0))
    df = scores.withColumns({"__week": week, "__w": w}).filter("__week is not null")
    df = df.filter(F.col("__w") >= least) if least > 0 else df
    means = [F.coalesce(F.avg(weight), F.lit(0.0)).alias(c) if c == weight else F.coalesce(F.try_divide(F.sum(F.coalesce(F.col(c), F.lit(0.0)) * F.col("__w")), F.sum("__w")), F.lit(0.0)).alias(c) for c in columns]
    return df.groupBy(F.col("__week").alias("week")).agg(*means, F.count(F.lit(1)).alias("n_rows"))


def keyword_weeks(reports: DataFrame, week: Column, text: Column) -> DataFrame:
    """Reports and keyword counts of each week; counted by report, so no text is gathered."""
    counts = {f"text_kw_{k}": X.keyword_count(text, k) for k in X.KEYWORDS}
    df = reports.withColumn("__week", week).filter("__week is not null").select("__week", *[c.alias(n) for n, c in counts.items()])
    return df.groupBy(F.col("__week").alias("week")).agg(F.count(F.lit(1)).alias("report_count"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counts])


def joined_text(reports: DataFrame, keys: list[str], text: str, order: list[str]) -> DataFrame:
    """All texts of a key in an order, one space between, with their number."""
    return reports.filter(F.col(text).isNotNull()).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__t")))), lambda x: x["__t"]), " ").alias("report_text"), F.count(F.lit(1)).alias("report_count"))


def not_done(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key hasn't been worked off yet; null keys are never done."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def article_rows(payloads: DataFrame, payload: str, query: str) -> DataFrame:
    """(article_id, seendate, week, title, url, domain, language, sourcecountry, query): articles of JSON replies, the first of each id.

    The list is the first of articles, results and data that isn't empty. Articles without
    title, url or a date fall away; the reply's order decides between equal ids.
    """
    item = "array<struct<title: string, url: string, seendate: string, date: string, datetime: string, domain: string, language: string, sourcecountry: string>>"
    x = F.from_json(payload, f"articles {item}, results {item}, data {item}")
    some = lambda name: F.when(F.size(x[name]) > 0, x[name])
    rows = payloads.select(F.col(query).alias("query"), F.posexplode(F.coalesce(some("articles"), some("results"), some("data"))).alias("__pos", "x"))
    filled = lambda c: F.when(F.trim(c) != "", c)
    stamp = F.coalesce(filled(F.col("x.seendate")), filled(F.col("x.date")), filled(F.col("x.datetime")))
    at = F.coalesce(F.try_to_timestamp(stamp, F.lit("yyyyMMdd'T'HHmmssX")), F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss")), stamp.try_cast("timestamp"))
    rows = rows.select("query", "__pos", at.alias("seendate"), X.stripped(F.col("x.title")).alias("title"), X.stripped(F.col("x.url")).alias("url"), "x.domain", "x.language", "x.sourcecountry").filter("title != '' and url != '' and seendate is not null")
    rows = rows.select(X.article_id(F.col("url"), F.col("title")).alias("article_id"), "seendate", friday(F.to_date("seendate")).alias("week"), "title", "url", "domain", "language", "sourcecountry", "query", "__pos")
    first = first_by(rows, ["article_id"], [F.col("query"), F.col("__pos")])
    return first.select("article_id", "seendate", "week", "title", "url", "domain", "language", "sourcecountry", "query")


ALIASES = {"title": "headline", "url": "source_url", "domain": "source_name", "seendate": "gkg_date"}


def with_aliases(df: DataFrame, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """df with each missing column taken from its alias, and article_id and week made where they are missing."""
    out = df.withColumns({c: F.col(a) for c, a in aliases.items() if c not in df.columns and a in df.columns})
    if "article_id" not in out.columns and {"url", "title"} & set(out.columns):
        part = lambda c: F.col(c).cast("string") if c in out.columns else F.lit(None).cast("string")
        out = out.withColumn("article_id", X.article_id(part("url"), part("title")))
    return out if "week" in out.columns or "seendate" not in out.columns else out.withColumn("week", friday(F.to_date("seendate")))


def without_repeats(df: DataFrame, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """df without the columns that only repeat another under its alias."""
    return df.drop(*[a for c, a in aliases.items() if c in df.columns and a in df.columns and a != "gkg_date"])
