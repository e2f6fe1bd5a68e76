"""Queries over headlines, bulletins, scores, documents and events, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import text as X
from sheaf.functions.calendar import friday, from_yyyymmdd, monday, yyyymmdd
from sheaf.operators import news as N
from sheaf.operators.series import unique_key
from sheaf.operators.tfidf import STOP_WORDS, tfidf
from sheaf.plans.point_in_time import SCORES
from sheaf.plans.prices import rounded, weeks
from sheaf.runtime import read
from sheaf.sources.html import anchors, in_dates, last_page, releases

DAY = "yyyy-MM-dd"


def scored_events(s: SparkSession, d: str) -> DataFrame:
    """Events as scored articles: props.k is the relevance."""
    k = F.from_json("props", "k int").getField("k").cast("double")
    return read(s, d, "events").select("event_id", F.to_date("ts").alias("day"), k.alias("relevance_score"), F.col("value").alias("yield_supply_risk"), F.when(F.col("value") > 50, F.col("value")).alias("demand_strength"))


def weekly_news(s: SparkSession, d: str, point_in_time: bool) -> DataFrame:
    """Weighted weekly scores by the week's Monday (parity) or by the Friday that closes it (no look-ahead)."""
    week = friday(F.col("day")) if point_in_time else monday(F.col("day"))
    return rounded(N.weighted_weekly(scored_events(s, d), week, "relevance_score", ["relevance_score", "yield_supply_risk", "demand_strength"], 2.0))


def weekly_scores(s: SparkSession, d: str) -> DataFrame:
    """Means of the seven scores by decision week."""
    return read(s, d, "report_scores").filter("week is not null").groupBy(friday(F.col("week")).alias("week")).agg(*[F.avg(c).alias(c) for c in SCORES], F.count(F.lit(1)).alias("n_reports"))


def feature_panel(s: SparkSession, d: str) -> DataFrame:
    """Weekly bars with optional tables left-joined on the week, counts filled with 0; news columns get their prefix."""
    news = N.weighted_weekly(scored_events(s, d).withColumn("day", F.add_months("day", -6)), friday(F.col("day")), "relevance_score", ["relevance_score", "yield_supply_risk"])
    news = news.drop("n_rows").withColumnsRenamed({c: f"gdelt_{c}" for c in news.columns if c != "week" and not c.startswith("gdelt_")})
    counts = N.keyword_weeks(read(s, d, "wwcb_core_text"), friday(F.col("report_date").try_cast("date")), F.col("report_text"))
    panel = weeks(s, d).join(unique_key(weekly_scores(s, d), ["week"]), "week", "left").join(unique_key(counts, ["week"]), "week", "left").join(unique_key(news, ["week"]), "week", "left")
    return panel.na.fill(0, [c for c in counts.columns if c != "week"])


def report_text(s: SparkSession, d: str) -> DataFrame:
    """The three sections under their headings, which stay where a section is empty."""
    return read(s, d, "wwcb_core_text").select("bulletin_id", X.report_text(F.col("weather_highlights"), F.col("corn_section"), F.col("corn_table_text")).alias("report_text"))


# parts of the invented districts' names, as the default places are not in these tables
PLACES = ("mere", "fold", "castle", "port")
KEPT = ["gkg_date", "source_url", "source_name", "v2tone", "v2themes", "v2locations"]


def headlines(s: SparkSession, d: str, expanded: bool = True, most: int | None = None) -> DataFrame:
    """The headline query with its default terms."""
    pages = read(s, d, "news_headlines")
    out = N.headline_query(pages, F.col("title"), "source_url", "v2themes", "v2locations", "gkg_date", KEPT, N.Terms(locations=PLACES), expanded, most)
    return out.withColumn("gkg_date", F.date_format("gkg_date", "yyyy-MM-dd HH:mm:ss"))


def page_titles(s: SparkSession, d: str) -> DataFrame:
    """Titles out of the markup they travel in, and cleaned of tails put behind them."""
    tails = F.array(*map(F.lit, ["", " idUSKBN1FL5ZJ", " 20180205 00011", " 2018 02 05", " 1234567", " %C3%A9t%C3%A9"]))
    raw = read(s, d, "news_headlines").filter("title is not null").select("row_id", "title", F.concat("title", F.get(tails, F.pmod("row_id", F.lit(6)).cast("int"))).alias("tailed"))
    escaped = F.replace(F.replace("title", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    extras = F.when(F.pmod("row_id", F.lit(7)) > 0, F.concat(F.lit("<PAGE_LINKS>x</PAGE_LINKS><PAGE_TITLE> "), escaped, F.lit(" </PAGE_TITLE>")))
    return raw.select("row_id", X.page_title(extras).alias("page_title"), X.clean_headline(F.col("tailed")).alias("cleaned"))


def listed(s: SparkSession, d: str) -> DataFrame:
    """Releases out of listing pages made of the documents: dated labels, dated addresses, undated links and repeats."""
    day = F.col("published_at")
    dated = F.concat(F.lit("Report of "), F.date_format(day, "MMMM d, yyyy"), F.lit(" txt"))
    link = lambda href, label: F.concat(F.lit('<li><a href="'), href, F.lit('">'), label, F.lit("</a></li>"))
    own, other = F.concat(F.lit("/r/"), "doc_id", F.lit(".txt")), F.concat(F.lit("s/Week-of-"), F.date_format(day, "MMM-d-yyyy"), F.lit("-"), "doc_id", F.lit(".txt"))
    page = read(s, d, "documents").select("doc_id", F.concat(F.lit("<ul>"), F.when(day.isNotNull(), F.concat(link(own, dated), link(own, dated), link(other, F.lit("plain")))).otherwise(link(own, F.lit("undated txt"))), link(F.lit("/f.pdf"), F.lit("May 1, 2023")), F.lit('<a href="?page=3">3</a><a href="/l?x=1&amp;page=12">12</a></ul>')).alias("html"))
    found = releases(page, "doc_id", "html", "https://host.example/list/")
    return in_dates(found, "release_date", "2023-03-01", "2024-06-30").join(page.select("doc_id", last_page(F.col("html")).alias("last_page")), "doc_id").select("doc_id", F.date_format("release_date", DAY).alias("release_date"), "url", "file_name", "last_page")


def payload_rows(s: SparkSession, d: str) -> DataFrame:
    """Articles out of JSON replies made of the headlines: two lists, one of them empty, with repeats and gaps."""
    item = F.to_json(F.struct("title", "url", F.date_format("seendate", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"), "domain"))
    n = read(s, d, "news_headlines").select(F.concat(F.lit('{"articles": [], "'), F.when(F.pmod("row_id", F.lit(2)) == 0, "results").otherwise("data"), F.lit('": ['), item, F.lit(", "), item, F.lit(', {"title": "t"}]}')).alias("reply"), F.lpad(F.col("row_id").cast("string"), 12, "0").alias("query"))
    return N.article_rows(n, "reply", "query").select("article_id", F.date_format("seendate", "yyyy-MM-dd HH:mm:ss").alias("seendate"), F.date_format("week", DAY).alias("week"))


def reply_texts(s: SparkSession, d: str) -> DataFrame:
    """Texts of nested replies, prompts cut to a length, and checked scores."""
    reply = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.lit("output_text").alias("type"), F.col("national_ag_summary").alias("text")), F.struct(F.lit("other").alias("type"), F.lit("no").alias("text"))).alias("content")), F.struct(F.array(F.struct(F.lit("output_text").alias("type"), F.lit("end").alias("text"))).alias("content"))).alias("output")))
    ask = X.prompt("Report of {day}, week {week}:\n{text}\nGive seven scores.", {"day": F.col("report_date"), "week": F.col("week"), "text": X.shortened(F.col("national_ag_summary"), 60)})
    return read(s, d, "wwcb_core_text").select("bulletin_id", X.reply_text(reply).alias("said"), F.md5(ask.cast("binary")).alias("prompt_md5"))


def checked_scores(s: SparkSession, d: str) -> DataFrame:
    """Scores of JSON replies under `answer`, `features` or bare, checked against their ranges."""
    names = dict.fromkeys(SCORES[:6], (0, 3)) | {SCORES[6]: (-2, 2)}
    bare = F.to_json(F.struct(*SCORES, F.lit("x").alias("glm_model")))
    k = F.pmod("bulletin_id", F.lit(3))
    reply = F.when(k == 0, bare).when(k == 1, F.concat(F.lit('{"answer": '), bare, F.lit("}"))).otherwise(F.concat(F.lit('{"features": '), bare, F.lit("}")))
    some = read(s, d, "report_scores").filter(" and ".join(f"{c} between {lo} and {hi}" for c, (lo, hi) in names.items()))
    return some.select("bulletin_id", X.check_scores(reply, names, "ai_").alias("x")).select("bulletin_id", *[F.round(F.col(f"x.{c}"), 6).alias(c) for c in SCORES])


def partitions(s: SparkSession, d: str) -> DataFrame:
    """Rows by year and month of a date range that ends clipped."""
    return read(s, d, "news_headlines").filter((F.col("gkg_date") >= "2023-02-10") & (F.col("gkg_date") < "2023-05-20")).groupBy(F.year("gkg_date").alias("year"), F.month("gkg_date").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.date_format(F.min("gkg_date"), DAY).alias("first"), F.date_format(F.max("gkg_date"), DAY).alias("last"))


def html_links(s: SparkSession, d: str) -> DataFrame:
    """Links of listing pages made of the documents' titles and ids, parsed as HTML."""
    esc = F.replace(F.replace(F.replace("title", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    link = F.concat(F.lit('<li><a class="x" href="/r/'), "doc_id", F.lit('.txt">'), esc, F.lit("</a></li>"))
    page = read(s, d, "documents").filter("title is not null").select("doc_id", F.concat(F.lit("<ul>"), link, link, F.lit('<a href="/other.pdf">pdf</a><a href="?page=3">3</a></ul>')).alias("html"))
    return anchors(page, "doc_id", "html", "https://host.example/list", ".txt").select("doc_id", "url")


def calendar_dates(s: SparkSession, d: str) -> DataFrame:
    """Round trips and strings of the report dates."""
    day = F.col("report_date").try_cast("date")
    return read(s, d, "wwcb_core_text").filter(day.isNotNull()).select("bulletin_id", yyyymmdd(day).alias("ymd"), F.date_format(from_yyyymmdd(yyyymmdd(day)), DAY).alias("back"), F.date_format(friday(day), DAY).alias("fri"), F.date_format(monday(day), DAY).alias("mon"), F.concat(F.lit("https://host.example/"), F.date_format(day, "yyyy/yyyyMM/yyyyMMdd"), F.lit("/f.01.grb2")).alias("request_url"), F.date_format(F.trunc(day, "month"), DAY).alias("month_start"), F.date_format(F.date_add(F.last_day(day), 1), DAY).alias("next_month"), F.date_format(F.date_add(day, 28), DAY).alias("valid"))


def demo_releases(s: SparkSession, d: str) -> DataFrame:
    """Two templated releases for each Tuesday of a span."""
    day = s.sql("SELECT explode(sequence(DATE'2023-01-03', DATE'2023-12-26', INTERVAL 7 DAY)) AS release_date")
    kind = s.createDataFrame([("Crop Progress", "planting and harvest progress"), ("Weekly Weather", "rain and heat")], "publication string, about string")
    return day.join(F.broadcast(kind)).select(F.date_format("release_date", DAY).alias("release_date"), "publication", F.concat("publication", F.lit(" report for week "), F.weekofyear("release_date").cast("string"), F.lit(": "), "about").alias("text"))


def json_replies(s: SparkSession, d: str) -> DataFrame:
    """Scores out of replies with code fences, prose and nesting, and whether they lie in their range."""
    k = F.from_json("props", "k int").getField("k")
    reply = F.when(F.pmod("event_id", F.lit(3)) == 0, F.concat(F.lit('```json\n{"score": '), k.cast("string"), F.lit("}\n```"))).when(F.pmod("event_id", F.lit(3)) == 1, F.concat(F.lit('Here it is: {"answer": {"score": '), k.cast("string"), F.lit("}} - done"))).otherwise(F.lit("no object"))
    j = F.from_json(X.json_object(reply), "score int, answer struct<score: int>")
    df = read(s, d, "events").select("event_id", F.coalesce(j["score"], j["answer"]["score"]).alias("score"))
    return df.withColumn("valid", F.coalesce(F.col("score").between(0, 3), F.lit(False)))


QUERIES = {
    "weekly_news_parity": lambda s, d: weekly_news(s, d, False),
    "weekly_news": lambda s, d: weekly_news(s, d, True),
    "weekly_scores": lambda s, d: rounded(weekly_scores(s, d)),
    "feature_panel": lambda s, d: rounded(feature_panel(s, d)),
    "report_text": report_text,
    "headline_filter": headlines,
    "headline_filter_direct": lambda s, d: headlines(s, d, False),
    "headline_query_first": lambda s, d: headlines(s, d, True, 50).select("gkg_date"),
    "page_titles": page_titles,
    "release_listing": listed,
    "article_rows": payload_rows,
    "reply_texts": reply_texts,
    "checked_scores": checked_scores,
    "aliased": lambda s, d: N.without_repeats(N.with_aliases(read(s, d, "news_headlines").select("row_id", "headline", "source_url", "source_name", "gkg_date"))).select("row_id", "title", "domain", "article_id", F.date_format("week", DAY).alias("week")),
    "partition_counts": partitions,
    "html_links": html_links,
    "calendar_dates": calendar_dates,
    "demo_releases": demo_releases,
    "json_replies": json_replies,
    "article_ids": lambda s, d: read(s, d, "news_headlines").select("row_id", X.article_id(F.col("url"), F.col("title")).alias("own_id")),
    "slug_titles": lambda s, d: read(s, d, "news_headlines").filter("url is not null").select("row_id", X.slug_title(F.col("url")).alias("slug")),
    "headlines_first": lambda s, d: N.first_by(read(s, d, "news_headlines").filter("title is not null").select("title", "gkg_date", "url", "row_id"), ["title"], [F.col("gkg_date"), F.col("url"), F.col("row_id")]).select("title", "row_id"),
    "last_per_source": lambda s, d: N.last_n(read(s, d, "documents").filter("source is not null and published_at is not null").select("doc_id", "source", "published_at"), ["source"], [F.desc("published_at"), F.desc("doc_id")], 3).select("doc_id", "source"),
    "top_documents": lambda s, d: read(s, d, "documents").select("doc_id", "n_chars", "title").orderBy(F.desc_nulls_last("n_chars"), "doc_id").limit(10),
    "keyword_weeks": lambda s, d: rounded(N.keyword_weeks(read(s, d, "wwcb_core_text"), friday(F.col("report_date").try_cast("date")), F.col("report_text"))),
    "rule_scores": lambda s, d: read(s, d, "wwcb_core_text").select("bulletin_id", *[c.alias(n) for n, c in X.rule_scores(F.col("report_text")).items()]),
    "text_by_week": lambda s, d: N.joined_text(read(s, d, "wwcb_core_text"), ["district", "week"], "national_ag_summary", ["bulletin_id"]).select("district", "week", F.md5(F.col("report_text").cast("binary")).alias("text_md5"), "report_count"),
    "not_scored": lambda s, d: N.not_done(read(s, d, "wwcb_core_text"), read(s, d, "report_scores"), ["source_file"]).select("bulletin_id"),
    "file_completeness": lambda s, d: read(s, d, "wwcb_core_text").filter("week is not null").groupBy("district", "week").agg(F.countDistinct("revision").alias("revisions"), F.count_if(F.col("corn_table_text").isNotNull()).alias("tables")).withColumn("complete", F.col("tables") > 0),
    "mixed_union": lambda s, d: read(s, d, "documents").select("doc_id", F.col("lang").alias("label")).unionByName(read(s, d, "eval_items").select("item_id", F.col("suite").alias("label")), allowMissingColumns=True).groupBy("label").agg(F.count("doc_id").alias("docs"), F.count("item_id").alias("items")),
    "short_texts": lambda s, d: read(s, d, "documents").select("doc_id", X.shortened(F.col("text"), 400).alias("m")),
    "clean_lines": lambda s, d: read(s, d, "wwcb_core_text").select("bulletin_id", X.without_lines(X.normal_space(F.col("report_text")), ["^\\[", "^Stage"]).alias("m")),
    "sections": lambda s, d: read(s, d, "wwcb_core_text").select("bulletin_id", X.slice_between(F.col("report_text"), "\\[corn section\\]\n", ["\\[CORN PROGRESS TABLE\\]", "\\[NONE\\]"]).alias("part")),
    "tfidf": lambda s, d: rounded(tfidf(read(s, d, "wwcb_core_text"), "bulletin_id", "national_ag_summary")),
    "panel_summary": lambda s, d: feature_panel(s, d).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("series").alias("n_series"), F.date_format(F.min("week"), DAY).alias("first"), F.date_format(F.max("week"), DAY).alias("last"), F.count_if(F.col("n_reports").isNotNull()).alias("with_scores")),
    "batches": lambda s, d: read(s, d, "report_scores").select("bulletin_id", "week").filter("week is not null").transform(lambda x: N.numbered(x, ["week"], "bulletin_id", "place")).withColumn("batch", F.floor((F.col("place") - 1) / 5)).groupBy(F.date_format("week", DAY).alias("week"), "batch").agg(F.count(F.lit(1)).alias("n")),
}
_EV = "ev AS (SELECT event_id, (ts AT TIME ZONE 'UTC')::DATE AS day, (props::JSON ->> 'k')::DOUBLE AS w, value AS y, CASE WHEN value > 50 THEN value END AS z FROM events)"
_FRI = "({0} + ((12 - dayofweek({0})) % 7)::INT)::DATE"
_WN = lambda week, least="WHERE greatest(coalesce(w, 0), 0) >= 2": f"SELECT {week} AS week, coalesce(avg(w), 0) AS relevance_score, coalesce(sum(coalesce(y, 0) * greatest(coalesce(w, 0), 0)) / nullif(sum(greatest(coalesce(w, 0), 0)), 0), 0) AS yield_supply_risk, coalesce(sum(coalesce(z, 0) * greatest(coalesce(w, 0), 0)) / nullif(sum(greatest(coalesce(w, 0), 0)), 0), 0) AS demand_strength, count(*) AS n_rows FROM ev {least} GROUP BY 1"
_OUT = "SELECT strftime(week, '%Y-%m-%d') AS week, round(relevance_score, 6) AS relevance_score, round(yield_supply_risk, 6) AS yield_supply_risk, round(demand_strength, 6) AS demand_strength, n_rows FROM q"
_KW = ", ".join(f"coalesce(sum(len(regexp_extract_all(' ' || regexp_replace(lower(report_text), '[^a-z0-9_]', '  ', 'g') || ' ', ' {k} '))), 0)::BIGINT AS text_kw_{k}" for k in X.KEYWORDS)
_RD = "try_cast(report_date AS DATE)"
_KWS = f"SELECT {_FRI.format(_RD)} AS week, count(*) AS report_count, {_KW} FROM wwcb_core_text WHERE {_RD} IS NOT NULL GROUP BY 1"
_WS = f"SELECT {_FRI.format('week')} AS week, {', '.join(f'avg({c}) AS {c}' for c in SCORES)}, count(*) AS n_reports FROM report_scores WHERE week IS NOT NULL GROUP BY 1"
_BAR = """bars AS (SELECT symbol AS series, date, x.c AS close, x.v AS volume FROM (SELECT symbol, date, arg_max({'c': close, 'v': volume::BIGINT}, (loaded_at, bar_id)) AS x FROM daily_prices WHERE symbol IS NOT NULL AND date IS NOT NULL GROUP BY 1, 2) WHERE x.c IS NOT NULL AND NOT isnan(x.c)),
 weeks AS (SELECT series, (date + ((12 - dayofweek(date)) % 7)::INT)::DATE AS week, arg_max(close, date) AS close, sum(volume)::BIGINT AS volume FROM bars GROUP BY 1, 2)"""
_B = lambda t, w: f"regexp_matches({t}, '\\b({'|'.join(w)})\\b')"
_HEADS = f"h AS (SELECT *, lower(title) AS h, lower(title || ' ' || coalesce(v2themes, '') || ' ' || coalesce(source_url, '')) AS s, lower(coalesce(v2locations, '')) AS p FROM news_headlines WHERE trim(title) <> '')"
_DIRECT = _B("h", ["corn", "maize", "ethanol"])
_WX = _B("h", "drought,heat,heat wave,flood,flooding,rain,rainfall,dry weather,dryness,soil moisture,planting,harvest,yield,crop condition,crop conditions".split(",")) + " AND " + _B("s", "crop,crops,farm,farmer,farmers,agriculture,agricultural,grain,grains,corn belt,iowa,illinois,nebraska,minnesota,indiana,ohio,kansas,missouri,wisconsin".split(","))
_QN = lambda match: f"""WITH {_HEADS}, q AS (SELECT DISTINCT gkg_date, source_url, source_name, v2tone, v2themes, v2locations, title AS headline_raw, CASE WHEN {_DIRECT} THEN 'direct_corn' WHEN {_WX} THEN 'weather_ag' ELSE 'other' END AS match_type FROM h
 WHERE ({match}) AND {_B('s', 'corn,maize,usda,ethanol,biofuel,drought,harvest,planting,yield,crop,grain,farm,soybean'.split(','))} AND NOT {_B('h', 'cornwall,cornell,unicorn,acorn,cornhuskers,cornhole,cornucopia,popcorn'.split(','))} AND len(list_filter(['mere', 'fold', 'castle', 'port'], lambda x: contains(p, x))) > 0)"""  # noqa: E731
_HAS = lambda *w: "(" + " OR ".join(f"contains(t, '{x}')" for x in w) + ")"
_LATE = _HAS("behind", "delay", "slow")
_STRIP = lambda x: f"regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
_CLEAN = lambda x: _STRIP(f"array_to_string(list_transform(regexp_split_to_array(regexp_replace(regexp_replace({x}, '[ \\t\u00a0]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '\\r\\n|[\\n\\r\\f]'), lambda l: trim(l)), chr(10))")
_TAIL = "['', ' idUSKBN1FL5ZJ', ' 20180205 00011', ' 2018 02 05', ' 1234567', ' été'][(row_id % 6 + 1)::INT]"
ORACLE = {
    "weekly_news_parity": f"WITH {_EV}, q AS ({_WN('date_trunc(' + chr(39) + 'week' + chr(39) + ', day)')}) {_OUT}",
    "weekly_news": f"WITH {_EV}, q AS ({_WN(_FRI.format('day'))}) {_OUT}",
    "weekly_scores": f"WITH q AS ({_WS}) SELECT strftime(week, '%Y-%m-%d') AS week, {', '.join(f'round({c}, 6) AS {c}' for c in SCORES)}, n_reports FROM q",
    "feature_panel": f"WITH {_BAR}, {_EV.replace('::DATE AS day', '::DATE - INTERVAL 6 MONTH AS day')}, g AS ({_WN(_FRI.format('day::DATE'), '')}), k AS ({_KWS}), sc AS ({_WS}) SELECT strftime(w.week, '%Y-%m-%d') AS week, series, round(close, 6) AS close, volume, {', '.join(f'round({c}, 6) AS {c}' for c in SCORES)}, n_reports, coalesce(report_count, 0) AS report_count, {', '.join(f'coalesce(text_kw_{c}, 0) AS text_kw_{c}' for c in X.KEYWORDS)}, round(relevance_score, 6) AS gdelt_relevance_score, round(yield_supply_risk, 6) AS gdelt_yield_supply_risk FROM weeks w LEFT JOIN sc USING (week) LEFT JOIN k USING (week) LEFT JOIN g USING (week)",
    "report_text": f"SELECT bulletin_id, {_CLEAN("'[WEATHER HIGHLIGHTS]' || chr(10) || coalesce(weather_highlights, '') || chr(10) || chr(10) || '[CORN SECTION]' || chr(10) || coalesce(corn_section, '') || chr(10) || chr(10) || '[CORN PROGRESS TABLE]' || chr(10) || coalesce(corn_table_text, '')")} AS report_text FROM wwcb_core_text",
    "headline_filter": _QN(f"{_DIRECT} OR ({_WX})") + " SELECT * REPLACE (strftime(gkg_date AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS gkg_date) FROM q",
    "headline_filter_direct": _QN(_DIRECT) + " SELECT * REPLACE (strftime(gkg_date AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS gkg_date) FROM q",
    "headline_query_first": _QN(f"{_DIRECT} OR ({_WX})") + " SELECT strftime(gkg_date AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS gkg_date FROM q ORDER BY q.gkg_date NULLS FIRST LIMIT 50",
    "page_titles": f"SELECT row_id, CASE WHEN row_id % 7 > 0 THEN {_STRIP('title')} END AS page_title, {_STRIP(f"regexp_replace(title || CASE WHEN row_id % 6 = 5 THEN {_TAIL} ELSE '' END, '[\\s\\p{{Z}}]+', ' ', 'g')")} AS cleaned FROM news_headlines WHERE title IS NOT NULL",
    "release_listing": """WITH x AS (SELECT doc_id, published_at AT TIME ZONE 'UTC' AS t FROM documents WHERE published_at IS NOT NULL), r AS (SELECT doc_id, t, 'https://host.example/r/' || doc_id || '.txt' AS url FROM x UNION ALL SELECT doc_id, t, 'https://host.example/list/s/Week-of-' || strftime(t, '%b-%-d-%Y') || '-' || doc_id || '.txt' FROM x)
 SELECT doc_id, strftime(t, '%Y-%m-%d') AS release_date, url, regexp_extract(url, '[^/]*$') AS file_name, 12 AS last_page FROM r WHERE t::DATE BETWEEN DATE '2023-03-01' AND DATE '2024-06-30'""",
    "article_rows": f"WITH w AS (SELECT row_id, {_STRIP('url')} AS u, {_STRIP('title')} AS h, seendate AT TIME ZONE 'UTC' AS t FROM news_headlines WHERE seendate IS NOT NULL), x AS (SELECT substr(sha1(u || chr(10) || h), 1, 16) AS article_id, t, row_number() OVER (PARTITION BY u, h ORDER BY row_id) AS n FROM w WHERE u <> '' AND h <> '') SELECT article_id, strftime(date_trunc('second', t), '%Y-%m-%d %H:%M:%S') AS seendate, strftime({_FRI.format('t::DATE')}, '%Y-%m-%d') AS week FROM x WHERE n = 1",
    "reply_texts": "SELECT bulletin_id, CASE WHEN national_ag_summary IS NULL THEN 'end' ELSE national_ag_summary || chr(10) || 'end' END AS said, md5('Report of ' || coalesce(report_date, '') || ', week ' || coalesce(week, '') || ':' || chr(10) || coalesce(CASE WHEN length(national_ag_summary) > 60 THEN rtrim(left(national_ag_summary, 60)) || chr(10) || chr(10) || '[TRUNCATED]' ELSE national_ag_summary END, '') || chr(10) || 'Give seven scores.') AS prompt_md5 FROM wwcb_core_text",
    "checked_scores": f"SELECT bulletin_id, {', '.join(f'round({c}, 6) AS {c}' for c in SCORES)} FROM report_scores WHERE {' AND '.join(f'{c} BETWEEN 0 AND 3' for c in SCORES[:6])} AND {SCORES[6]} BETWEEN -2 AND 2",
    "aliased": f"SELECT row_id, headline AS title, source_name AS domain, substr(sha1(coalesce(source_url, '') || chr(10) || coalesce(headline, '')), 1, 16) AS article_id, strftime({_FRI.format("(gkg_date AT TIME ZONE 'UTC')::DATE")}, '%Y-%m-%d') AS week FROM news_headlines",
    "partition_counts": "WITH q AS (SELECT gkg_date AT TIME ZONE 'UTC' AS g FROM news_headlines) SELECT year(g) AS year, month(g) AS month, count(*) AS n, strftime(min(g), '%Y-%m-%d') AS first, strftime(max(g), '%Y-%m-%d') AS last FROM q WHERE g >= TIMESTAMP '2023-02-10' AND g < TIMESTAMP '2023-05-20' GROUP BY 1, 2",
    "html_links": "SELECT doc_id, 'https://host.example/r/' || doc_id || '.txt' AS url FROM documents WHERE title IS NOT NULL",
    "calendar_dates": f"WITH q AS (SELECT bulletin_id, {_RD} AS d FROM wwcb_core_text) SELECT bulletin_id, strftime(d, '%Y%m%d')::INT AS ymd, strftime(d, '%Y-%m-%d') AS back, strftime({_FRI.format('d')}, '%Y-%m-%d') AS fri, strftime(date_trunc('week', d), '%Y-%m-%d') AS mon, 'https://host.example/' || strftime(d, '%Y/%Y%m/%Y%m%d') || '/f.01.grb2' AS request_url, strftime(date_trunc('month', d), '%Y-%m-%d') AS month_start, strftime(last_day(d) + 1, '%Y-%m-%d') AS next_month, strftime(d + 28, '%Y-%m-%d') AS valid FROM q WHERE d IS NOT NULL",
    "demo_releases": "WITH t AS (SELECT unnest(generate_series(DATE '2023-01-03', DATE '2023-12-26', INTERVAL 7 DAY))::DATE AS r), k AS (SELECT * FROM (VALUES ('Crop Progress', 'planting and harvest progress'), ('Weekly Weather', 'rain and heat')) v(p, a)) SELECT strftime(r, '%Y-%m-%d') AS release_date, p AS publication, p || ' report for week ' || week(r) || ': ' || a AS text FROM t, k",
    "json_replies": "WITH q AS (SELECT event_id, CASE WHEN event_id % 3 < 2 THEN (props::JSON ->> 'k')::INT END AS score FROM events) SELECT event_id, score, coalesce(score BETWEEN 0 AND 3, false) AS valid FROM q",
    "article_ids": "SELECT row_id, substr(sha1(coalesce(url, '') || chr(10) || coalesce(title, '')), 1, 16) AS own_id FROM news_headlines",
    "slug_titles": "WITH q AS (SELECT row_id, trim(regexp_replace(regexp_replace(url_decode(regexp_replace(regexp_extract(regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1), '(?i)\\.(?:html?|php|aspx?)$', '')), '[_-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS w FROM news_headlines WHERE url IS NOT NULL) SELECT row_id, CASE WHEN length(w) >= 8 AND regexp_matches(w, '[A-Za-z]') THEN w END AS slug FROM q",
    "headlines_first": "SELECT title, row_id FROM (SELECT title, row_id, row_number() OVER (PARTITION BY title ORDER BY gkg_date, url NULLS FIRST, row_id) AS n FROM news_headlines WHERE title IS NOT NULL) WHERE n = 1",
    "last_per_source": "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY published_at DESC, doc_id DESC) AS n FROM documents WHERE source IS NOT NULL AND published_at IS NOT NULL) WHERE n <= 3",
    "top_documents": "SELECT doc_id, n_chars, title FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 10",
    "keyword_weeks": f"WITH q AS ({_KWS}) SELECT strftime(week, '%Y-%m-%d') AS week, * EXCLUDE (week) FROM q",
    "rule_scores": f"WITH q AS (SELECT bulletin_id, lower(coalesce(report_text, '')) AS t FROM wwcb_core_text), a AS (SELECT *, {_HAS('dry', 'drought', 'short topsoil', 'moisture stress')} AS m, {_HAS('hot', 'heat', 'above-normal temperatures')} AS h FROM q) SELECT bulletin_id, m::INT::DOUBLE AS ai_moisture_stress, h::INT::DOUBLE AS ai_heat_stress, {_HAS('wet', 'rain', 'flood', 'excessive precipitation')}::INT::DOUBLE AS ai_excess_rain_risk, (contains(t, 'plant') AND {_LATE})::INT::DOUBLE AS ai_planting_delay_risk, (contains(t, 'harvest') AND {_LATE})::INT::DOUBLE AS ai_harvest_delay_risk, (m OR h)::INT::DOUBLE AS ai_yield_risk, least((contains(t, 'good to excellent') AND {_HAS('above', 'improved', 'ahead')})::INT, CASE WHEN {_HAS('behind', 'decline')} THEN -1 ELSE 1 END)::DOUBLE AS ai_crop_condition_trend FROM a",
    "text_by_week": "SELECT district, week, md5(string_agg(national_ag_summary, ' ' ORDER BY bulletin_id)) AS text_md5, count(*) AS report_count FROM wwcb_core_text WHERE national_ag_summary IS NOT NULL GROUP BY 1, 2",
    "not_scored": "SELECT bulletin_id FROM wwcb_core_text b WHERE NOT EXISTS (SELECT 1 FROM report_scores r WHERE r.source_file = b.source_file)",
    "file_completeness": "SELECT district, week, count(DISTINCT revision) AS revisions, count(corn_table_text) AS tables, count(corn_table_text) > 0 AS complete FROM wwcb_core_text WHERE week IS NOT NULL GROUP BY 1, 2",
    "mixed_union": "SELECT label, count(doc_id) AS docs, count(item_id) AS items FROM (SELECT doc_id, lang AS label, NULL AS item_id FROM documents UNION ALL SELECT NULL, suite, item_id FROM eval_items) GROUP BY label",
    "short_texts": "SELECT doc_id, CASE WHEN length(text) > 400 THEN rtrim(left(text, 400)) || chr(10) || chr(10) || '[TRUNCATED]' ELSE text END AS m FROM documents",
    "clean_lines": f"WITH q AS (SELECT bulletin_id, {_CLEAN('report_text')} AS t FROM wwcb_core_text) SELECT bulletin_id, array_to_string(list_filter(string_split(t, chr(10)), lambda l: NOT (starts_with(l, '[') OR starts_with(l, 'Stage'))), chr(10)) AS m FROM q",
    "sections": f"WITH q AS (SELECT bulletin_id, report_text AS t, position('[CORN SECTION]' || chr(10) IN report_text) AS a, position('[CORN PROGRESS TABLE]' IN report_text) AS b FROM wwcb_core_text) SELECT bulletin_id, CASE WHEN a > 0 THEN {_CLEAN('CASE WHEN b > a THEN substr(t, a + 15, b - a - 15) ELSE substr(t, a + 15) END')} WHEN t IS NOT NULL THEN '' END AS part FROM q",
    "tfidf": "WITH x AS (SELECT bulletin_id, list_filter(regexp_extract_all(lower(coalesce(national_ag_summary, '')), '[\\p{L}\\p{N}_]{2,}'), lambda w: NOT list_contains(" + str(STOP_WORDS) + ", w)) AS w FROM wwcb_core_text), t AS (SELECT bulletin_id, unnest(w) AS term FROM x UNION ALL SELECT bulletin_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM x), c AS (SELECT bulletin_id, term, count(*) AS tf FROM t GROUP BY 1, 2), v AS (SELECT term, sum(tf) AS n, count(*) AS df FROM c GROUP BY 1 ORDER BY n DESC, term LIMIT 50), u AS (SELECT bulletin_id, term, tf * (ln((1.0 + (SELECT count(*) FROM x)) / (1.0 + df)) + 1) AS u FROM c JOIN v USING (term)) SELECT bulletin_id, term, round(u / sqrt(sum(u * u) OVER (PARTITION BY bulletin_id)), 6) AS weight FROM u",
    "panel_summary": f"WITH {_BAR}, sc AS ({_WS}) SELECT count(*) AS n_rows, count(DISTINCT series) AS n_series, strftime(min(week), '%Y-%m-%d') AS first, strftime(max(week), '%Y-%m-%d') AS last, count(n_reports) AS with_scores FROM weeks LEFT JOIN sc USING (week)",
    "batches": "SELECT strftime(week, '%Y-%m-%d') AS week, (rn - 1) // 5 AS batch, count(*) AS n FROM (SELECT week, row_number() OVER (PARTITION BY week ORDER BY bulletin_id) AS rn FROM report_scores WHERE week IS NOT NULL) GROUP BY 1, 2",
}
