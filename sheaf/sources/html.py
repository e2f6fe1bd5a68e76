"""Anchors of listing pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions.bulletin import label_date


class _Anchors(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[list[str]] = []
        self.open = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a" and (href := dict(attrs).get("href")):
            self.found.append([href, ""])
            self.open = True

    def handle_endtag(self, tag: str) -> None:
        self.open = self.open and tag != "a"

    def handle_data(self, data: str) -> None:
        if self.open:
            self.found[-1][1] += data


def anchors(pages: DataFrame, page_id: str, html: str, base: str = "", suffix: str = "", first_only: bool = True) -> DataFrame:
    """(page_id, position, href, url, label): links of each page in order, by default the first of each url; parsed page by page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page, text in zip(pdf["page"], pdf["html"], strict=True):
                parser, seen = _Anchors(), set()
                parser.feed(text or "")
                for k, (href, label) in enumerate(parser.found):
                    url = urljoin(base, href)
                    if url.lower().endswith(suffix) and not (first_only and url in seen):
                        seen.add(url)
                        rows.append((page, k, href, url, " ".join(label.split())))
            yield pd.DataFrame(rows, columns=[page_id, "position", "href", "url", "label"])

    kind = pages.schema[page_id].dataType.simpleString()
    return pages.select(F.col(page_id).alias("page"), F.col(html).alias("html")).mapInPandas(run, f"{page_id} {kind}, position int, href string, url string, label string")


def releases(pages: DataFrame, page_id: str, html: str, base: str, kind: str = "txt", date_in_link: bool = True) -> DataFrame:
    """(release_date, title, url, file_name, page_id): dated links to files of a kind, the first of each url in the order of pages and links.

    A link counts if its address has the kind's suffix (of txt also if the label names it); its
    date stands in the label or, if date_in_link, in the address with hyphens read as spaces.
    """
    links = anchors(pages, page_id, html, base, first_only=False)
    wanted = F.lower("href").endswith(".txt") | F.contains(F.lower("label"), F.lit("txt")) if kind == "txt" else F.contains(F.lower("href"), F.lit(f".{kind}"))
    day = label_date(F.col("label"), *([F.replace("href", F.lit("-"), F.lit(" "))] if date_in_link else []))
    dated = links.filter(wanted).withColumn("release_date", day).filter("release_date is not null")
    once = dated.groupBy("url").agg(F.min_by(F.struct("release_date", "label", "href", page_id), F.struct(page_id, "position")).alias("x"))
    return once.select("x.release_date", F.col("x.label").alias("title"), "url", F.regexp_extract("x.href", "([^/]*)$", 1).alias("file_name"), f"x.{page_id}")


def in_dates(rows: DataFrame, day: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of an inclusive span of days, open at the ends that aren't given."""
    kept = rows if start is None else rows.filter(F.col(day) >= F.lit(start).cast("date"))
    return kept if end is None else kept.filter(F.col(day) <= F.lit(end).cast("date"))


def manifest(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """wanted with status: exists for keys that are present, missing for the rest."""
    there = present.select(key).distinct().withColumn("__there", F.lit(True))
    return wanted.join(there, key, "left").withColumn("status", F.when(F.col("__there"), "exists").otherwise("missing")).drop("__there")


def last_page(html):
    """The greatest page number that a listing links to, 0 if to none."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(html, F.lit("[?&](?:amp;)?page=(\\d+)"), F.lit(1)), lambda x: x.cast("int"))), F.when(html.isNotNull(), 0))
