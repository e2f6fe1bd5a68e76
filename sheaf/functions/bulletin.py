"""The text of a paginated weekly bulletin, taken apart: dates, front-page highlights, the national summary, the crop paragraph and its table.

Pages are divided by form feeds. Everything is a column expression; a bulletin is never
gathered with another. Null texts give null dates and empty sections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.calendar import friday
from sheaf.functions.text import normal_space, stripped

MONTHS = "january february march april may june july august september october november december".split()
_DAY = "[A-Z][a-z]+ \\d{1,2}, \\d{4}"
# Fixed patterns: the bulletin's own running headers and marks.
NAME = "Weekly Weather and Crop Bulletin"
HEADERS = [f"^\\d+\\s+{NAME}\\s+{_DAY}$", f"^{_DAY}\\s+{NAME}\\s+\\d+$"]
SUMMARY_MARK = "Weekly National Agricultural Summary provided"


def month_day_year(text: Column) -> Column:
    """The date of a month's name (whole or its first three or four letters), day and year; null if there is none such."""
    m = lambda k: F.regexp_extract(text, "([A-Za-z]+)\\.?\\s+(\\d{1,2}),?\\s+(\\d{4})", k)
    name = F.lower(m(1))
    month = F.array_position(F.transform(F.array(*map(F.lit, MONTHS)), lambda x: (name == x) | (name == F.substring(x, 1, 3)) | ((name == "sept") & (x == "september"))), True)
    return F.when(month > 0, F.try_to_timestamp(F.concat_ws("-", m(3), month.cast("string"), m(2)), F.lit("y-M-d")).cast("date"))


def label_date(*texts: Column) -> Column:
    """The date in the first of the texts that has one written as month, day and year."""
    found = "[A-Za-z]{3,9}\\.?\\s+\\d{1,2},?\\s+\\d{4}"
    first = F.coalesce(*[F.when(t.rlike(found), F.regexp_extract(t, found, 0)) for t in texts])
    return month_day_year(first)


def pages(text: Column) -> Column:
    return F.split(text, "\f")


def without_headers(page: Column) -> Column:
    """A page without its running headers."""
    header = lambda x: stripped(x).rlike("|".join(HEADERS))
    return F.array_join(F.filter(F.split(page, "\n"), lambda x: ~header(x)), "\n")


def between(text: Column, start: str, end: str) -> Column:
    """What lies between the first matches of two patterns, each looked for on its own; null unless both are there, empty if they cross."""
    a = F.regexp_instr(text, F.lit(start)) + F.length(F.regexp_extract(text, start, 0))
    b = F.regexp_instr(text, F.lit(end))
    return F.when(text.rlike(start) & text.rlike(end), F.when(b > a, F.substring(text, a, b - a)).otherwise(""))


def report_date(text: Column) -> Column:
    """The first date on the first page."""
    page = F.get(pages(text), F.lit(0))
    found = f"\\b{_DAY}\\b"
    return F.when(page.rlike(found), month_day_year(F.regexp_extract(page, found, 0)))


def week_ending(text: Column) -> Column:
    """The crop report's week, else the end of the range in the highlights, else two days before the report."""
    crop = "(?is)Crop Progress and Condition\\s+Week Ending\\s+([A-Z][a-z]+ \\d{1,2}, \\d{4})"
    head, range_ = F.substring(text, 1, 2000), "\\b([A-Z][a-z]+) \\d{1,2}\\s*[–-]\\s*(\\d{1,2}),\\s*(\\d{4})\\b"
    part = lambda k: F.regexp_extract(head, range_, k)
    ranged = month_day_year(F.concat(part(1), F.lit(" "), part(2), F.lit(", "), part(3)))
    return F.when(text.rlike(crop), month_day_year(F.regexp_extract(text, crop, 1))).when(head.rlike(range_), ranged).otherwise(F.date_sub(report_date(text), 2))


def decision_week(report: Column, ending: Column) -> Column:
    """The Friday on or after the day the bulletin came out, else after the week's end."""
    return friday(F.coalesce(report, ending))


def weather_highlights(text: Column) -> Column:
    """The front page's highlights without the column at their right, and their continuation on page 3."""
    one, three = without_headers(F.get(pages(text), F.lit(0))), without_headers(F.get(pages(text), F.lit(2)))
    left = lambda t: F.array_join(F.transform(F.split(t, "\n"), lambda x: F.regexp_extract(x, "^(.*?)(?:\\s{4,}|$)", 1)), "\n")
    front = left(between(one, "\\bA\\s*\n", "\\(Continued on page 3\\)"))
    more = between(three, "(?i)\\(Continued from front cover\\)", "\\bAs the week began\\b")
    return F.coalesce(normal_space(F.concat_ws("\n\n", front, more)), F.lit(""))


def _summary_pages(text: Column) -> Column:
    return F.filter(pages(text), lambda p: F.contains(p, F.lit(SUMMARY_MARK)))


def national_summary(text: Column) -> Column:
    """What follows HIGHLIGHTS on the summary's page."""
    bodies = F.filter(F.transform(_summary_pages(text), without_headers), lambda p: p.rlike("\\bHIGHLIGHTS\\b"))
    return F.coalesce(normal_space(F.regexp_extract(F.get(bodies, F.lit(0)), "\\bHIGHLIGHTS\\b(?s:(.*))", 1)), F.lit(""))


def crop_paragraph(summary: Column) -> Column:
    """The Corn paragraph of a summary: up to its five-year comparison, else up to the next heading."""
    whole = "(?s)\\bCorn:\\s*.*?5-year average\\."
    headed = "(?s)\\bCorn:\\s*.*?(?=\n[A-Z][A-Za-z ]+:\\s|\n\\s*[A-Z][a-z]+ Grains:|\n\\s*Other Crops:|\\z)"
    return F.coalesce(F.when(summary.rlike(whole), normal_space(F.regexp_extract(summary, whole, 0))).otherwise(normal_space(F.regexp_extract(summary, headed, 0))), F.lit(""))


def crop_column(text: Column) -> Column:
    """The Corn paragraph of the left of two columns on the summary's page: lines from its heading to the next, or to its five-year comparison."""
    def of_page(page: Column) -> Column:
        lines = F.filter(F.transform(F.split(page, "\n"), lambda x: stripped(F.regexp_extract(stripped(x), "^(.*?)(?:\\s{2,}|$)", 1))), lambda x: x != "")
        # 0 before the paragraph, 1 in it, 2 after it
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("kept"))

        def step(acc: Column, x: Column) -> Column:
            opens, heads = x.startswith("Corn:"), x.rlike("^[A-Z][A-Za-z ]+:")
            inside = F.when(acc["at"] == 2, False).when(opens, True).otherwise((acc["at"] == 1) & ~heads)
            kept = F.when(inside, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"])
            done = inside & F.contains(x, F.lit("5-year average.")) & F.contains(F.lower(F.array_join(kept, " ")), F.lit("emerged"))
            at = F.when((acc["at"] == 2) | done | ((acc["at"] == 1) & ~inside), 2).when(inside, 1).otherwise(acc["at"])
            return F.struct(at.alias("at"), kept.alias("kept"))

        return F.aggregate(lines, start, step, lambda acc: F.array_join(acc["kept"], "\n"))

    found = F.filter(F.transform(_summary_pages(text), of_page), lambda x: x != "")
    return F.coalesce(normal_space(F.get(found, F.lit(0))), F.lit(""))


def crop_table(text: Column) -> Column:
    """From the crop's table to the next one."""
    start = "(?i)Corn Percent Planted"
    rest = F.regexp_extract(text, "((?i:Corn Percent Planted)(?s:.*))", 1)
    return F.when(text.rlike(start), normal_space(F.regexp_replace(rest, "(?i:Soybeans Percent Planted)(?s:.*)", ""))).otherwise("")


def parse(df: DataFrame, text: str) -> DataFrame:
    """df with report_date, week_ending, week, weather_highlights, national_summary, crop_column, crop_paragraph and crop_table of a bulletin's text.

    Parts that others are made of are computed once: a generator keeps the optimizer from
    copying them into every use.
    """
    t = F.col(text)
    once = lambda x, **c: x.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in c.items()]))))
    out = once(df, report_date=report_date(t), week_ending=week_ending(t), weather_highlights=weather_highlights(t), national_summary=national_summary(t), crop_column=crop_column(t), crop_table=crop_table(t))
    return out.withColumns({"week": decision_week(F.col("report_date"), F.col("week_ending")), "crop_paragraph": crop_paragraph(F.col("national_summary"))})
