"""Text and JSON expressions."""

from __future__ import annotations

import html
import re
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The counted words, and the default term lists of the headline query.
KEYWORDS = ["drought", "rain", "heat", "planting", "harvest", "yield", "export", "ethanol"]
TOPICS = ["corn", "maize", "usda", "ethanol", "biofuel", "drought", "harvest", "planting", "yield", "crop", "grain", "farm", "soybean"]
REQUIRED = ["corn", "maize", "ethanol"]
WEATHER = ["drought", "heat", "heat wave", "flood", "flooding", "rain", "rainfall", "dry weather", "dryness", "soil moisture", "planting", "harvest", "yield", "crop condition", "crop conditions"]
AG_CONTEXT = ["crop", "crops", "farm", "farmer", "farmers", "agriculture", "agricultural", "grain", "grains", "corn belt", "iowa", "illinois", "nebraska", "minnesota", "indiana", "ohio", "kansas", "missouri", "wisconsin"]
EXCLUDE = ["cornwall", "cornell", "unicorn", "acorn", "cornhuskers", "cornhole", "cornucopia", "popcorn"]
LOCATIONS = ["united states", "iowa", "illinois", "nebraska", "minnesota", "indiana", "ohio", "south dakota", "north dakota", "missouri", "kansas", "wisconsin", "michigan"]
SCORES = ["relevance_score", "yield_supply_risk", "inventory_supply_tightness", "demand_strength", "ethanol_export_signal", "trade_policy_risk"]


def keyword_count(text: Column, word: str) -> Column:
    """Occurrences of a word between characters that aren't ASCII letters, digits or underscores."""
    return F.regexp_count(F.lower(text), F.lit(f"(?<![a-z0-9_]){word}(?![a-z0-9_])"))


def any_word(text: Column, words: list[str]) -> Column:
    """Whether one of the words or phrases, taken literally, stands between ASCII word boundaries; of no words none does."""
    if not words:
        return F.lit(False)
    return text.rlike(f"(?<![A-Za-z0-9_])(?:{'|'.join(re.escape(w.lower()) for w in words)})(?![A-Za-z0-9_])")


def contains_any(text: Column, parts: list[str]) -> Column:
    """Whether one of the parts occurs, as a test over an array: no join is needed for a list of constants."""
    return F.exists(F.array(*map(F.lit, parts)), lambda x: F.contains(text, x))


_LINE_END = "\\r\\n|[\\n\\r\\x0b\\f\\x1c-\\x1e\\x85\\x{2028}\\x{2029}]"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def normal_space(text: Column) -> Column:
    """Runs of spaces and tabs as one space, no more than one empty line, each line and the whole stripped."""
    one = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\\x{a0}", " "), "[ \\t]+", " "), "\n{3,}", "\n\n")
    return stripped(F.array_join(F.transform(F.split(one, _LINE_END), stripped), "\n"))


def without_lines(text: Column, patterns: list[str]) -> Column:
    """text without the lines that match a pattern."""
    drop = lambda x: reduce(lambda a, b: a | b, [x.rlike(p) for p in patterns])
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~drop(x)), "\n")


def slice_between(text: Column, start: str, ends: list[str]) -> Column:
    """What follows the first match of start up to the nearest end pattern after it, letter case ignored, spaces normalised; empty without start.

    Patterns may not have capturing groups.
    """
    rest = F.regexp_extract(text, f"(?i:{start})(?s:(.*))", 1)
    cut = F.regexp_replace(rest, f"(?i:{'|'.join(f'(?:{e})' for e in ends)})(?s:.*)", "") if ends else rest
    return F.when(text.rlike(f"(?i:{start})"), normal_space(cut)).otherwise(F.when(text.isNotNull(), F.lit("")))


def _python_text(how) -> Column:
    """A text function of the standard library over Arrow batches; null stays null."""
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(how, na_action="ignore")

    return run


unescaped = _python_text(lambda t: html.unescape(t) if "&" in t else t)
percent_decoded = _python_text(lambda t: unquote(t) if "%" in t else t)
unescaped_and_decoded = _python_text(lambda t: unquote(html.unescape(t).replace("%20", " ")) if "&" in t or "%" in t else t)


def page_title(extras: Column) -> Column:
    """The text of the first PAGE_TITLE element, entities undone; null without one."""
    found = "(?s)<PAGE_TITLE>(.*?)</PAGE_TITLE>"
    return F.when(extras.rlike(found), stripped(unescaped(F.regexp_extract(extras, found, 1))))


def _one_space(text: Column) -> Column:
    return stripped(F.regexp_replace(text, "(?U)\\s+", " "))


def slug_title(url: Column) -> Column:
    """A title from a url's last path part without page suffix; null if it has fewer than 8 characters or no letter."""
    path = F.regexp_extract(url, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    tail = F.regexp_replace(F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1), ";.*$", "")
    words = _one_space(F.regexp_replace(percent_decoded(F.regexp_replace(tail, "(?i)\\.(?:html?|php|aspx?)$", "")), "[_-]+", " "))
    return F.when((F.length(words) >= 8) & words.rlike("[A-Za-z]"), words)


# Fixed patterns: what wires and feeds append to a headline.
TAILS = ["(?i)\\s+id[a-z]{2,}[a-z0-9]+$", "\\s+20\\d{6}\\s+\\d{3,}$", "\\s+20\\d{2}\\s+\\d{2}\\s+\\d{2}$", "\\s+\\d{6,}$"]


def clean_headline(title: Column) -> Column:
    """A headline with entities and percent signs undone, without trailing wire ids, stamps and long numbers, blanks made one."""
    return _one_space(reduce(lambda x, tail: F.regexp_replace(x, tail, ""), TAILS, _one_space(unescaped_and_decoded(title))))


def article_id(url: Column, title: Column) -> Column:
    """First 16 hexadecimal digits of SHA-1 over url, line feed and title; null counts as empty."""
    return F.substring(F.sha1(F.concat(F.coalesce(url, F.lit("")), F.lit("\n"), F.coalesce(title, F.lit(""))).cast("binary")), 1, 16)


def shortened(text: Column, most: int, mark: str = "\n\n[TRUNCATED]") -> Column:
    """text cut off with a mark; whole if most isn't positive."""
    if most <= 0:
        return text
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.left(text, F.lit(most))), F.lit(mark))).otherwise(text)


def json_object(reply: Column) -> Column:
    """The JSON object in a reply that may stand in a code fence or in prose."""
    return F.regexp_extract(F.regexp_replace(reply, "```(?:json)?", ""), "(?s)\\{.*\\}", 0)


def report_text(weather: Column, crop: Column, table: Column) -> Column:
    """The three sections under their headings, which stay where a section is empty; spaces normalised."""
    part = lambda head, c: F.concat(F.lit(f"[{head}]\n"), F.coalesce(c, F.lit("")))
    return normal_space(F.concat_ws("\n\n", part("WEATHER HIGHLIGHTS", weather), part("CORN SECTION", crop), part("CORN PROGRESS TABLE", table)))


def prompt(template: str, fields: dict[str, Column]) -> Column:
    """A template whose {name} places take columns; null counts as empty."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(fields[x].cast("string"), F.lit("")) if k % 2 else F.lit(x) for k, x in enumerate(pieces)])


def rule_scores(text: Column) -> dict[str, Column]:
    """Scores of a report by which phrases occur, for use where no other scorer is at hand; null counts as empty."""
    t = F.lower(F.coalesce(text, F.lit("")))
    has = lambda *w: contains_any(t, list(w))
    score = lambda c: F.when(c, 1.0).otherwise(0.0)
    late = has("behind", "delay", "slow")
    dry, hot = has("dry", "drought", "short topsoil", "moisture stress"), has("hot", "heat", "above-normal temperatures")
    return {
        "ai_moisture_stress": score(dry), "ai_heat_stress": score(hot), "ai_excess_rain_risk": score(has("wet", "rain", "flood", "excessive precipitation")),
        "ai_planting_delay_risk": score(has("plant") & late), "ai_harvest_delay_risk": score(has("harvest") & late), "ai_yield_risk": score(dry | hot),
        # what falls behind outweighs what is good
        "ai_crop_condition_trend": F.when(has("behind", "decline"), -1.0).otherwise(score(has("good to excellent") & has("above", "improved", "ahead"))),
    }


def check_scores(reply: Column, ranges: dict[str, tuple[float, float]], prefix: str) -> Column:
    """The scores of a reply (a JSON object) as a struct of doubles; fails at run time on a missing or unknown name or a value out of range.

    The object may hold the scores itself or under `answer` or `features`; of other names only those with the prefix are refused.
    """
    whole = F.from_json(reply, "map<string,string>")
    inner = F.coalesce(F.from_json(whole["answer"], "map<string,string>"), F.from_json(whole["features"], "map<string,string>"), whole)
    bad = lambda what, name: F.raise_error(F.concat(F.lit(f"{what}: {name} "), F.coalesce(reply, F.lit("null")))).cast("double")
    unknown = F.filter(F.map_keys(inner), lambda k: k.startswith(prefix) & ~k.isin(list(ranges)))

    def one(name: str, low: float, high: float) -> Column:
        x = inner[name].try_cast("double")
        return F.when(x.isNull(), bad("missing", name)).when((x < low) | (x > high), bad("out of range", name)).when(F.size(unknown) > 0, bad("unknown beside", name)).otherwise(x)

    return F.struct(*[one(n, lo, hi).alias(n) for n, (lo, hi) in ranges.items()])


def reply_text(payload: Column) -> Column:
    """The text of a scorer's nested reply: `output_text`, else all text parts of its output, one a line."""
    kind = "output_text string, output array<struct<content: array<struct<type: string, text: string>>>>"
    x = F.from_json(payload, kind)
    parts = F.flatten(F.transform(x["output"], lambda o: F.coalesce(o["content"], F.array().cast("array<struct<type: string, text: string>>"))))
    texts = F.transform(F.filter(parts, lambda p: (p["type"] == "output_text") & p["text"].isNotNull()), lambda p: p["text"])
    return F.coalesce(x["output_text"], F.when(F.size(texts) > 0, F.array_join(texts, "\n")))
