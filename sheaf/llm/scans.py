"""Traces of page scanning in text, removed by an averaged-perceptron character editor.

The editor decides an operation for each character of a text: keep it, replace it, delete
it, insert one after it, or (for a line's end) join the lines. Three averaged perceptrons
over sparse features score the operations; they are applied in this order:

- furniture: is a line a running header, a page number or body? All characters of the first
  two are deleted. Features are its place on the page (how far from its ends and from the
  line before that may be furniture, what the lines before and after look like, its length
  against the page's), its shape, and how often its letters stand in lines of other scanned
  and of clean texts;
- line ends: is a sign at a line's end deleted and the lines joined, is it kept and they are
  joined, or does the line's end become a space? Features are which of the possible words
  clean text has;
- characters: each character of a word is kept, replaced, deleted or followed by an insertion,
  scored by the character, its neighbours and its place, and the word that results by whether
  clean text has it. As operations see the characters as they were read, scores add up: the
  best sequences are put together from the operations that differ from keeping, up to
  MAX_EDITS groups of them a word. Which groups there are is learned from the noise.

Training needs no labels: clean texts are laid out in lines, divided, misread and given
headers and page numbers by noise(), which knows what it did; names in headers are made of
words of the texts. The sample is bounded by TRAIN_TEXTS texts. Which words clean texts
have, and in how many texts a line occurs, is counted over all data and kept in a sketch of
one-byte counters, SPARE for each key, of at most MOST_CELLS: a count may come out too high,
never too low. With more keys than that, each text asks for the exact counts of the words
it needs by joins (exact_levels) and no sketch is made. With the sketch a text is edited
where it stands: texts are read once to count and once to edit, and never shuffled.

What isn't repaired: a misreading that is itself a word of clean text; one of more than
MAX_EDITS groups; confusions outside CONFUSIONS. Pairs of groups are tried in the order of
their scores up to PAIRS of them, which is every pair of a word of some 100 characters; single groups
are always tried all.

Defined results: null and empty texts stay as they are and have no noise; texts without
line layout are clean; repeated rows come out each; texts of any length are edited whole.
"""

from __future__ import annotations

import functools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_intdigest

from sheaf.runtime import Scratch, stored

SPARE = 8
LEAST_CELLS = 1 << 20
MOST_CELLS = 1 << 26
_SHIFTS = (0, 26, 52, 78, 102)
TRAIN_TEXTS = 240
MAX_EDITS = 2
REPEATED = 4  # texts in which a line has to stand before it counts as repeated
PAIRS = 20_000
PAGE_WIDTH = 100  # most lines of a scanned page are no longer
# What was written and what scanning reads instead.
CONFUSIONS = [
    ("o", "0"), ("O", "0"), ("l", "1"), ("l", "|"), ("l", "I"), ("i", "l"), ("i", "1"), ("i", "!"), ("i", "|"), ("I", "l"), ("I", "1"), ("s", "5"), ("S", "5"), ("B", "8"), ("g", "9"), ("e", "c"), ("c", "e"), ("t", "f"), ("f", "t"), ("h", "b"), ("b", "h"), ("a", "o"), ("o", "a"), ("y", "v"), ("v", "y"), ("u", "ii"), ("w", "vv"), ("m", "rn"), ("rn", "m"), ("d", "cl"), ("cl", "d"), ("in", "m"), ("ni", "m"), ("n", "u"), ("u", "n"), ("li", "h"), ("h", "li"), ("z", "2"), ("Z", "2"), ("b", "6"), ("c", "("), ("fi", "ﬁ"), ("fl", "ﬂ"), ("ff", "ﬀ"),
    ("0", "O"), ("0", "o"), ("1", "l"), ("1", "I"), ("1", "|"), ("5", "S"), ("8", "B"), ("9", "g"), ("6", "b"), ("2", "Z"), ("3", "E"), ("4", "A"), ("7", "T"),
]
DIGIT_OF = {bad: good for good, bad in CONFUSIONS if good.isdigit()}
SIGNS = "-¬­‐"
_MONTHS = "January February March April May June July August September October November December".split()
_DATE = re.compile(rf"\b(?:{'|'.join(_MONTHS)})\.? +\d{{1,2}},? +\d{{4}}|\d{{4}}-\d\d-\d\d|\d{{1,2}}/\d{{1,2}}/\d{{2,4}}", re.I)
_PAGE = re.compile(r"[\s\-–—\[\]()|·*]*(?:(?:page|pg\.?|p\.)\s*)?[0-9OolI|SB]{1,4}(?:\s*(?:of|/)\s*[0-9OolI|SB]{1,4})?[\s\-–—\[\]()|·*]*", re.I)
_TOKEN = re.compile(r"[^\s\"“”()\[\],;:/]+")
_OPEN = re.compile(r"[^\s\"“”)\[\],;:/]+")  # where a line closes no bracket, an opening one is misread
_RUNNING3 = re.compile(r"(?:(?<![A-Za-z])[a-z]{4,}.*?){3}", re.S)
_COLUMNS = re.compile(r"\S(?: {2,}|\t)\s*(?=\S)")
_NOT_LETTERS = re.compile(r"[^a-z]")
_PAGE_WORDS = re.compile(r"page|continued")
_HAS_PAGE = re.compile(r"page", re.I)
_CAPITALS = re.compile(r"(?:^| )[A-Z](?= |$)")
_DIGIT = re.compile(r"[0-9]")
_MARKS = re.compile(r"   |[|·\f]|\(cont| \d{4}\b|^\s*\d")
_BRACKETS = re.compile(r"^\[[A-Z ]+\]$")


class Perceptron:
    """An averaged perceptron that ranks candidates, each a list of signed features (feature, 1 or -1)."""

    def __init__(self, w: dict[str, float] | None = None) -> None:
        self.w: dict[str, float] = defaultdict(float, w or {})
        self._sum: dict[str, float] = defaultdict(float)
        self._n = 0

    def score(self, features: list[tuple[str, int]]) -> float:
        w = self.w
        return sum([w.get(f, 0.0) * v for f, v in features])

    def best(self, candidates: list[list[tuple[str, int]]]) -> int:
        s = [self.score(c) for c in candidates]
        return s.index(max(s))

    def learn(self, candidates: list[list[tuple[str, int]]], right: int) -> None:
        self._n += 1
        got = self.best(candidates)
        if got != right:
            for f, step in [*candidates[right], *[(f, -v) for f, v in candidates[got]]]:
                self.w[f] += step
                self._sum[f] += step * self._n

    def averaged(self) -> Perceptron:
        return Perceptron({f: x - self._sum[f] / (self._n + 1) for f, x in self.w.items()})


class Tagger:
    """An averaged perceptron that gives one of a few labels; a feature has a weight for each."""

    def __init__(self, labels: list[str], w: dict[str, list[float]] | None = None) -> None:
        self.labels, self.w, self._sum, self._n = labels, dict(w or {}), {}, 0

    def best(self, features: list[str], among: list[str] | None = None) -> str:
        """The likeliest label, of all or of the first few."""
        rows = [x for f in features if (x := self.w.get(f)) is not None]
        s = [sum(x) for x in zip(*rows, strict=True)][: len(among or self.labels)] if rows else [0.0]
        return self.labels[s.index(max(s))]

    def learn(self, features: list[str], right: str) -> None:
        self._n += 1
        got = self.best(features)
        if got != right:
            for label, step in ((right, 1.0), (got, -1.0)):
                k = self.labels.index(label)
                for f in features:
                    self.w.setdefault(f, [0.0] * len(self.labels))[k] += step
                    self._sum.setdefault(f, [0.0] * len(self.labels))[k] += step * self._n

    def averaged(self) -> Tagger:
        return Tagger(self.labels, {f: [x - t / (self._n + 1) for x, t in zip(row, self._sum[f], strict=True)] for f, row in self.w.items()})


class Sketch:
    """Upper bounds of counts of strings in one-byte cells, a power of two of them."""

    def __init__(self, cells: np.ndarray) -> None:
        self.cells, self.mask = cells.tobytes(), len(cells) - 1

    @staticmethod
    def places(key: str, cells: int) -> list[int]:
        h = xxh3_128_intdigest(key)
        return [(h >> s) & (cells - 1) for s in _SHIFTS]

    def level(self, key: str) -> int:
        """0 for none, else 1 + the power of two of the count."""
        h, least, mask = xxh3_128_intdigest(key), 255, self.mask
        for s in _SHIFTS:
            x = self.cells[(h >> s) & mask]
            if x < least:
                if not x:
                    return 0
                least = x
        return least


class Asked:
    """Exact levels of the keys that were asked for; what it doesn't hold counts as 0 and is noted."""

    def __init__(self, held: dict[str, int]) -> None:
        self.held, self.missed = held, set()

    def level(self, key: str) -> int:
        x = self.held.get(key)
        if x is None:
            self.missed.add(key)
            return 0
        return x


def wrapped(text: str) -> bool:
    """Whether text is laid out in the lines of a page: some run on in the next, and most are no wider than a page."""
    if "\n" not in text:
        return False
    lines = text.split("\n")
    run, runs = 0, False
    for line in lines:
        run = run + 1 if line.strip() and not _BRACKETS.match(line) else 0
        runs |= run >= 2
    if not runs:
        return False
    held = [len(x) <= PAGE_WIDTH for x in lines if x.strip()]
    return 2 * sum(held) > len(held)


def is_row(line: str) -> bool:
    """Whether a line is a table's: words, then several columns apart."""
    return ("  " in line or "\t" in line) and len(_COLUMNS.findall(line)) >= 2 and not _DATE.search(line)


def letters(line: str) -> str:
    """The letters of a line without dates, to tell whether lines are alike."""
    return _NOT_LETTERS.sub("", _PAGE_WORDS.sub("", _DATE.sub("", line).lower()))


def doubtful(line: str) -> bool:
    """Whether a line may be furniture: none has three running words in lower case."""
    return bool(line.strip()) and (not _RUNNING3.search(line) or bool(_MARKS.search(line)))


def token_words(token: str) -> list[str]:
    t = token.strip(".?!'’").lower()
    if t.endswith(("'s", "’s")):
        t = t[:-2]
    return [] if not t else [t, *[x for x in t.split("-") if x]] if "-" in t else [t]


def words_of(text: str) -> list[str]:
    """The words of a text, compounds also by their parts."""
    return [w for t in _TOKEN.findall(text) for w in token_words(t)]


# --- furniture -----------------------------------------------------------------------------


def neighbour(lines: list[str], i: int, step: int, most: int = 20) -> str:
    """The next line in a direction that isn't blank; of a wider gap it doesn't matter what lies beyond."""
    for k in range(i + step, i + step * (most + 1), step):
        if not 0 <= k < len(lines):
            break
        if x := lines[k].strip():
            return x
    return ""


def line_features(lines: list[str], i: int, width: int, seen: int, clean: int, gap: int) -> list[str]:
    """gap: lines since the last that may be furniture."""
    line = lines[i].strip("\f")
    body = line.strip()
    before, after = neighbour(lines, i, -1), neighbour(lines, i, 1)
    alpha = [x for x in body.split() if x[:1].isalpha()]
    long = [x for x in alpha if len(x) > 3]
    date, bar, wide = bool(_DATE.search(body)), "|" in body or "·" in body, "   " in body
    caps, named = bool(alpha) and all(x.isupper() for x in alpha), f"{bool(long) and all(x[0].isupper() for x in long)}{len(long) > 2}"
    form, cut, low, digit = bool(body) and bool(_PAGE.fullmatch(body)), before[-1:] not in ".:]" or before == "", after[:1].islower(), bool(_DIGIT.search(body))
    stop, row, short, words = body.endswith((".", ",", ";")), is_row(body), len(body) * 4 < width * 3, min(3, sum(x[0].islower() for x in long))
    f = [
        f"seen{min(seen, 5)}", f"clean{min(clean, 1)}", f"seen{min(seen, 3)}clean{min(clean, 1)}", f"date{date}", f"page{bool(_HAS_PAGE.search(body))}", f"bar{bar}", f"gap{wide}", f"caps{caps}", f"title{named}", f"cont{'(continued)' in body.lower()}",
        f"endnum{body[-1:] in '0123456789'}", f"startnum{body[:1] in '0123456789'}", f"stop{stop}", f"inner{'. ' in body}", f"spaced{len(_CAPITALS.findall(body)) >= 5}", f"ff{chr(12) in lines[i]}", f"row{row}", f"short{short}", f"form{form}", f"cut{cut}", f"low{low}",
        f"top{min(i, 3)}", f"end{min(len(lines) - 1 - i, 3)}", f"since{min(gap, 40) // 4}", f"indent{line[:1] == ' '}", f"alone{i > 0 and not lines[i - 1].strip()}{i + 1 < len(lines) and not lines[i + 1].strip()}", f"bracket{bool(_BRACKETS.match(body))}", f"lowwords{words}",
        f"form{form}&cut{cut}&low{low}", f"form{form}&short{short}", f"clean{min(clean, 1)}&title{named}", f"seen{min(seen, 3)}clean{min(clean, 1)}&caps{caps}&title{named}", f"form{form}&digit{digit}&stop{stop}", f"lowwords{words}&title{named}", f"date{date}&gap{wide}&bar{bar}", f"row{row}&title{named}", f"date{date}&lowwords{words}", f"stop{stop}&cut{cut}", f"stop{stop}&cut{cut}&title{named}&date{date}",
    ]
    return f


_LINE_LABELS = ["body", "header", "pageno"]


# --- breaks --------------------------------------------------------------------------------


def break_features(left: str, sign: str, right: str, known) -> list[str]:
    a, b = left.lower(), right.lower()
    joined, own, pa, pb = known(a + b) > 0, known(f"{a}-{b}") > 0, known(a.split("-")[-1]) > 1, known(b.split("-")[0]) > 1
    f = [f"sign{'-' if sign in '-‐' else 'soft'}", f"joined{joined}", f"own{own}", f"parts{pa}{pb}", f"len{min(len(a), 3)}{min(len(b), 3)}", f"cap{right[:1].isupper()}", f"num{left[-1:].isdigit()}{right[:1].isdigit()}"]
    return f + [f"{f[0]}&{f[1]}&{f[2]}&{f[3]}", f"{f[1]}&{f[2]}", f"{f[0]}&{f[1]}&{f[3]}"]


_BREAK_LABELS = ["delete and join", "keep and join", "space"]


# --- characters ----------------------------------------------------------------------------

def operations(good: str, bad: str) -> tuple[str, ...]:
    """An operation for each character of bad that together make good of it."""
    if len(bad) == 2 and len(good) == 1:
        return ("d", "k") if bad[1] == good else ("k", "d") if bad[0] == good else (f"r{good}", "d")
    first = "k" if bad[0] == good[0] else f"r{good[0]}"
    if len(bad) == 1:
        return (first + (f"+i{good[1]}" if len(good) == 2 else ""),)
    return (first, "k" if bad[1] == good[1] else f"r{good[1]}")


_UNDO: dict[str, list[tuple[str, tuple[str, ...]]]] = defaultdict(list)
for _good, _bad in CONFUSIONS:
    _UNDO[_bad].append((_good, operations(_good, _bad)))


def as_number(token: str) -> str | None:
    """token with what is read for digits put back, if that makes it a number."""
    if not _NUMBERLIKE.search(token):
        return None
    new = "".join([c if c in "0123456789.,$%+-" else DIGIT_OF.get(c, "?") for c in token])
    return new if new != token and _NUMBER.fullmatch(new) else None


_NUMBERLIKE = re.compile(r"[0-9]|^[OISBl|Z]{2,}$")
_NUMBER = re.compile(r"[$+-]?\d+(?:[.,]\d+)*%?")
_FIGURES = re.compile(r"[0-9.,$%+-]+")


def groups(word: str) -> list[tuple[int, int, str, tuple[str, ...]]]:
    """(start, end, text, operations): what may be done instead of keeping the characters from start to end."""
    out = []
    for i in range(len(word)):
        for n in (1, 2):
            for good, ops in _UNDO.get(word[i : i + n], ()) if i + n <= len(word) else ():
                out.append((i, i + n, good, ops))
    return out


def operation_features(word: str, i: int, op: str) -> list[str]:
    """Of an operation on a character: the character, its neighbours and its place."""
    c, a, z = word[i], word[i - 1] if i else "^", word[i + 1] if i + 1 < len(word) else "$"
    shape = "".join("9" if x.isdigit() else "A" if x.isupper() else "a" if x.isalpha() else x for x in (a, c, z))
    return [op[:1], f"{op}<{c}", f"{op}<{a}{c}", f"{op}<{c}{z}", f"{op[:1]}{shape}", f"{op}@{0 if not i else 2 if i + 1 == len(word) else 1}"]


def group_features(word: str, group: tuple[int, int, str, tuple[str, ...]]) -> list[tuple[str, int]]:
    """Of a group's operations, less those of keeping its characters."""
    start, _, _, ops = group
    out = []
    for k, op in enumerate(ops):
        if op != "k":
            out += [(f, 1) for f in operation_features(word, start + k, op)] + [(f, -1) for f in operation_features(word, start + k, "k")]
    return out


def core(token: str) -> tuple[str, str, str]:
    """(before, word, after): the part of a token that is a word."""
    m = _CORE.fullmatch(token)
    return m.groups() if m else ("", token, "")


_CORE = re.compile(r"(['‘’]*)(.*?)((?:['’]s)?['’.?]*)")


def candidates(word: str, known, model: Perceptron) -> list[tuple[str, list[tuple[str, int]]]]:
    """(word, features) of the word as it is and of the results of operations on its characters that clean text has, or that are numbers."""
    own = known(word.lower())
    letter = any(c.isalpha() for c in word)
    odd = letter and any(c in "0123456789|!" for c in word)
    kind = f"odd{odd}&name{word[:1].isupper() and word[1:].islower()}&caps{word.isupper()}"
    plus = lambda *f: [(x, 1) for x in f]
    out = [(word, plus(f"keep&own{own > 0}", f"keep&own{min(own, 6)}", f"keep&own{own > 0}&{kind}"))]
    if (n := as_number(word)) is not None:
        out.append((n, plus("number", f"number&own{own > 0}", f"number&digits{any(c.isdigit() for c in word)}&len{min(len(word), 3)}", *[f"number{c}" for c in word if not c.isdigit()])))
    if own or len(word) < 2 or not letter:
        return out
    some = groups(word)
    seen = {word}

    def reached(new: str, used: list) -> None:
        if new not in seen:
            seen.add(new)
            if level := known(new.lower()):
                own_features = plus(f"to{min(level, 8)}", f"n{len(used)}", f"n{len(used)}&to{min(level, 3)}&{kind}")
                out.append((new, own_features + [x for g in used for x in group_features(word, g)]))

    for g in some:
        reached(word[: g[0]] + g[2] + word[g[1] :], [g])
    if len(out) == 1:
        if len(some) ** 2 > 2 * PAIRS:
            scores = {g: model.score(group_features(word, g)) for g in set(some)}
            some = sorted(some, key=lambda g: -scores[g])[: int(PAIRS**0.5)]
        for k, g in enumerate(some):
            for h in some[k + 1 :]:
                x, y = (g, h) if g[0] <= h[0] else (h, g)
                if x[1] <= y[0]:
                    reached(word[: x[0]] + x[2] + word[x[1] : y[0]] + y[2] + word[y[1] :], [x, y])
    return out


# --- noise for training --------------------------------------------------------------------


def misread(word: str, rng: random.Random) -> str:
    places = [(i, g, b) for g, b in CONFUSIONS for i in range(len(word)) if word.startswith(g, i)]
    if not places:
        return word
    i, g, b = rng.choice(places)
    return word[:i] + b + word[i + len(g) :]


def title(rng: random.Random, words: list[str]) -> str:
    """A publication's name, made of words of the texts."""
    return " ".join(w.capitalize() for w in rng.sample(words, min(len(words), rng.randint(2, 4)))) or "Notes"


# How the parts of a header may be put together: n name, d date, p page, w a wide gap.
HEADERS = ["{p}{w}{n}{w}{d}", "{n}{w}{p}", "{n} | {d} | Page {p}", "{n}", "{d}{w}{n}{w}{p}", "{n}{w}{d}", "{d}{w}{n}", "{n} (continued)", "{n} - {d}", "{n} — Page {p}", "spaced"]


NAMED = [" See page {p} of the {n}.", " More is in the {n}.", " As told by the {n}."]


def header(rng: random.Random, words: list[str], forms: list[str] = HEADERS) -> str:
    name, form = title(rng, words), rng.choice(forms)
    name = name.upper() if rng.random() < 0.4 else name
    if form == "spaced":
        return "   ".join(" ".join(w) for w in name.upper().split())
    return form.format(n=name, d=f"{rng.choice(_MONTHS)} {rng.randint(1, 28)}, {rng.randint(1990, 2030)}", p=rng.randint(1, 60), w=" " * rng.randint(2, 6))


def page_number(rng: random.Random) -> str:
    n, of = rng.randint(1, 60), rng.randint(60, 99)
    return rng.choice([f"{n}", f"— {n} —", f"{n} / {of}", f"Page {n}", f"[{n}]", f"{' ' * rng.randint(3, 12)}- {n} -", f"{' ' * rng.randint(3, 12)}{n}", f"Page {n} of {of}", f"p. {n}", f"- {n} -"]) + ("\f" if rng.random() < 0.1 else "")


def laid_out(text: str, rng: random.Random, words: list[str], forms: list[str] = HEADERS) -> tuple[list[tuple[str, str]], list[tuple[str, str, str, str]]]:
    """Lines with their labels and divided words (left, sign, right, label) of a clean text as scanned pages."""
    width, page = rng.randint(48, 88), rng.randint(6, 30)
    lines: list[tuple[str, str]] = []
    breaks = []
    for paragraph in text.split("\n"):
        now = ""
        for word in paragraph.split():
            room = width - len(now) - 1
            if now and len(word) > room:
                own = [m.start() + 1 for m in re.finditer("(?<=[a-z])-(?=[a-z])", word) if m.start() + 1 <= room]
                if own:
                    breaks.append((word[: own[-1] - 1], "-", word[own[-1] :], "keep and join"))
                    lines.append((f"{now} {word[: own[-1]]}", "body"))
                    now, word = "", word[own[-1] :]
                elif rng.random() < 0.5 and word.rstrip(".,").isalpha() and len(word) > 4 and room > 3:
                    cut = min(rng.randint(2, len(word) - 2), room - 1)
                    sign = rng.choice("---¬­")
                    breaks.append((word[:cut], sign, word[cut:], "delete and join"))
                    lines.append((f"{now} {word[:cut]}{sign}", "body"))
                    now, word = "", word[cut:]
                else:
                    lines.append((now, "body"))
                    now = ""
            now = f"{now} {word}" if now else word
        lines.append((now, "body"))
        if rng.random() < 0.15:
            lines.append(("", "body"))
    out = []
    for k, x in enumerate(lines):
        # at a page's turn, or where a page was cut and put together again
        if rng.random() < (0.7 if k % page == 0 else 0.08):
            out.append((header(rng, words, forms), "header") if rng.random() < 0.5 else (page_number(rng), "pageno"))
        out.append(x)
    if rng.random() < 0.3:
        out.append((page_number(rng), "pageno"))
    return out, breaks


def train(texts: list[str], rows: list[str], sketch: Sketch | Asked, forms: list[str] = HEADERS, seed: int = 7) -> dict[str, Perceptron | Tagger]:
    """The three perceptrons, from clean texts and clean table texts."""
    rng = random.Random(seed)
    lines, breaks, chars = Tagger(_LINE_LABELS), Tagger(_BREAK_LABELS), Perceptron()
    known = lambda w: sketch.level("w" + w)
    examples = []
    names = sorted({w for t in texts for w in words_of(t) if w.isalpha() and len(w) > 3})

    def line_examples(page: list[tuple[str, str]], seen_of: dict[str, list[int]], cleans: bool) -> None:
        raw = [x for x, _ in page]
        width, last = max(map(len, raw), default=0), -1
        for i, (x, label) in enumerate(page):
            if x.strip():
                clean = int(cleans and label == "body" and rng.random() < 0.9)
                examples.append((lines, line_features(raw, i, width, rng.choice(seen_of[label]), clean, i - last), label))
                last = i if doubtful(x) else last

    for t in texts:
        # the name in running text is no header
        page, divided = laid_out(t + (rng.choice(NAMED).format(p=rng.randint(2, 40), n=title(rng, names)) if rng.random() < 0.6 else ""), rng, names, forms)
        page = [(misread(x, rng) if label == "body" and rng.random() < 0.2 else x, label) for x, label in page]
        line_examples(page, {"header": [0, 3, 3, 4, 5], "pageno": [5], "body": [0, 0, 0, 0, 0, 3]}, False)
        for left, sign, right, label in divided:
            a, b = left.split()[-1] if left.split() else left, right.split()[0]
            hide = rng.random() < 0.2 and label == "delete and join"
            examples.append((breaks, break_features(a, sign, core(b)[1].rstrip(".,"), (lambda w: 0) if hide else known), label))
        for w in sorted(set(words_of(t))):
            # words that fall into two words, and compounds
            for k in range(2, len(w) - 1) if w.isalpha() else ():
                if known(w[:k]) > 1 and known(w[k:]) > 1:
                    examples.append((breaks, break_features(w[:k], "-", w[k:], known), "delete and join"))
            if w.count("-") == 1:
                examples.append((breaks, break_features(*w.partition("-"), known), "keep and join"))
        for token in sorted(set(_TOKEN.findall(t))):
            word = core(token)[1]
            if not word:
                continue
            bad = misread(word, rng) if rng.random() < 0.6 else word
            if bad != word and rng.random() < 0.15:
                bad = misread(bad, rng)
            some = candidates(bad, known, chars)
            if word in (named := [c for c, _ in some]):
                examples.append((chars, [f for _, f in some], named.index(word)))
            if word[:1].isupper() and rng.random() < 0.3:  # a name that clean text doesn't have
                examples.append((chars, [f for _, f in candidates(word, lambda w, own=word.lower(): 0 if w == own else known(w), chars)], 0))
        for m in re.findall(r"\d[\d.,]*\d", t):
            bad = misread(m, rng)
            some = candidates(bad, known, chars)
            if bad != m and m in (named := [c for c, _ in some]):
                examples.append((chars, [f for _, f in some], named.index(m)))
    for t in rows:
        page = [(x, "body") for x in t.split("\n")]
        for _ in range(2):
            page.insert(rng.randint(0, len(page)), (header(rng, names, forms), "header") if rng.random() < 0.5 else (page_number(rng), "pageno"))
        line_examples(page, {"header": [0, 3, 3, 4, 5], "pageno": [0, 3, 5], "body": [0, 3, 5]}, True)
    for _ in range(6):
        rng.shuffle(examples)
        for model, example, right in examples:
            model.learn(example, right)
    return {"lines": lines.averaged(), "breaks": breaks.averaged(), "chars": chars.averaged()}


# --- editing -------------------------------------------------------------------------------


class Editor:
    """Applies trained perceptrons to texts."""

    def __init__(self, models: dict[str, Perceptron | Tagger], sketch: Sketch | Asked) -> None:
        self.models, self.sketch = models, sketch
        keep = isinstance(sketch, Sketch)  # what was only asked for isn't known yet
        held = lambda n: functools.lru_cache(maxsize=n) if keep else lambda f: f
        self.level = lambda w: sketch.level("w" + w)
        self.known = held(100_000)(self.level)
        self.word = held(200_000)(self._word)
        self.like = held(50_000)(lambda x: (sketch.level("s" + x), sketch.level("c" + x)))
        # parts of lines that stay as they are, by whether the line closes a bracket
        self.fine: tuple[set[str], set[str]] = (set(), set())

    def _word(self, token: str) -> str:
        """The token as it was meant."""
        a, w, z = core(token)
        if not w or _FIGURES.fullmatch(w) or (self.known(w.lower()) and as_number(w) is None):
            return token
        some = candidates(w, self.level, self.models["chars"])
        if len(some) > 1:
            k = self.models["chars"].best([f for _, f in some])
            if k:
                return a + some[k][0] + z
        if "-" in w.strip("-"):
            parts = [self._word(p) if p else p for p in w.split("-")]
            return a + "-".join(parts) + z
        return token

    def label(self, lines: list[str], i: int, width: int, gap: int) -> str:
        key = letters(lines[i])
        seen, clean = self.like(key) if key else (5, 0)
        if clean:
            return "body"  # clean text, which has no furniture, has the line
        # a page number's line holds nothing else
        among = _LINE_LABELS if _PAGE.fullmatch(lines[i].strip()) else _LINE_LABELS[:2]
        return self.models["lines"].best(line_features(lines, i, width, seen, clean, gap), among)

    def edit(self, text: str) -> tuple[str, set[str]]:
        """The repaired text, and the kinds of noise that were in it."""
        kinds: set[str] = set()
        lines = text.split("\n")
        width, last = max(map(len, lines)), -1
        body = []
        for i, line in enumerate(lines):
            if doubtful(line):
                label = self.label(lines, i, width, i - last)
                last = i
                if label != "body":
                    kinds.add(label)
                    continue
            body.append(line.strip("\f"))
        paragraphs: list[tuple[str, bool, bool]] = []  # text, whether a table's line, whether a heading
        parts: list[str] = []  # the lines of the paragraph so far
        rows = False

        def close() -> None:
            if parts:
                paragraphs.append(("".join(parts), False, False))
                parts.clear()

        removed = len(body) < len(lines)
        for i, line in enumerate(body):
            x = line.strip()
            if not x:
                # what is left of furniture that stood between blank lines, in the middle of a sentence
                if removed and parts and parts[-1][-1:] not in ".:!?\"”" and neighbour(body, i, 1)[:1].islower():
                    continue
                close()
                rows = False
                continue
            heading, row = x[0] == "[" and bool(_BRACKETS.match(x)), is_row(x)
            if heading or row or (rows and not parts and len(x) < 30 and is_row(f"{x}  0  0")):
                close()
                paragraphs.append((self.tokens(line.rstrip(), kinds), row, heading))
                rows = True
                continue
            if parts:
                last_part = parts[-1]
                m = _DIVIDED.search(last_part[-80:]) if last_part[-1:] in SIGNS else None
                right = _FIRST.match(x) if m else None
                if right:
                    label = "delete and join" if m[2] in "¬­" else self.models["breaks"].best(break_features(core(m[1])[1], m[2], core(right[0])[1].rstrip("."), self.fuzzy))
                    if label == "delete and join":
                        kinds.add("hyphen")
                        parts[-1] = last_part[:-1]
                    parts.append(x)
                else:
                    parts.append(" " + x)
            else:
                parts.append(x)
        close()
        out, before_row, before_heading = [], False, False
        for p, row, heading in paragraphs:
            q = p if row or heading else self.tokens(p, kinds)
            row = row or is_row(q)
            if out:
                out.append("\n" if (row and before_row) or before_heading else "\n\n")
            out.append(q)
            before_row, before_heading = row, heading
        return "".join(out), kinds

    def fuzzy(self, word: str) -> int:
        """How often clean text has the word, or what it was misread from."""
        return self.known(word) or self.known(self.word(word).lower())

    def tokens(self, line: str, kinds: set[str]) -> str:
        closed = ")" in line
        fine, pattern, chunks = self.fine[closed], _TOKEN if closed else _OPEN, line.split(" ")
        if fine.issuperset(chunks):
            return line
        if len(fine) > 500_000:
            fine.clear()
        for k, chunk in enumerate(chunks):
            if chunk not in fine:
                new = pattern.sub(lambda m: self.word(m[0]), chunk)
                if new != chunk:
                    kinds.add("char")
                    chunks[k] = new
                elif isinstance(self.sketch, Sketch):
                    fine.add(chunk)
        return " ".join(chunks)


_DIVIDED = re.compile(rf"(\S*\w)([{SIGNS}])$")
_FIRST = re.compile(r"[^\s,;:]+")


# --- over tables ---------------------------------------------------------------------------


def key_counts(texts: DataFrame, clean_also: DataFrame | None) -> DataFrame:
    """(key, n): w and a word of clean texts, c and the letters of a clean table's line, s and those of a doubtful line of scanned texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n: Counter = Counter()
            tokens: Counter = Counter()
            for text, scanned in zip(pdf.text, pdf.scanned, strict=True):
                if scanned:
                    n.update({"s" + k for x in text.split("\n") if doubtful(x) and (k := letters(x))})
                else:
                    tokens.update(_TOKEN.findall(text))
                    if "\n" in text:
                        n.update({"c" + k for x in text.split("\n") if is_row(x) and (k := letters(x))})
            for t, times in tokens.items():
                for w in token_words(t):
                    n["w" + w] += times
            if n:
                yield pd.DataFrame({"key": list(n), "n": list(n.values())})

    whole = texts.select("text", "scanned") if clean_also is None else texts.select("text", "scanned").unionByName(clean_also.select("text", F.lit(False).alias("scanned")))
    counts = whole.filter("text is not null").mapInPandas(count, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    # lines of few texts say nothing
    return counts.filter(~F.col("key").startswith("s") | (F.col("n") >= REPEATED))


def sketched(counts: DataFrame, keys: int) -> Sketch:
    """The counts in SPARE cells a key; at most MOST_CELLS, in blocks of cells by task."""
    cells = max(LEAST_CELLS, 1 << (SPARE * keys - 1).bit_length())
    block = cells // 64

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            level = [1 + int(math.log2(x)) for x in pdf.n]
            at = [(p, v) for k, v in zip(pdf.key, level, strict=True) for p in Sketch.places(k, cells)]
            yield pd.DataFrame({"block": [p // block for p, _ in at], "cell": [p % block for p, _ in at], "level": [v for _, v in at]})

    def filled(pdf: pd.DataFrame) -> pd.DataFrame:
        part = np.zeros(block, dtype=np.uint8)
        np.maximum.at(part, pdf.cell.to_numpy(), pdf.level.to_numpy().astype(np.uint8))
        return pd.DataFrame({"block": [pdf.block.iloc[0]], "cells": [zlib.compress(part.tobytes(), 1)]})

    out = np.zeros(cells, dtype=np.uint8)
    # 64 rows, of MOST_CELLS bytes at most
    for r in counts.mapInPandas(place, "block int, cell int, level int").groupBy("block").applyInPandas(filled, "block int, cells binary").toLocalIterator():
        out[r.block * block : (r.block + 1) * block] = np.frombuffer(zlib.decompress(r.cells), dtype=np.uint8)
    return Sketch(out)


def training_texts(texts: DataFrame, train_texts: int) -> tuple[list[str], list[str]]:
    """(texts, tables): a bounded sample of clean texts."""
    clean = texts.filter("not scanned and text is not null").select("text")
    sample = [r.text for r in clean.orderBy(F.xxhash64("text"), "text").limit(2 * train_texts).collect()]
    rows = [t for t in sample if any(is_row(x) for x in t.split("\n"))]
    return [t for t in sample if t not in rows][:train_texts], rows[:train_texts]


def exact_levels(texts: DataFrame, counts: DataFrame, ask, columns: str, scratch: Scratch) -> DataFrame:
    """texts with the column levels: the counts' level of every key that ask(text, levels) looks up, by joins alone.

    ask tells what is missed; as answers lead to further questions it is repeated until none is left.
    """
    marked = texts.withColumn("uid", F.monotonically_increasing_id())
    held = stored(marked.withColumn("levels", F.create_map().cast("map<string,int>")), "asked", scratch)

    def missed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(u, k) for u, t, m in zip(pdf.uid, pdf.text, pdf.levels, strict=True) for k in ask(t, dict(m))], columns=["uid", "key"])

    while True:
        wanted = stored(held.select("uid", "text", "levels").mapInPandas(missed, "uid long, key string"), "missed", scratch)
        if not wanted.take(1):
            return held.select(*columns.split(","), "levels")
        level = F.coalesce(F.floor(F.log2("n")).cast("int") + 1, F.lit(0))
        answers = wanted.join(counts, "key", "left").groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("key", level.alias("level")))).alias("more"))
        held = stored(held.join(answers, "uid", "left").withColumn("levels", F.map_concat("levels", F.coalesce("more", F.create_map().cast("map<string,int>")))).drop("more"), "asked", scratch)


def long_form(records: DataFrame, record_id: str, fields: list[str]) -> DataFrame:
    """(record, field, text, scanned)"""
    kind = records.schema[record_id].dataType.simpleString()

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            columns = [pdf[f"f{k}"] for k in range(len(fields))]
            scanned = [any(isinstance(t, str) and not _is_table(t) and wrapped(t) for t in row) for row in zip(*columns, strict=True)]
            yield pd.concat([pd.DataFrame({"record": pdf["id"], "field": f, "text": c, "scanned": scanned}) for f, c in zip(fields, columns, strict=True)], ignore_index=True)

    named = [F.col(f).alias(f"f{k}") for k, f in enumerate(fields)]
    return records.select(F.col(record_id).alias("id"), *named).mapInPandas(mark, f"record {kind}, field string, text string, scanned boolean")


def _is_table(text: str) -> bool:
    lines = [x for x in text.split("\n") if x.strip()]
    return sum(map(is_row, lines)) * 2 > len(lines)


def repaired(records: DataFrame, record_id: str, fields: list[str], clean_fields: list[str], train_texts: int = TRAIN_TEXTS, most_cells: int = MOST_CELLS) -> DataFrame:
    """(record_id, field_name, text, kinds): each non-null text of each record, repaired, with the kinds of noise it had."""
    spark = records.sparkSession
    kind = records.schema[record_id].dataType.simpleString()
    schema = f"{record_id} {kind}, field_name string, text string, kinds array<string>"
    also = records.select(F.explode(F.array(*[F.col(f) for f in clean_fields])).alias("text")) if clean_fields else None
    with Scratch(spark) as scratch:
        texts = stored(long_form(records, record_id, fields).filter("text is not null"), "texts", scratch)
        counts = stored(key_counts(texts, also), "counts", scratch)
        keys, sample = counts.count(), training_texts(texts, train_texts)
        if SPARE * keys <= most_cells:
            sketch = sketched(counts, keys)
            models = {k: (getattr(m, "labels", None), dict(m.w)) for k, m in train(*sample, sketch).items()}
            held = spark.sparkContext.broadcast((models, sketch.cells))  # MOST_CELLS bytes at most and the perceptrons' weights
            return stored(texts.mapInPandas(_editing(lambda: held.value[0], lambda: Sketch(np.frombuffer(held.value[1], dtype=np.uint8)), record_id), schema), "repaired")
        # the training texts, too, ask for what they need
        levels: dict[str, int] = {}
        while True:
            asked = Asked(levels)
            models = {k: (getattr(m, "labels", None), dict(m.w)) for k, m in train(*sample, asked).items()}
            if not asked.missed:
                break
            need = spark.createDataFrame([(k,) for k in asked.missed], "key string")  # of TRAIN_TEXTS texts
            levels |= {r.key: 0 if r.n is None else 1 + int(math.log2(r.n)) for r in need.join(counts, "key", "left").select("key", "n").collect()}

        def ask(text: str, known: dict[str, int]) -> set[str]:
            asked = Asked(known)
            _ready(models, asked).edit(text)
            return asked.missed

        scanned = exact_levels(texts.filter("scanned and text != ''"), counts, ask, "record,field,text,scanned", scratch)
        rest = texts.filter("not scanned or text = ''").withColumn("levels", F.lit(None).cast("map<string,int>"))
        return stored(scanned.unionByName(rest).mapInPandas(_editing(lambda: models, None, record_id), schema), "repaired")


def _ready(models: dict, sketch: Sketch | Asked) -> Editor:
    return Editor({k: Tagger(labels, w) if labels else Perceptron(w) for k, (labels, w) in models.items()}, sketch)


def _editing(models, sketch, record_id: str):
    """Edits batches of (record, field, text, scanned) with a sketch, or with the column levels where there is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _ready(models(), sketch()) if sketch else None
        for pdf in batches:
            with_levels = pdf.levels if sketch is None else [None] * len(pdf)
            done = [(own or _ready(models(), Asked(dict(m)))).edit(t) if s and t else (t, set()) for t, s, m in zip(pdf.text, pdf.scanned, with_levels, strict=True)]
            yield pd.DataFrame({record_id: pdf.record, "field_name": pdf.field, "text": [t for t, _ in done], "kinds": [sorted(k) for _, k in done]})

    return run
