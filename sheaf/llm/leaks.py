"""Passages of test items inside a corpus, by Wu-Manber multi-pattern search.

Every run of MIN_WORDS consecutive words of an item is a pattern, so a document leaks an
item exactly when it holds one of the item's patterns. Texts are scanned as their words in
lower case, one space between; a shift table over blocks of characters tells how far the
next possible end of a pattern is at least, the block that ends a pattern's searched part
selects a bucket, and direct comparison with the patterns of that bucket confirms.

The items are a stated query set. Up to BLOCK_ITEMS of them are one block, whose patterns
are sent to the executors for one pass over the corpus. More items take a pass for each
block; a block's findings are written before the next one is fetched, so neither the driver
nor an executor ever holds more than one. The corpus is never shuffled. Defined results: null texts hold nothing;
an item of fewer than MIN_WORDS words can't leak; repeated document rows give one row a
document and item; whole texts are scanned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.runtime import stored

MIN_WORDS = 13
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 12
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> str:
    """The words of text, lower case, with one space before, between and after."""
    return f" {' '.join(_WORD.findall(text)).lower()} "


class WuManber:
    """Finds which of many patterns occur in a text."""

    def __init__(self, patterns: list[str], block: int = BLOCK_CHARS) -> None:
        self.length = min(map(len, patterns), default=0)
        self.block = b = max(1, min(block, self.length))
        self.far = self.length - b + 1
        self.shift: dict[str, int] = {}
        self.ends: dict[str, list[int]] = {}
        self.patterns = patterns
        for k, p in enumerate(patterns):
            for end in range(b, self.length + 1):
                x = p[end - b : end]
                self.shift[x] = min(self.shift.get(x, self.far), self.length - end)
            self.ends.setdefault(p[self.length - b : self.length], []).append(k)

    def occurring(self, text: str) -> set[int]:
        """Numbers of the patterns that occur."""
        found: set[int] = set()
        if not self.patterns:
            return found
        shift, far, b, m, end, n = self.shift.get, self.far, self.block, self.length, self.length, len(text)
        while end <= n:
            x = text[end - b : end]
            if step := shift(x, far):
                end += step
                continue
            for k in self.ends.get(x, ()):
                if text.startswith(self.patterns[k], end - m):
                    found.add(k)
            end += 1
        return found


def item_patterns(items: list[tuple[int, str]]) -> tuple[list[str], list[list[int]]]:
    """Distinct patterns and the items that each belongs to."""
    of: dict[str, set[int]] = {}
    for item, text in items:
        w = words(text).split()
        for i in range(len(w) - MIN_WORDS + 1):
            of.setdefault(f" {' '.join(w[i : i + MIN_WORDS])} ", set()).add(item)
    return list(of), [sorted(x) for x in of.values()]


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id): the documents that hold at least MIN_WORDS consecutive words of an item."""
    items = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).filter("i is not null and t is not null").distinct()
    corpus = docs.select(F.col(doc_id).alias(doc_id), F.col(text).alias("text")).filter("text is not null")
    schema = f"{doc_id} {docs.schema[doc_id].dataType.simpleString()}, {item_id} long"
    blocks = max(1, -(-items.count() // block_items))

    def scan(block: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            patterns, owners = item_patterns(block)
            search = WuManber(patterns)
            for pdf in batches:
                hits = [(d, i) for d, t in zip(pdf[doc_id], pdf.text, strict=True) for i in sorted({i for k in search.occurring(words(t)) for i in owners[k]})]
                yield pd.DataFrame(hits, columns=[doc_id, item_id])

        return corpus.mapInPandas(run, schema)

    out = None
    for k in range(blocks):
        block = [(r.i, r.t) for r in items.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k).collect()]  # BLOCK_ITEMS on average
        found = scan(block).distinct()
        found = stored(found, "leaks") if blocks > 1 else found
        out = found if out is None else out.unionByName(found)
    return out
