"""Long spans that stand word for word in several records, by prefix-partitioned suffix trees.

A suffix tree over all suffixes of a corpus isn't needed to find repeats of MIN_CHARS or
more: it is enough to have, of every stretch of MIN_CHARS characters, one suffix that any
other copy of the stretch has too. Anchors are chosen by content (of each stretch the
position with the least hash of its next PREFIX characters), so equal stretches have the
same anchor, and each text of n characters has about 2n / (MIN_CHARS - PREFIX) of them.

1. The anchors' prefixes are counted; prefixes of a single record fall away.
2. The suffixes at the remaining anchors are partitioned by prefix. A group holds for each
   suffix the characters before and after its anchor as far as a stretch can reach.
3. In each group the suffix tree over what follows the anchors (sorted suffixes and their
   common prefixes; an internal node is a run with a common depth) is walked; in each node
   the longest common part before the anchors, between different records, is found by
   sorting the reversed left sides. Node depth plus left part of MIN_CHARS or more is a
   repeat, given back as an interval of each record.
4. A prefix that more than group_limit suffixes share isn't put into one group as it is.
   Suffixes with the same characters on both sides become one context, with partial results
   on the map side, so that copies, however many, are one leaf. Where more than group_limit
   contexts are left, their prefix is lengthened, to WINDOW characters that begin STEP
   characters apart before the anchor: every stretch around the anchor holds one of these
   windows, and each window's group is a tree of its own. Where a window, too, is shared by
   more contexts than that, the prefix is lengthened to the whole stretch for each of the STEP
   stretches that hold the window: a node at that depth is a repeat whatever lies below it.
   What is found in a context is then found in all its suffixes.
5. Intervals of a record are merged and their characters counted.

Nothing is dropped: each step takes what is too many for the one before. Only prefix
digests, and texts of records with a shared prefix, are shuffled. Defined results: null
texts and texts shorter than MIN_CHARS share nothing; a repeat within one record alone
doesn't count; rows that repeat a record id with the same text are one record; positions
are code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.runtime import Scratch, stored

MIN_CHARS = 320
PREFIX = 64
GROUP_LIMIT = 4096
STEP = 64
WINDOW = MIN_CHARS - STEP
_PIECE = 1 << 20
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class _Hash:
    """Rolling polynomial hashes modulo 2^64 of all runs of a length, for arrays up to a size."""

    def __init__(self, base: int, size: int) -> None:
        b, inverse = np.uint64(base % 2**64), np.uint64(pow(base, -1, 2**64))
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, inverse)]), dtype=np.uint64)

    def runs(self, chars: np.ndarray, length: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            total = np.zeros(len(chars) + 1, dtype=np.uint64)
            np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * self.up[: len(chars)], out=total[1:])
            return _mixed((total[length:] - total[:-length]) * self.down[: len(chars) - length + 1])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    grid = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    grid[: len(x)] = x
    grid = grid.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the text, position, hash of the prefix) of the chosen positions."""
    rolling = None
    at = 0
    while at < len(texts):
        some, size = [], 0
        while at < len(texts) and (not some or size + len(texts[at]) <= _PIECE):
            some.append((at, texts[at]))
            size += len(texts[at])
            at += 1
        pieces = [(k, s, t[s : s + _PIECE + MIN_CHARS - 1]) for k, t in some for s in range(0, max(1, len(t) - MIN_CHARS + 1), _PIECE) if len(t) >= MIN_CHARS]
        for lo in range(0, len(pieces), 1 if size > 2 * _PIECE else len(pieces) or 1):
            part = pieces[lo : lo + (1 if size > 2 * _PIECE else len(pieces))]
            chars = np.frombuffer("".join(t for _, _, t in part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            ends = np.cumsum([len(t) for _, _, t in part])
            if rolling is None or len(rolling.up) <= len(chars):
                rolling = _Hash(_BASES[0], max(len(chars), _PIECE))
            h = rolling.runs(chars, PREFIX)
            # the hash's upper bits, ties to the right
            key = (h & ~np.uint64((1 << 24) - 1)) | (np.uint64((1 << 24) - 1) - np.arange(len(h), dtype=np.uint64))
            least = _sliding_min(key, MIN_CHARS - PREFIX + 1)
            whole = np.ones(len(least), dtype=bool)
            for e in ends[:-1]:
                whole[max(0, e - MIN_CHARS + 1) : e] = False
            chosen = np.unique(np.uint64((1 << 24) - 1) - (least[whole] & np.uint64((1 << 24) - 1))).astype(np.int64)
            piece = np.searchsorted(ends, chosen, side="right")
            starts = np.concatenate([[0], ends[:-1]])
            yield np.array([k for k, _, _ in part])[piece], chosen - starts[piece] + np.array([s for _, s, _ in part])[piece], h[chosen].astype(np.int64)


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _left_parts(leaves: list[tuple]) -> list[int]:
    """For each leaf (left side reversed, -, record or None for several) the longest left part in common with another record, -1 if none."""
    order = sorted(range(len(leaves)), key=lambda i: leaves[i][0])
    best = [-1] * len(leaves)
    steps = [_common(leaves[a][0], leaves[b][0]) for a, b in zip(order, order[1:], strict=False)]
    for seq, gaps in ((order, steps), (order[::-1], steps[::-1])):
        last, other = (leaves[seq[0]][2], 1 << 30), (0, -1)
        for i, gap in zip(seq[1:], gaps, strict=True):
            doc = leaves[i][2]
            last, other = (last[0], min(last[1], gap)), (other[0], min(other[1], gap))
            near = last[1] if doc is None or last[0] is None or last[0] != doc else other[1]
            best[i] = max(best[i], near)
            if doc is None or last[0] is None or last[0] != doc:
                other = last
            last = (doc, 1 << 30)
    return best


def group_repeats(group: list[tuple[int, int, str, str]], least: int = MIN_CHARS) -> list[tuple[int, int, int]]:
    """Intervals (record, start, end) shared between records, of suffixes (record, anchor, before, after) that share their prefix.

    before is up to the anchor, after from the anchor on.
    """
    same: dict[tuple[str, str], list[tuple[int, int]]] = {}
    for doc, at, before, after in group:
        same.setdefault((before, after), []).append((doc, at))
    leaves = [(before[::-1], after, None if len({d for d, _ in where}) > 1 else where[0][0], where) for (before, after), where in same.items()]
    return tree_repeats(leaves, least)


def tree_repeats(leaves: list[tuple[str, str, object, list[tuple]]], least: int = MIN_CHARS) -> list[tuple]:
    """Intervals (owner, start, end) of the leaves (left side reversed, right side, record or None for several, [(owner, anchor)])."""
    found: list[tuple] = []
    for before, after, doc, where in leaves:
        if doc is None and len(before) + len(after) >= least:
            found += [(d, at - len(before), at + len(after)) for d, at in where]
    if len(leaves) < 2:
        return found
    leaves = sorted(leaves, key=lambda x: x[1])
    gaps = [_common(a[1], b[1]) for a, b in zip(leaves, leaves[1:], strict=False)]
    stack = [(0, len(leaves))]
    while stack:
        lo, hi = stack.pop()
        if hi - lo < 2:
            continue
        depth = min(gaps[lo : hi - 1])
        node = leaves[lo:hi]
        docs = {x[2] for x in node}
        if len(docs) > 1 or None in docs:
            for left, leaf in zip(_left_parts(node), node, strict=True):
                if left >= 0 and left + depth >= least:
                    found += [(d, at - left, at + depth) for d, at in leaf[3]]
            start = lo
            for i in range(lo, hi - 1):
                if gaps[i] == depth:
                    stack.append((start, i + 1))
                    start = i + 1
            stack.append((start, hi))
    return found


def _anchors_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids = pdf.doc_id.to_numpy()
        for text, at, h in anchors(list(pdf.text)):
            yield pd.DataFrame({"h": h, "doc_id": ids[text], "at": at.astype("int32")})


def _sides_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    reach = MIN_CHARS - PREFIX
    for pdf in batches:
        for lo in range(0, len(pdf), 200):
            rows = [(x.h, x.big, d, x.at, t[max(0, x.at - reach) : x.at], t[x.at : x.at + MIN_CHARS]) for d, t, xs in zip(pdf.doc_id[lo : lo + 200], pdf.text[lo : lo + 200], pdf["marks"][lo : lo + 200], strict=True) for x in map(_At, xs)]
            yield pd.DataFrame(rows, columns=["h", "big", "doc_id", "at", "before", "after"])


class _At:
    __slots__ = ("at", "big", "h")

    def __init__(self, row) -> None:
        self.at, self.h, self.big = int(row["at"]), int(row["h"]), bool(row["big"])


def _repeats_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, group = None, []
    for pdf in batches:
        found = []
        for h, doc, at, before, after in zip(pdf.h, pdf.doc_id, pdf["at"], pdf.before, pdf.after, strict=True):
            if h != now:
                found += group_repeats(group) if len(group) > 1 else []
                now, group = h, []
            group.append((doc, at, before, after))
        yield pd.DataFrame(found, columns=["doc_id", "start", "end"])
    if len(group) > 1:
        yield pd.DataFrame(group_repeats(group), columns=["doc_id", "start", "end"])


def _context_repeats_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repeats in the contexts of each group, as intervals about the anchor."""
    columns = ["context", "start", "end"]
    now, leaves = None, []
    for pdf in batches:
        found = []
        for g, c, lo, hi, before, after in zip(pdf.g, pdf.context, pdf.lo, pdf.hi, pdf.before, pdf.after, strict=True):
            if g != now:
                found += tree_repeats(leaves)
                now, leaves = g, []
            leaves.append((before[::-1], after, lo if lo == hi else None, [(c, 0)]))
        yield pd.DataFrame(found, columns=columns)
    if leaves:
        yield pd.DataFrame(tree_repeats(leaves), columns=columns)


def _stretches_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The stretches that hold a window of a context, with two digests each."""
    rolls = [_Hash(b, 2 * MIN_CHARS) for b in _BASES]
    for pdf in batches:
        out = []
        for c, lo, hi, j, before, after in zip(pdf.context, pdf.lo, pdf.hi, pdf.j, pdf.before, pdf.after, strict=True):
            most = min((j + 1) * STEP - 1, len(before), MIN_CHARS - PREFIX)
            first = max(j * STEP, MIN_CHARS - len(after))
            if first <= most:
                chars = np.frombuffer((before[len(before) - most :] + after[: MIN_CHARS - first]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                a, b = (r.runs(chars, MIN_CHARS).astype(np.int64) for r in rolls)
                out.append(pd.DataFrame({"a": a, "b": b, "context": c, "lo": lo, "hi": hi, "start": (np.arange(len(a)) - most).astype("int32")}))
            if len(out) >= 400:
                yield pd.concat(out, ignore_index=True)
                out = []
        if out:
            yield pd.concat(out, ignore_index=True)


def _large_repeats(sides: DataFrame, kind: str, group_limit: int, scratch: Scratch) -> DataFrame:
    """(doc_id, start, end) of the suffixes (h, doc_id, at, before, after) whose prefixes are shared by too many for a group."""
    context = F.md5(F.concat_ws("\u0001", F.col("h").cast("string"), F.length("before").cast("string"), "before", "after").cast("binary"))
    named = sides.withColumn("context", context)
    contexts = stored(named.groupBy("context").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.first("h").alias("h"), F.first("before").alias("before"), F.first("after").alias("after")), "contexts", scratch)
    few = lambda df, key: df.groupBy(key).agg((F.count(F.lit(1)) <= group_limit).alias("few"))
    columns = ["g", "context", "lo", "hi", "before", "after"]
    by_prefix = contexts.join(few(contexts, "h"), "h")
    trees = by_prefix.filter("few").withColumn("g", F.col("h")).select(*columns)
    j = F.col("j")
    windows = by_prefix.filter("not few").drop("few").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit((MIN_CHARS - PREFIX) // STEP)))).filter((F.length("before") >= j * STEP) & (F.length("after") >= F.lit(WINDOW) - j * STEP))
    window = F.concat(F.expr(f"right(before, j * {STEP})"), F.expr(f"left(after, {WINDOW} - j * {STEP})"))
    windows = stored(windows.withColumn("g", F.xxhash64("h", "j", window)).select(*columns, "j"), "windows", scratch)
    by_window = windows.join(few(windows, "g"), "g")
    trees = trees.unionByName(by_window.filter("few").select(*columns))
    about = "context string, start int, end int"
    found = trees.repartition("g").sortWithinPartitions("g").mapInPandas(_context_repeats_of, about)
    stretches = stored(by_window.filter("not few").select("context", "lo", "hi", "j", "before", "after").mapInPandas(_stretches_of, f"a long, b long, context string, lo {kind}, hi {kind}, start int"), "stretches", scratch)
    often = stretches.groupBy("a", "b").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi").select("a", "b")
    found = found.unionByName(stretches.join(often, ["a", "b"], "left_semi").select("context", "start", (F.col("start") + MIN_CHARS).alias("end")))
    # a context's intervals are merged before its suffixes, which may be very many, take them over
    merged = found.groupBy("context").agg(F.aggregate(F.sort_array(F.collect_set(F.struct("start", "end"))), F.array().cast("array<struct<start: int, end: int>>"), _merge).alias("x"))
    return named.select("context", "doc_id", "at").join(merged, "context").select("doc_id", "at", F.inline("x")).select("doc_id", (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end"))


def _merge(done: Column, x: Column) -> Column:
    """Intervals merged so far and the next by its start."""
    last = F.try_element_at(done, F.lit(-1))
    longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
    return F.when(last["end"] >= x["start"], F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(x)))


def shared_intervals(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(doc_id, start, end): stretches of at least MIN_CHARS characters that another document holds too; they may overlap."""
    kind = docs.schema[doc_id].dataType.simpleString()
    corpus = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.col("doc_id").isNotNull() & (F.length("text") >= MIN_CHARS))
    marks = stored(corpus.mapInPandas(_anchors_of, f"h long, doc_id {kind}, at int"), "anchors", scratch)
    shared = marks.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo <> hi").select("h", (F.col("n") > group_limit).alias("big"))
    per_doc = marks.join(shared, "h").groupBy("doc_id").agg(F.collect_set(F.struct("h", "at", "big")).alias("marks"))
    sides = corpus.join(per_doc, "doc_id").select("doc_id", "text", "marks").mapInPandas(_sides_of, f"h long, big boolean, doc_id {kind}, at int, before string, after string")
    sides = stored(sides, "sides", scratch)
    large = sides.filter("big").drop("big")
    trees = sides.filter("not big").drop("big").repartition("h").sortWithinPartitions("h").mapInPandas(_repeats_of, f"doc_id {kind}, start int, end int")
    return trees.unionByName(_large_repeats(large, kind, group_limit, scratch)) if large.take(1) else trees


def shared_chars(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(doc_id, shared_chars): the characters of each document that lie in a shared stretch."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("reach"))

    def add(s, x):
        fresh = F.greatest(x["end"] - F.greatest(x["start"], s["reach"]), F.lit(0))
        return F.struct((s["n"] + fresh).cast("long").alias("n"), F.greatest(s["reach"], x["end"]).alias("reach"))

    with Scratch(docs.sparkSession) as scratch:
        found = shared_intervals(docs, scratch, doc_id, text, group_limit).groupBy("doc_id", "start").agg(F.max("end").alias("end"))
        return stored(_covered(found, zero, add, doc_id), "spans")


def _covered(found: DataFrame, zero, add, doc_id: str) -> DataFrame:
    return found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("x")).select(F.col("doc_id").alias(doc_id), F.aggregate("x", zero, add)["n"].alias("shared_chars"))
