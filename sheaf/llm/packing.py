"""Texts put into containers of a fixed number of tokens, by linear grouping.

1. Texts are cut into tokens of a public tokenizer; one longer than a container becomes
   full pieces and a rest, all others stay whole.
2. Large pieces, in descending order, are split into groups of equal cardinality and
   rounded up to their group's largest: few sizes are left. For these the configurations
   (how many pieces of each group fill a container) are optimised as a linear program by
   column generation; rounding down its solution and best-fit for the remainder give whole
   numbers of containers.
3. Actual pieces take the slots of their group by rank, so nothing exceeds a container.
4. Small pieces go best-fit, largest first, into what is really left over; the rest of
   them open containers of their own.

The driver sees histograms only: sizes (at most as many as tokens in a container) and room
left over (as many). Pieces get their places by rank arithmetic in joins; ranks within a
size are counted in hash buckets and added up, so a size that a third of all texts have is
no single task. Tables sent to executors have at most a row for each configuration and
group, or each step of the best-fit over histogram classes: their size follows the
container, not the corpus.

Defined results: null and empty texts need no room and are left out; repeated rows are
packed each; equal sizes are ordered by id and piece; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.runtime import Scratch, stored

CAPACITY = 2048
SMALL_PART = 8  # a piece of up to CAPACITY / SMALL_PART tokens is small
GROUPS = 32
RANK_BUCKETS = 64
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenisation pattern that belongs to the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@functools.cache
def encoder(path: str = TOKENIZER):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(docs: DataFrame, doc_id: str, text: str, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece, start, tokens): each text's pieces of at most capacity tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for pdf in batches:
            n = np.array([len(enc.encode_ordinary(t)) for t in pdf.text], dtype="int64")
            parts = -(-n // capacity)
            piece = np.concatenate([np.arange(p) for p in parts]) if len(parts) else np.zeros(0)
            start = piece * capacity
            whole = np.repeat(n, parts)
            yield pd.DataFrame({"doc_id": np.repeat(pdf.doc_id.to_numpy(), parts), "piece": piece.astype("int32"), "start": start.astype("int64"), "tokens": np.minimum(whole - start, capacity).astype("int32")})

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null").mapInPandas(run, f"doc_id {kind}, piece int, start long, tokens int")


def _knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        best[c] = best[c - 1]
        fits = np.flatnonzero(sizes <= c)
        v = best[c - sizes[fits]] + values[fits]
        k = int(v.argmax())
        if v[k] > best[c] + 1e-12:
            best[c], took[c] = v[k], fits[k]
    many = np.zeros(len(sizes), dtype=int)
    c = capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            many[took[c]] += 1
            c -= sizes[took[c]]
    return float(best[capacity]), many


def configurations(sizes: list[int], demand: list[int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(number of containers, pieces of each size in one): covers the demand exactly with few containers."""
    w, d = np.array(sizes), np.array(demand, dtype=float)
    k = len(w)
    if not k:
        return []
    basis = np.diag(capacity // w).astype(float)
    cost, still = np.inf, 0
    # a round may leave the cost as it is; when k rounds on end do, the basis goes round in a circle
    while still <= k:
        inverse = np.linalg.inv(basis)
        value, column = _knapsack(w, np.maximum(inverse.T @ np.ones(k), 0), capacity)
        if value <= 1 + 1e-7:
            break
        x, step = inverse @ d, inverse @ column
        still = still + 1 if x.sum() > cost - 1e-9 else 0
        cost = min(cost, float(x.sum()))
        ratio = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    x = np.floor(np.maximum(np.linalg.inv(basis) @ d, 0) + 1e-9).astype(int)
    out, left = [], np.array(demand, dtype=int)
    for count, column in zip(x, basis.T.astype(int), strict=True):
        # a column of the start may hold more than there is
        count = int(min([count, *(left[column > 0] // column[column > 0])]))
        if count > 0:
            out.append((count, column.tolist()))
            left -= count * column
    bins: list[tuple[int, np.ndarray]] = []
    for g in np.argsort(-w):
        for _ in range(left[g]):
            fit = [i for i, (room, _) in enumerate(bins) if room >= w[g]]
            i = min(fit, key=lambda j: bins[j][0], default=None)
            if i is None:
                bins.append((capacity, np.zeros(k, dtype=int)))
                i = len(bins) - 1
            bins[i][1][g] += 1
            bins[i] = (bins[i][0] - int(w[g]), bins[i][1])
    return out + [(1, b.tolist()) for _, b in bins]


def best_fit(room: dict[int, int], small: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Steps (size, slot from, slot to, room class, container rank from, pieces in each), and the number of new containers (class -1).

    room: containers by room left over; small: pieces by size. Largest pieces first, each
    into the least room that takes it; a container takes as many of the size as fit.
    """
    classes: dict[int, list[tuple[int, int, int]]] = {r: [(r, 0, n)] for r, n in room.items() if n and r > 0}
    steps, new = [], 0
    for s in sorted(small, reverse=True):
        slot, left = 0, small[s]
        for r in sorted(c for c in classes if c >= s):
            each = r // s
            segments, classes[r] = classes[r], []
            for own, lo, hi in segments:
                take = min(hi - lo, left // each)
                if take:
                    steps.append((s, slot, slot + take * each, own, lo, each))
                    slot, left = slot + take * each, left - take * each
                    classes.setdefault(r - s * each, []).append((own, lo, lo + take))
                if 0 < left < each and take < hi - lo:
                    steps.append((s, slot, slot + left, own, lo + take, left))
                    classes.setdefault(r - s * left, []).append((own, lo + take, lo + take + 1))
                    slot, left, take = slot + left, 0, take + 1
                if take < hi - lo:
                    classes[r].append((own, lo + take, hi))
            if not classes[r]:
                del classes[r]
            if not left:
                break
        each = capacity // s
        if full := left // each:
            steps.append((s, slot, slot + full * each, -1, new, each))
            classes.setdefault(capacity - s * each, []).append((-1, new, new + full))
            slot, left, new = slot + full * each, left - full * each, new + full
        if left:
            steps.append((s, slot, slot + left, -1, new, left))
            classes.setdefault(capacity - s * left, []).append((-1, new, new + 1))
            new += 1
    return steps, new


def ranked(df: DataFrame, key: str, by: Column, order: list[str], out: str, buckets: int = RANK_BUCKETS) -> DataFrame:
    """df with out, the rank 0, 1, ... within key; counted in hash buckets of by, so a frequent key is many tasks."""
    cut = df.withColumn("__b", F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int"))
    sums = cut.groupBy(key, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = sums.select(F.col(key).alias("__k"), F.col("__b").alias("__c"), (F.sum("__n").over(Window.partitionBy(key).orderBy("__b")) - F.col("__n")).alias("__off"))
    local = cut.withColumn("__r", F.row_number().over(Window.partitionBy(key, "__b").orderBy(*order)))
    return local.join(before, (F.col(key) == F.col("__k")) & (F.col("__b") == F.col("__c"))).withColumn(out, F.col("__off") + F.col("__r") - 1).drop("__b", "__k", "__c", "__off", "__r")


def _ranges(rows: list[tuple]) -> list[tuple]:
    """(key, [(from, base, each, ...)]) of ranges (key, from, to, base, each, ...) that lie end to end, in order."""
    by: dict[int, list[tuple]] = {}
    for key, lo, _, *rest in sorted(rows, key=lambda x: x[:2]):
        by.setdefault(int(key), []).append((int(lo), *map(int, rest)))
    return list(by.items())


def _range_of(ranges: str, at: str) -> Column:
    """The range that holds a rank: the last that begins at or before it."""
    return F.element_at(F.filter(ranges, lambda r: r["lo"] <= F.col(at)), -1)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, groups: int = GROUPS, small_part: int = SMALL_PART) -> DataFrame:
    """(doc_id, piece, start, tokens, container_id): where each piece of each text goes."""
    with Scratch(docs.sparkSession) as scratch:
        return stored(_packed(docs, doc_id, text, capacity, tokenizer, groups, small_part, scratch), "packed").withColumnRenamed("doc_id", doc_id)


def _packed(docs: DataFrame, doc_id: str, text: str, capacity: int, tokenizer: str, groups: int, small_part: int, scratch: Scratch) -> DataFrame:
    spark = docs.sparkSession
    cut = stored(pieces(docs, doc_id, text, capacity, tokenizer), "pieces", scratch)
    counts = {r[0]: r[1] for r in cut.groupBy("tokens").count().collect()}  # at most capacity rows
    limit = capacity // small_part
    large = sorted((s for s in counts if s > limit), reverse=True)
    n_large = sum(counts[s] for s in large)
    k = max(1, min(groups, n_large // 8))
    # bounds[g] is the rank at which group g begins, each group is rounded up to its first piece
    bounds = sorted({round(i * n_large / k) for i in range(k + 1)}) if n_large else [0]
    first_rank = dict(zip(large, np.concatenate([[0], np.cumsum([counts[s] for s in large])[:-1]]).astype(int), strict=True)) if large else {}
    size_at = lambda rank: next(s for s in reversed(large) if first_rank[s] <= rank)
    configs = configurations([size_at(b) for b in bounds[:-1]], [b - a for a, b in zip(bounds, bounds[1:], strict=False)], capacity)
    slots, base, filled = [], 0, [0] * (len(bounds) - 1)
    for count, column in configs:
        for g, each in enumerate(column):
            if each:
                slots.append((bounds[g] + filled[g], bounds[g] + filled[g] + count * each, base, each, g))
                filled[g] += count * each
        base += count
    table = lambda rows, schema: F.broadcast(spark.createDataFrame(rows, schema))
    of_size = ranked(cut, "tokens", F.struct("doc_id", "piece"), ["doc_id", "piece"], "rank")
    offsets = table([(s, int(first_rank[s])) for s in large], "tokens int, off long")
    edges = F.array(*[F.lit(b).cast("long") for b in bounds])
    group = F.size(F.filter(edges, lambda b: b <= F.col("at"))) - 1
    at_slot = table(_ranges([(x[-1], *x[:-1]) for x in slots]), "g int, ranges array<struct<lo: long, base: long, each: long>>")
    placed = (
        of_size.join(offsets, "tokens").withColumn("at", F.col("off") + F.col("rank")).withColumn("g", group)
        .join(at_slot, "g").withColumn("r", _range_of("ranges", "at"))
        .select("doc_id", "piece", "start", "tokens", (F.col("r.base") + F.floor((F.col("at") - F.col("r.lo")) / F.col("r.each"))).cast("long").alias("container_id"))
    )
    placed = stored(placed, "placed", scratch)
    room = placed.groupBy("container_id").agg((F.lit(capacity) - F.sum("tokens")).cast("int").alias("room"))
    rooms = {r[0]: r[1] for r in room.groupBy("room").count().collect()}  # at most capacity rows
    steps, _ = best_fit(rooms, {s: n for s, n in counts.items() if s <= limit}, capacity)
    at_step = table(_ranges([(s, lo, hi, first, each, own) for s, lo, hi, own, first, each in steps]), "tokens int, ranges array<struct<lo: long, base: long, each: long, room: long>>")
    going = (
        of_size.filter(F.col("tokens") <= limit).join(at_step, "tokens").withColumn("r", _range_of("ranges", "rank"))
        .select("doc_id", "piece", "start", "tokens", F.col("r.room").cast("int").alias("room"), (F.col("r.base") + F.floor((F.col("rank") - F.col("r.lo")) / F.col("r.each"))).cast("long").alias("nth"))
    )
    homes = ranked(room, "room", F.col("container_id"), ["container_id"], "nth").select("room", "nth", "container_id")
    into = going.filter("room >= 0").join(homes, ["room", "nth"]).select("doc_id", "piece", "start", "tokens", "container_id")
    own = going.filter("room < 0").select("doc_id", "piece", "start", "tokens", (F.col("nth") + base).alias("container_id"))
    return placed.unionByName(into).unionByName(own)
