"""New batches against all history: same ids and titles at most EDITS word edits away.

Titles are sequences of words. The index cuts each title of L words into EDITS + 1 segments
at fixed places and stores them by length, segment number and content; of two titles within
EDITS edits at least one segment of the one stands in the other, shifted by no more than
the edits before and after it allow. A batch's own segments are appended to the index, then
its titles probe only those few substrings; what meets is tested by its word signature and
verified by a bounded edit distance. Equal titles are one class, of which only the first and
last date of each span and batch are kept, which decides the date test exactly: copies are
never paired.

The index is four tables in one folder, which any session can open: segments, titles, dates
and ids, bucketed by the column they are met by and partitioned by the period of their dates
and by the load that brought them. A load reads only the periods within reach of its own
dates, and shuffles only its own rows: the work for a batch follows the batch and the
history of its periods, not the history. (Ids have no date: their two narrow columns are
read whole.) A load counts once the manifest names it; what a failed one has left is
deleted by the next. A load may hold several batches, as a row matches earlier batches only.

A segment that more than HOT titles share isn't joined: under it, its titles are indexed
again by segments of the words on its two sides, and so on until the keys are selective or
at most EDITS words are left on either side of a pair, when all of the group are within
EDITS edits and are treated as one class. So no group is paired within itself, and no pair
is lost.

Defined results: null titles match nothing by title, titles without words do as empty
sequences; a null id matches nothing, nor does one without letters and digits; null dates
or batches match nothing; rows of the same batch don't match each other; repeated rows
follow the same rules; whole titles are used at any length.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.ledger import letters_and_digits, loads
from sheaf.runtime import DAY_US, BucketTable, Scratch, exists, fresh_path, get_text, put_text, remove, stored

EDITS = 2
DAYS = 10
HOT = 1000
PERIODS = 3  # an index period is as many spans of DAYS days
MOST_PRUNED = 2000  # with more periods than that in a load, the index is read whole
_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_text(title: Column) -> Column:
    """The words of a title in lower case, one space between."""
    return F.trim(F.lower(F.regexp_replace(title, "[^\\p{L}\\p{N}]+", " ")))


def within(a: list[str], b: list[str], edits: int = EDITS) -> bool:
    """Whether a becomes b by at most so many words inserted, deleted or replaced."""
    if abs(len(a) - len(b)) > edits:
        return False
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < len(a) - lo and hi < len(b) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if max(len(a), len(b)) <= edits:
        return True
    if not edits or min(len(a), len(b)) == 0:
        return False
    return within(a[1:], b[1:], edits - 1) or within(a[1:], b, edits - 1) or within(a, b[1:], edits - 1)


def segments(length: int) -> list[tuple[int, int]]:
    """(start, end) of the fixed segments of a title of so many words; single words where there are few."""
    k = min(EDITS + 1, length)
    cuts = [i * length // k for i in range(k + 1)] if k else []
    return list(zip(cuts, cuts[1:], strict=False))


def substrings(length: int, indexed: int) -> list[tuple[int, int, int]]:
    """(segment, start, end) of the substrings of a title that may equal a segment of an indexed one."""
    out, delta, segs = [], length - indexed, segments(indexed)
    for i, (s, e) in enumerate(segs):
        if len(segs) <= EDITS:
            lo, hi = 0, length - 1  # fewer segments than edits: any place
        else:
            lo, hi = max(s - i, s + delta - (EDITS - i)), min(s + i, s + delta + (EDITS - i))
        out += [(i, p, p + e - s) for p in range(max(lo, 0), min(hi, length - (e - s)) + 1)]
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def _word_hash(word: str, seen: dict[str, int]) -> int:
    import xxhash

    h = seen.get(word)
    if h is None:
        h = seen[word] = xxhash.xxh64_intdigest(word)
    return h


def _level0(indexing: bool, shorter: list[int]):
    """Rows (key, tk, sig, place) of index entries, or of probes for indexed lengths shorter by so many words; a place is an indexed length, a segment's number and a start."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        for pdf in batches:
            if len(seen) > 1_000_000:
                seen.clear()
            lists = [t.split() for t in pdf.words]
            length = np.array([len(x) for x in lists], dtype=int)
            out = []
            for n in map(int, np.unique(length)):
                at = np.flatnonzero(length == n)
                h = np.array([[_word_hash(w, seen) for w in lists[i]] for i in at], dtype=np.uint64).reshape(len(at), n)
                with np.errstate(over="ignore"):
                    # prefix sums of a polynomial with an odd base, divided by the power of the start: equal runs are equal anywhere
                    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]), dtype=np.uint64)
                    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(int(_BASE), -1, 2**64)))]), dtype=np.uint64)
                    sums = np.concatenate([np.zeros((len(at), 1), dtype=np.uint64), np.cumsum(h * up[:n], axis=1, dtype=np.uint64)], axis=1)
                    group = pdf.g.to_numpy()[at].astype(np.int64).astype(np.uint64)
                    wanted = [(n, i, s, e) for i, (s, e) in enumerate(segments(n))] if indexing else [(n - d, i, s, e) for d in shorter if n - d > 0 for i, s, e in substrings(n, n - d)]
                    for of, i, s, e in wanted:
                        slot = np.uint64(of * 8 + (i if of > EDITS else 7))
                        key = _mix(_mix((sums[:, e] - sums[:, s]) * down[s] + slot * np.uint64(0x632BE59BD9B4E019)) + group)
                        out.append(pd.DataFrame({"key": key.astype(np.int64), "tk": pdf.tk.to_numpy()[at], "sig": pdf.sig.to_numpy()[at], "place": np.int64(of << 36 | i << 32 | s), "g": group.astype(np.int32)}))
            if out:
                yield pd.concat(out, ignore_index=True)

    return run


_LEVEL0 = "key long, tk long, sig long, place long, g int"


def chunks(n_index: int, n_own: int, used: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(from, to, own from, own to) of what lies between used segments (start, end, own start)."""
    out, a, b = [], 0, 0
    for s, e, p in [*sorted(used), (n_index, n_index, n_own)]:
        out.append((a, s, b, p))
        a, b = e, p + e - s
    return out


def below(n_index: int, n_own: int, used: list[tuple[int, int, int]]) -> list[tuple[int, int, int, list[int]]]:
    """(number, start, end, own starts) of up to EDITS + 1 disjoint segments of the indexed title outside the used ones, and where a title may hold them."""
    parts = chunks(n_index, n_own, used)
    words = [i for a, b, _, _ in parts for i in range(a, b)]
    out = []
    for j, (x, y) in enumerate(segments(len(words))):
        run = words[x:y]
        # the longest run of it that lies in one chunk
        cuts = [0, *[k for k in range(1, len(run)) if run[k] != run[k - 1] + 1], len(run)]
        lo, hi = max(zip(cuts, cuts[1:], strict=False), key=lambda c: c[1] - c[0])
        s, e = run[lo], run[hi - 1] + 1
        a, b, oa, ob = next(c for c in parts if c[0] <= s and e <= c[1])
        if len(words) > EDITS:
            starts = [p for p in range(max(oa, s - a + oa - EDITS), min(ob - (e - s), s - a + oa + EDITS) + 1)]
        else:
            starts = list(range(oa, ob - (e - s) + 1))
        out.append((j, s, e, starts))
    return out


def _deeper(indexing: bool):
    """Entries (g, tk, sig, words, of, used) indexed or probed again by the words outside the used segments."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            rows = []
            for g, tk, sig, t, of, path in zip(pdf.g, pdf.tk, pdf.sig, pdf.words, pdf.of, pdf.used, strict=True):
                w = t.split()
                used = [tuple(map(int, x.split(","))) for x in path.split(";")]
                for j, s, e, starts in below(of, len(w), used):
                    for p in [s] if indexing else starts:
                        key = xxhash.xxh64_intdigest(f"{g} {j} {' '.join(w[p : p + e - s])}")
                        rows.append((key - (1 << 64) if key >> 63 else key, tk, sig, t, of, f"{path};{s},{e},{p}"))
            yield pd.DataFrame(rows, columns=["key", "tk", "sig", "words", "of", "used"])

    return run


_DEEPER = "key long, tk long, sig long, words string, of int, used string"


def _paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        of, used = pdf.place.to_numpy() >> 36, []
        for n, x in zip(of, pdf.place, strict=True):
            s, e = segments(int(n))[x >> 32 & 15]
            used.append(f"{s},{e},{x & 0xFFFFFFFF}")
        yield pd.DataFrame({"g": pdf.key, "tk": pdf.tk, "sig": pdf.sig, "words": pdf.words, "of": of, "used": used})


def covers(lengths: list[int]) -> list[tuple[int, ...]]:
    """All ways to raise the lengths to a total of EDITS: two titles under a common one are within EDITS edits."""
    out = {tuple(lengths)}
    for _ in range(EDITS - sum(lengths)):
        out = {(*x[:k], x[k] + 1, *x[k + 1 :]) for x in out for k in range(len(x))}
    return sorted(out)


def _tiny(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Groups of entries of one key that have so few words between what all share that any two are within EDITS edits."""
    import xxhash

    for pdf in batches:
        rows = []
        for g, tk, t, of, path in zip(pdf.g, pdf.tk, pdf.words, pdf.of, pdf.used, strict=True):
            used = [tuple(map(int, x.split(","))) for x in path.split(";")]
            between = [ob - oa for _, _, oa, ob in chunks(of, len(t.split()), used)]
            if sum(between) <= EDITS:
                for c in covers(between):
                    key = xxhash.xxh64_intdigest(f"{g} {c}")
                    rows.append((key - (1 << 64) if key >> 63 else key, tk))
        yield pd.DataFrame(rows, columns=["g", "tk"])


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import xxhash

    bit: dict[str, int] = {}
    for pdf in batches:
        if len(bit) > 1_000_000:
            bit.clear()
        sig = np.zeros(len(pdf), dtype=np.uint64)
        for k, t in enumerate(pdf.words):
            x = 0
            for w in t.split():
                b = bit.get(w)
                if b is None:
                    b = bit[w] = 1 << (xxhash.xxh64_intdigest(w, 7) & 63)
                x |= b
            sig[k] = x
        yield pdf.assign(sig=sig.view(np.int64))


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ok = np.array([within(a.split(), b.split()) for a, b in zip(pdf.wa, pdf.wb, strict=True)], dtype=bool)
        yield pdf.loc[ok, ["a", "b"]]


def probe_entries(titles: DataFrame, shorter: list[int]) -> DataFrame:
    """Substrings of titles (g, tk, sig, words) to be met with an index."""
    return titles.select("g", "tk", "sig", "words").mapInPandas(_level0(False, shorter), _LEVEL0).drop("g")


def candidates(segs: DataFrame, known: DataFrame, probing: DataFrame, scratch: Scratch, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """((a, b) titles that share a segment and may be within EDITS edits, (g, tk) groups all of whose titles are).

    segs: index entries, bucketed by key. known: the (g, tk, words) of their titles. probing:
    (g, tk, sig, words), which segs and known hold too. a probes, b is in the index.
    """
    short = F.size(F.filter(F.split("words", " "), lambda w: w != "")) <= EDITS
    cliques = [known.filter(short).select("g", "tk")]
    sides, pairs, depth = [segs, probe_entries(probing, list(range(-EDITS, EDITS + 1)))], None, 0
    while True:
        crowded = stored(sides[0].groupBy("key").count().filter(F.col("count") > hot).select("key"), "crowded", scratch)
        some = bool(crowded.take(1))
        left, right = (x.join(crowded, "key", "left_anti") if some else x for x in sides)
        met = left.select("key", F.col("tk").alias("b"), F.col("sig").alias("sb")).join(right.select("key", F.col("tk").alias("a"), F.col("sig").alias("sa")), "key")
        met = met.filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= 2 * EDITS)).select("a", "b")
        pairs = met if pairs is None else pairs.unionByName(met)
        if not some:
            break
        groups = []
        for x, titles in zip(sides, (known, probing), strict=True):
            again = x.join(crowded, "key", "left_semi")
            if depth == 0:
                again = again.join(titles.select("tk", "words").dropDuplicates(["tk"]), "tk").select("key", "tk", "sig", "words", "place").mapInPandas(_paths, "g long, tk long, sig long, words string, of int, used string")
            else:
                again = again.withColumnRenamed("key", "g")
            groups.append(stored(again, "groups", scratch))
        cliques += [x.mapInPandas(_tiny, "g long, tk long") for x in groups]
        sides = [x.mapInPandas(_deeper(k == 0), _DEEPER) for k, x in enumerate(groups)]
        depth += 1
    flat = cliques[0]
    for c in cliques[1:]:
        flat = flat.unionByName(c)
    return pairs, flat.distinct()


def _periods(low: Column, high: Column) -> Column:
    return F.sequence(F.floor(low / PERIODS).cast("long"), F.floor(high / PERIODS).cast("long"))


def titles_of(rows: DataFrame) -> DataFrame:
    """(tk, words, sig, spans): each title once, with the spans its dates lie in."""
    per = rows.groupBy("tk").agg(F.first("words").alias("words"), F.collect_set("span").alias("spans"))
    return per.mapInPandas(_signatures, "tk long, words string, spans array<int>, sig long")


def entries(titles: DataFrame, reach: int) -> DataFrame:
    """(g, tk, sig, words): each title for each period that its dates, and those up to `reach` spans off, touch."""
    periods = F.array_distinct(F.flatten(F.transform("spans", lambda x: _periods(x - reach, x + reach))))
    return titles.select(F.explode(periods).alias("g"), "tk", "sig", "words")


def linked(known: DataFrame, titles: DataFrame, found: DataFrame, buckets: int) -> DataFrame:
    """The pairs (a, b) of found that are within EDITS edits; known (bucketed by tk) has the words of b, titles those of a."""
    once = found.repartition(buckets, "b").distinct()  # found in several places; the distinct needs no shuffle of its own
    words = lambda x, tk, w: x.select(F.col("tk").alias(tk), F.col("words").alias(w))
    both = once.join(words(known.groupBy("tk").agg(F.first("words").alias("words")), "b", "wb"), "b").join(words(titles, "a", "wa"), "a")
    return both.select("a", "b", "wa", "wb").mapInPandas(_verified, "a long, b long")


def matched_by_title(rows: DataFrame, dates: DataFrame, links: DataFrame, cliques: DataFrame) -> DataFrame:
    """row_ids of rows for which dates has an earlier batch of an equal or linked title within DAYS days.

    dates: (tk, span, batch, lo, hi). links: (tk of rows, tk of dates). A group of cliques stands for one title.
    """
    groups = cliques.select("tk", F.xxhash64(F.lit("group"), "g").alias("c")).distinct()
    # a group's dates are gathered before its members meet them
    of_groups = dates.join(groups, "tk").groupBy(F.col("c").alias("tk"), "span", "batch").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # what a title meets: itself, the titles linked to it, its groups
    tk = rows.select("tk").distinct()
    meets = tk.select(F.col("tk").alias("own"), "tk").unionByName(links.select(F.col("a").alias("own"), F.col("b").alias("tk"))).unionByName(groups.join(tk, "tk", "left_semi").select(F.col("tk").alias("own"), F.col("c").alias("tk")))
    seen = dates.unionByName(of_groups).join(meets, "tk").groupBy("own", "span", "batch").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    near = seen.select("own", F.explode(F.array(*[F.struct((F.col("span") - d).alias("span"), F.lit(d).alias("rel")) for d in (-1, 0, 1)])).alias("x"), "batch", "lo", "hi").select("own", "x.*", "batch", "lo", "hi")
    seen = near.groupBy("own", "span").agg(F.collect_list(F.struct("rel", "batch", "lo", "hi")).alias("seen"))
    reach = F.lit(DAYS * DAY_US)
    hit = F.exists("seen", lambda s: (s["batch"] < F.col("batch")) & ((s["rel"] == 0) | ((s["rel"] == -1) & (s["hi"] >= F.col("us") - reach)) | ((s["rel"] == 1) & (s["lo"] <= F.col("us") + reach))))
    return rows.join(seen.withColumnRenamed("own", "tk"), ["tk", "span"]).filter(hit).select("row_id")


class BatchIndex:
    """Accepted history as segments, titles, dates and ids, in a folder that any session can open."""

    def __init__(self, spark: SparkSession, path: str | None = None, row_id: str = "row_id", batch: str = "batch_id", own_id: str = "article_id", title: str = "title", at: str = "gkg_date", buckets: int | None = None) -> None:
        self.spark, self.path = spark, path or fresh_path(spark, "index")
        self.about = {"names": [row_id, batch, own_id, title, at], "buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "loads": 0, "kind": None}
        self._attach()

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> BatchIndex:
        """The index that an earlier session left in a folder."""
        own = cls.__new__(cls)
        own.spark, own.path, own.about = spark, path, json.loads(get_text(spark, f"{path}/_manifest.json"))
        own._attach()
        return own

    def _attach(self) -> None:
        for x in ("segments", "titles", "dates", "ids"):  # what a failed load may have left
            base = f"{self.path}/{x}/load={self.about['loads'] + 1}"
            if exists(self.spark, base):
                remove(self.spark, base)
        table = lambda name, schema, parts, key: BucketTable(self.spark, f"{self.path}/{name}", f"{schema}, {', '.join(f'{p} int' for p in parts)}", parts, key, self.about["buckets"])
        self.segments = table("segments", "key long, tk long, sig long, place long", ["load", "g"], "key")
        self.titles = table("titles", "tk long, words string", ["load", "g"], "tk")
        self.dates = table("dates", "tk long, span int, batch int, lo long, hi long", ["load", "g"], "tk")
        self.ids = table("ids", "key long, first int", ["load"], "key")

    def load(self, new: DataFrame, hot: int = HOT) -> DataFrame:
        """Takes rows of one or more batches into the index; (row_id): those that repeat or nearly repeat a row of an earlier batch."""
        row_id, batch, own_id, title, at = self.about["names"]
        buckets, number = self.about["buckets"], self.about["loads"] + 1
        with Scratch(self.spark) as scratch:
            wide = new.select(F.col(row_id).alias("row_id"), F.col(batch).alias("batch"), F.unix_micros(F.col(at)).alias("us"), word_text(F.col(title)).alias("words"), F.xxhash64(letters_and_digits(F.col(own_id))).alias("idk"), (letters_and_digits(F.col(own_id)) != "").alias("has_id")).filter("batch is not null")
            wide = stored(wide.withColumns({"tk": F.xxhash64("words"), "span": F.floor(F.col("us") / (DAYS * DAY_US)).cast("int")}), "rows", scratch)
            own = wide.filter("us is not null and words is not null").select("row_id", "batch", "us", "span", "tk", "words")
            keyed = wide.filter("has_id").select("row_id", "batch", F.col("idk").alias("key"))
            self._append(own, keyed, number, scratch)
            result = stored(self._matches(own, keyed, number, hot, scratch), "repeats")
        self.about["loads"] = number
        put_text(self.spark, f"{self.path}/_manifest.json", json.dumps(self.about))
        return result.withColumnRenamed("row_id", row_id)

    def _append(self, own: DataFrame, keyed: DataFrame, number: int, scratch: Scratch) -> None:
        buckets, load = self.about["buckets"], F.lit(number)
        self.new = stored(titles_of(own), "titles", scratch)
        period = F.floor(F.col("span") / PERIODS).cast("int")
        # the index side reaches one span to each side, so that a probe needs its own span only
        reach = entries(self.new, 1)
        segs = reach.select("g", "tk", "sig", "words").mapInPandas(_level0(True, []), _LEVEL0)
        dates = own.groupBy("tk", "span", "batch").agg(F.min("us").alias("lo"), F.max("us").alias("hi")).withColumns({"batch": F.col("batch").cast("int"), "g": period})
        ids = keyed.groupBy("key").agg(F.min("batch").cast("int").alias("first"))
        words = reach.select("tk", "words", F.col("g").cast("int").alias("g"))
        # one after the other: at the same time they took half as much memory again
        for t, df in ((self.segments, segs), (self.titles, words), (self.dates, dates), (self.ids, ids)):
            t.append(df.repartition(buckets, t.key).withColumn("load", load))

    def _matches(self, own: DataFrame, keyed: DataFrame, number: int, hot: int, scratch: Scratch) -> DataFrame:
        titles, buckets = self.new, self.about["buckets"]
        probing = entries(titles, 0)
        periods = [r.g for r in own.select(F.floor(F.col("span") / PERIODS).cast("int").alias("g")).distinct().limit(MOST_PRUNED + 1).collect()]

        def held(table: BucketTable, reach: int) -> DataFrame:
            df = table.read().filter(F.col("load") <= number)
            wanted = sorted({p + d for p in periods for d in range(-reach, reach + 1)})
            return df.filter(F.col("g").isin(wanted)) if len(periods) <= MOST_PRUNED else df

        known = held(self.titles, 0).select("g", "tk", "words")
        found, cliques = candidates(held(self.segments, 0).select("key", "tk", "sig", "place"), known, probing, scratch, hot)
        links = linked(known, titles, found, buckets)
        by_title = matched_by_title(own, held(self.dates, 1).select("tk", "span", "batch", "lo", "hi"), links, cliques)
        first = self.ids.read().filter(F.col("load") <= number).groupBy("key").agg(F.min("first").alias("first"))
        by_id = keyed.join(first, "key").filter("first < batch").select("row_id")
        return by_title.unionByName(by_id).distinct()

    def drop(self) -> None:
        for t in (self.segments, self.titles, self.dates, self.ids):
            t.close()
        remove(self.spark, self.path)


def repeats(rows: DataFrame, row_id: str = "row_id", batch: str = "batch_id", own_id: str = "article_id", title: str = "title", at: str = "gkg_date", hot: int = HOT, per_load: int = 1) -> DataFrame:
    """(row_id): rows that repeat or nearly repeat a row of an earlier batch; the batches go into an index in order, per_load of them at a time."""
    index, out = BatchIndex(rows.sparkSession, None, row_id, batch, own_id, title, at), None
    try:
        for part in loads(rows, batch, per_load):
            got = index.load(rows.filter(part), hot)
            out = got if out is None else out.unionByName(got)
    finally:
        index.drop()
    return out.distinct()
