"""Text read with the wrong character encoding, found and restored by expectation-maximisation.

Each record has a latent chain: none, or one of the misreadings in CHAINS. What a chain
would have made of clean text is undone character by character; where that isn't possible
the chain can't have produced the record. The evidence is small and local: an atom is a run
of non-ASCII characters (or a lone question mark) with the ASCII character before and after
it. A chain's likelihood of an atom is that of the undone atom under a bigram model of
clean text. The model of clean text and the share of each chain within each source and
field aren't known; they are estimated together, all records pooled:

  E: posterior of each chain for each distinct (source and field, atom),
  M: chain shares of each source and field (drawn towards the shares of all), and the
     bigrams of clean text, both from counts weighted by the posteriors,

until the share of clean text stands still to STILL (or ROUNDS have passed): shares that go
on moving after that move between chains that read the same atoms alike. It starts from the atoms that only clean text explains. A record's posterior multiplies its
atoms' likelihoods with its source's shares; where a misreading is likelier than none the
record is found, and undone by its likeliest chain. Characters that were lost (replacement
characters, or question marks in the place of letters) are found but can't be restored.

Only counts of distinct atoms and bigrams take part in the iterations, pre-aggregated in the
scan, so a source with a third of all rows is a few more counts. All of them are tables that
are joined, none is collected. Defined results: null texts aren't found; a null source is a
source of its own; repeated rows count as often as they stand; long texts are read whole.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.runtime import Scratch, stored

ROUNDS = 8  # at most
STILL = 1e-4
POOL = 50.0  # weight, in records, of the shares of all sources in those of one
BACK = 2.0  # weight, in characters, of the single-character model in that of pairs
RARE = 1e-3
LOST = "�"
WILD = ""  # any non-ASCII letter, in the place of a lost one
_ATOM = re.compile(r"(?:[^\x00-\x7f]|ï¿½)+|\?+")
# UTF-8 read as one of these; the last field is how often.
_UTF8_AS = {"utf8_as_cp1252": ("cp1252", 1), "utf8_as_latin1": ("latin-1", 1), "utf8_as_mac": ("mac-roman", 1), "utf8_as_cp437": ("cp437", 1), "utf8_as_cp850": ("cp850", 1), "utf8_as_cp1251": ("cp1251", 1), "utf8_as_cp1252_twice": ("cp1252", 2), "utf8_as_latin1_twice": ("latin-1", 2)}
CHAINS = ["clean", *_UTF8_AS, "cp1252_as_cp1251", "lost"]


@functools.cache
def _bytes_of(codec: str) -> dict[str, int]:
    """Characters of a one-byte encoding; bytes without a character stand for themselves."""
    table = {}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            pass
    for b in range(128, 160):
        if codec == "latin-1" or b not in table.values():
            table.setdefault(chr(b), b)
    return table


def _utf8_misread(text: str, codec: str) -> str | None:
    """text with every run of characters that are the bytes of a UTF-8 character replaced by it; None if there is none."""
    table, out, i, changed = _bytes_of(codec), [], 0, False
    while i < len(text):
        lead = table.get(text[i], 0)
        n = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
        raw = [table.get(c, 0) for c in text[i : i + n]]
        try:
            if not n or len(raw) < n:
                raise ValueError
            out.append(bytes(raw).decode("utf-8"))
            i, changed = i + n, True
        except ValueError:
            out.append(text[i])
            i += 1
    return "".join(out) if changed else None


def undo(chain: str, text: str) -> str | None:
    """text as it was before the chain; None if the chain can't have produced it."""
    if chain in _UTF8_AS:
        codec, times = _UTF8_AS[chain]
        for _ in range(times):
            text = _utf8_misread(text, codec)
            if text is None:
                return None
        return text
    if chain == "cp1252_as_cp1251":
        table = _bytes_of("cp1251")
        new = "".join(bytes([table[c]]).decode("cp1252", "ignore") or c if c in table and "Ѐ" <= c <= "ӿ" else c for c in text)
        return new if new != text else None
    return None


def atoms(text: str) -> list[tuple[str, str, str]]:
    """(character before, run, character after); a space stands for the ends and for what isn't printable."""
    pad = f" {text} "
    return [(pad[m.start()], m.group(), pad[m.end() + 1]) for m in _ATOM.finditer(text)]


@functools.lru_cache(maxsize=200_000)
def readings(before: str, run: str, after: str) -> tuple[tuple[int, str], ...]:
    """(number of the chain, undone run) that may explain an atom; clean first."""
    out = [(0, run)]
    if run.strip("?") == "":
        return (*out, (len(CHAINS) - 1, WILD * len(run)))
    lost = run.replace("ï¿½", LOST)
    if LOST in lost:
        return ((len(CHAINS) - 1, lost.replace(LOST, WILD)),)  # nobody writes a replacement character
    for k, chain in enumerate(CHAINS[1:-1], 1):
        new = undo(chain, run)
        if new is not None:
            out.append((k, new))
    return tuple(out)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        count = Counter((s, *a) for s, t in zip(pdf.source, pdf.text, strict=True) for a in atoms(t))
        yield pd.DataFrame([(*k, n) for k, n in count.items()], columns=["source", "before", "run", "after", "n"])


def _bigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for b, r, a in zip(pdf.before, pdf.run, pdf.after, strict=True):
            for chain, new in readings(b, r, a):
                whole = b + new + a
                rows += [(b, r, a, chain, x, y) for x, y in zip(whole, whole[1:], strict=False)]
        yield pd.DataFrame(rows, columns=["before", "run", "after", "chain", "x", "y"])


def _doubtful(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(i, s, *a) for i, s, t in zip(pdf.id, pdf.source, pdf.text, strict=True) for a in atoms(t) if readings(*a)[-1][0]]
        yield pd.DataFrame(rows, columns=["id", "source", "before", "run", "after"])


_KEY = ["before", "run", "after"]


_ALL = range(len(CHAINS))


def _likelihood(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """(atom, l0, l1, ...): log-likelihood of each chain's reading under bigram counts (x, y, n), backed off to single characters; null without a reading."""
    wild = lambda c: F.when((F.col(c) > "\u007f") & ~F.col(c).rlike("^[\\p{Z}\\p{C}]$"), F.lit(WILD))
    wide = counts.unionByName(counts.select("x", wild("y").alias("y"), "n").filter("y is not null")).unionByName(counts.select(wild("x").alias("x"), "y", "n").filter("x is not null"))
    wide = wide.groupBy("x", "y").agg(F.sum("n").alias("n"))
    after = wide.filter(F.col("y") != WILD).groupBy("x").agg(F.sum("n").alias("nx"))
    alone = wide.filter(F.col("x") != WILD).groupBy("y").agg(F.sum("n").alias("ny"))
    total = counts.agg(F.sum("n")).first()[0] or 0.0
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    p = (zero("n") + BACK * (zero("ny") + RARE) / (total + 1)) / (zero("nx") + BACK)
    met = grams.join(wide, ["x", "y"], "left").join(after, "x", "left").join(alone, "y", "left")
    return met.groupBy(*_KEY).agg(*[F.sum(F.when(F.col("chain") == k, F.ln(p))).alias(f"l{k}") for k in _ALL])


def _mass(logs: list[Column]) -> tuple[list[Column], Column]:
    """exp of logs against the greatest (0 for null), and their sum."""
    top = F.greatest(*logs)
    mass = [F.coalesce(F.exp(F.greatest(x - top, F.lit(-700.0))), F.lit(0.0)) for x in logs]
    return mass, functools.reduce(lambda a, b: a + b, mass)


def fit(texts: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """((atom, l0, ...), (source, p0, ...)) from texts (source, text): likelihoods and chain shares.

    A round joins the bigrams with the readings of the distinct atoms, and the likelihoods and
    shares with the atoms of each source: one row an atom and source, whatever the number of chains.
    """
    counted = stored(texts.select("source", "text").mapInPandas(_counted, "source string, before string, run string, after string, n long").groupBy("source", *_KEY).agg(F.sum("n").cast("double").alias("n")), "atoms", scratch)
    grams = stored(counted.select(*_KEY).distinct().mapInPandas(_bigrams, "before string, run string, after string, chain int, x string, y string"), "bigrams", scratch)
    sure = grams.groupBy(*_KEY).agg(F.max("chain").alias("top")).filter("top = 0").select(*_KEY)
    totals = counted.groupBy(*_KEY).agg(F.sum("n").alias("n"))
    counts = stored(grams.join(sure, _KEY).join(totals, _KEY).groupBy("x", "y").agg(F.sum("n").alias("n")), "counts", scratch)
    pooled = [0.95, *[0.05 / (len(CHAINS) - 1)] * (len(CHAINS) - 1)]
    share = None
    for k in range(rounds):
        ll = _likelihood(grams, counts)
        if share is None:
            share = counted.select("source").distinct().select("source", *[F.lit(x).alias(f"p{j}") for j, x in enumerate(pooled)])
        mass, whole = _mass([F.col(f"l{j}") + F.ln(f"p{j}") for j in _ALL])
        scored = stored(counted.join(ll, _KEY).join(share, "source").select("source", *_KEY, "n", *[(F.col("n") * m / whole).alias(f"m{j}") for j, m in enumerate(mass)]), "scored", scratch)
        seen = [x or 0.0 for x in scored.agg(*[F.sum(f"m{j}") for j in _ALL]).first()]
        before, pooled = pooled[0], [(x + 1.0) / (sum(seen) + len(CHAINS)) for x in seen]
        share = scored.groupBy("source").agg(*[((F.sum(f"m{j}") + POOL * pooled[j]) / (F.sum("n") + POOL)).alias(f"p{j}") for j in _ALL])
        if k == rounds - 1 or abs(pooled[0] - before) < STILL:
            return stored(ll, "likelihoods", scratch), stored(share, "shares", scratch)
        by_chain = scored.groupBy(*_KEY).agg(*[F.sum(f"m{j}").alias(f"m{j}") for j in _ALL])
        weights = by_chain.select(*_KEY, F.explode(F.array(*[F.struct(F.lit(j).alias("chain"), F.col(f"m{j}").alias("m")) for j in _ALL])).alias("x")).select(*_KEY, "x.*").filter("m > 0")
        counts = stored(grams.join(weights, [*_KEY, "chain"]).groupBy("x", "y").agg(F.sum("m").alias("n")), "counts", scratch)
    raise ValueError("at least one round")


def garbled(records: DataFrame, record_id: str, fields: list[str], source: str, rounds: int = ROUNDS) -> DataFrame:
    """(record_id, field, chain, posterior): the records' fields that a misreading explains better than clean text, with the likeliest one."""
    texts = records.select(
        F.col(record_id).alias("rid"), F.coalesce(F.col(source).cast("string"), F.lit("\u0000")).alias("src"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("x"),
    ).select("rid", F.concat_ws("\u0001", "src", "x.field").alias("source"), F.col("x.field").alias("field"), "x.text").filter(F.col("text").rlike("[^\\x00-\\x7f]|\\?"))
    with Scratch(records.sparkSession) as scratch:
        ll, share = fit(texts, scratch, rounds)
        kind = records.schema[record_id].dataType.simpleString()
        doubtful = texts.select(F.col("rid").alias("id"), "source", "text").mapInPandas(_doubtful, f"id {kind}, source string, before string, run string, after string")
        met = doubtful.join(ll.filter(F.coalesce(*[F.col(f"l{k}") for k in _ALL if k]).isNotNull()), _KEY)
        # a chain that leaves an atom as it is reads it as clean
        terms = [F.sum(F.coalesce(F.col(f"l{k}"), F.col("l0"), F.lit(-1000.0))).alias(f"s{k}") for k in _ALL]
        able = [F.max(F.col(f"l{k}").isNotNull()).alias(f"a{k}") for k in _ALL]
        per = met.groupBy("id", "source").agg(*terms, *able).join(share, "source")
        logs = [F.when(F.col(f"a{k}"), F.col(f"s{k}") + F.ln(f"p{k}")) for k in _ALL]
        mass, whole = _mass(logs)
        chain = F.array_max(F.array(*[F.struct(F.coalesce(x, F.lit(-1e300)).alias("w"), F.lit(name).alias("name"), F.lit(-k)) for k, (x, name) in enumerate(zip(logs, CHAINS, strict=True)) if k]))["name"]
        found = per.withColumn("posterior", 1 - mass[0] / whole).filter("posterior > 0.5")
        return stored(found.select(F.col("id").alias(record_id), F.element_at(F.split("source", "\u0001"), -1).alias("field"), chain.alias("chain"), "posterior"), "garbled")


def _restored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        new = [None if c == "lost" else undo(c, t) for c, t in zip(pdf.chain, pdf.text, strict=True)]
        yield pdf.assign(restored=new)


def restore(records: DataFrame, found: DataFrame, record_id: str, field: str) -> DataFrame:
    """(record_id, chain, posterior, text, restored): restored is null where characters were lost."""
    own = found.filter(F.col("field") == field).select(record_id, "chain", "posterior")
    kind = records.schema[record_id].dataType.simpleString()
    return records.select(record_id, F.col(field).alias("text")).join(own, record_id).select(record_id, "chain", "posterior", "text").mapInPandas(_restored, f"{record_id} {kind}, chain string, posterior double, text string, restored string")
