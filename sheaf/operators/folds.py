"""Walk-forward folds, statistics fitted on their training part, and models by fold."""

from __future__ import annotations

import functools
import heapq
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.operators.boosting import boosted
from sheaf.operators.tfidf import STOP_WORDS
from sheaf.runtime import Scratch, stored

def fold_table(panel: DataFrame, week: str, split: str, window: int = 13, step: int = 13, rolling: int | None = None) -> DataFrame:
    """(fold, train_from, test_from, test_to): from the first week after split in steps, up to the last week.

    The bounds are two scalars of the panel. Dates lie in the years 1 to 9999, so there are at
    most half a million folds of a week and 40,000 of a quarter: the table may be broadcast.
    """
    ends = panel.filter(F.col(week) > F.lit(split).cast("date")).agg(F.min(week).alias("lo"), F.max(week).alias("hi"))
    at = ends.filter("lo is not null").select(F.posexplode(F.sequence("lo", "hi", F.expr(f"interval {7 * step} days"))).alias("fold", "test_from"))
    train_from = F.date_sub("test_from", 7 * rolling) if rolling else F.lit("0001-01-01").cast("date")
    return at.select("fold", train_from.alias("train_from"), "test_from", F.date_add("test_from", 7 * (window - 1)).alias("test_to"))


def year_folds(panel: DataFrame, day: str, first_train: int = 1, first_test: int | None = None) -> DataFrame:
    """(fold, train_from, test_from, test_to): each year of the panel tested on all years from first_train before it; fold is the year."""
    years = panel.filter(F.col(day).isNotNull()).select(F.year(day).alias("fold")).distinct()
    years = years if first_test is None else years.filter(F.col("fold") >= first_test)
    at = lambda y, m, d: F.make_date(y, F.lit(m), F.lit(d))
    return years.select("fold", at(F.lit(first_train), 1, 1).alias("train_from"), at(F.col("fold"), 1, 1).alias("test_from"), at(F.col("fold"), 12, 31).alias("test_to"))


def assigned(panel: DataFrame, folds: DataFrame, week: str) -> DataFrame:
    """panel rows by fold with role train or test; a row of several folds comes once for each."""
    w = F.col(week)
    met = panel.join(F.broadcast(folds), (w >= F.col("train_from")) & (w <= F.col("test_to")))
    return met.withColumn("role", F.when(w < F.col("test_from"), "train").otherwise("test"))


def train_statistics(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Median, mean and population deviation of the columns' imputed values over the training rows."""
    train = rows.filter("role = 'train'")
    med = train.groupBy(*by).agg(*[F.median(c).alias(f"{c}_median") for c in columns])
    filled = train.join(med, by).select(*by, *[F.coalesce(c, f"{c}_median").alias(c) for c in columns])
    spread = filled.groupBy(*by).agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))])
    return med.join(spread, by)


def standardised(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Columns imputed and scaled with their fold's training statistics; a constant column is only centred."""
    out = rows.join(train_statistics(rows, by, columns), by)
    scaled = {c: (F.coalesce(c, f"{c}_median") - F.col(f"{c}_mean")) / F.when(F.col(f"{c}_std") > 0, F.col(f"{c}_std")).otherwise(1.0) for c in columns}
    return out.withColumns(scaled).drop(*[f"{c}_{k}" for c in columns for k in ("median", "mean", "std")])


def ridge(x: np.ndarray, y: np.ndarray, alpha: float) -> Callable[[np.ndarray], np.ndarray]:
    """Ridge regression in closed form; the intercept isn't shrunk."""
    mx, my = x.mean(axis=0), y.mean()
    c = x - mx
    b = np.linalg.solve(c.T @ c + alpha * np.eye(x.shape[1]), c.T @ (y - my))
    return lambda z: (z - mx) @ b + my


def grid_alpha(x: np.ndarray, y: np.ndarray, alphas: tuple[float, ...] = (0.01, 0.1, 1, 10, 100), splits: int = 5) -> float:
    """The alpha with the least mean squared error over expanding contiguous splits."""
    n, size = len(y), len(y) // (splits + 1)
    if size < 2:
        return 1.0
    starts = [n - (splits - k) * size for k in range(splits)]
    loss = [np.mean([np.mean((ridge(x[:s], y[:s], a)(x[s : s + size]) - y[s : s + size]) ** 2) for s in starts]) for a in alphas]
    return float(alphas[int(np.argmin(loss))])


def softmax_fit(x: np.ndarray, y: np.ndarray, classes: list[int], penalty: float = 1.0, steps: int = 300, intercept: bool = False) -> Callable[[np.ndarray], np.ndarray]:
    """Multinomial logistic regression with balanced weights, by accelerated gradient steps; one class gives that class.

    intercept: whether it is shrunk, too. Of two classes each holds half of a binary model's
    coefficients, so twice the penalty shrinks as much.
    """
    here = [c for c in classes if (y == c).any()]
    if len(here) == 1:
        return lambda z: np.tile([float(c == here[0]) for c in classes], (len(z), 1))
    hot = np.stack([y == c for c in classes], axis=1).astype(float)
    weight = hot @ np.array([len(y) / (len(here) * max(1, (y == c).sum())) for c in classes])
    a = np.hstack([np.ones((len(x), 1)), x])
    able = np.array([0.0 if c in here else -1e9 for c in classes])
    b = v = np.zeros((a.shape[1], len(classes)))
    shrink = np.array([penalty if intercept else 0.0] + [penalty] * x.shape[1])[:, None]
    rate = 1.0 / (0.5 * np.linalg.norm(a * np.sqrt(weight)[:, None], 2) ** 2 + penalty)

    def prob(z: np.ndarray, b: np.ndarray) -> np.ndarray:
        s = np.hstack([np.ones((len(z), 1)), z]) @ b + able
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    for k in range(steps):
        new = v - rate * (a.T @ ((prob(x, v) - hot) * weight[:, None]) + shrink * v)
        v, b = new + k / (k + 3) * (new - b), new
    return lambda z: prob(z, b)


@dataclass(frozen=True)
class Model:
    """What to fit: numeric columns, optionally a text's most frequent terms, a target, and the kind of model.

    Kinds are ridge (alpha None: chosen on expanding splits), logit and classes (balanced
    logistic models of two or more classes), boosted and boosted_up (histogram boosting of a
    number or a class of 0 and 1). Of two classes the prediction is the probability of the
    greater, of more the likeliest class.
    """

    name: str
    columns: tuple[str, ...]
    target: str
    kind: str = "ridge"
    alpha: float | None = 1.0
    classes: tuple[int, ...] = (-1, 0, 1)
    text: str | None = None
    terms: int = 30


@functools.lru_cache(maxsize=1024)
def _counted(text: str | None) -> Counter:
    """Words and pairs of neighbouring words of a text; series that share their texts, and folds, count each once."""
    w = [x for x in re.findall(r"\w\w+", (text or "").lower()) if x not in _STOPPED]
    return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])


def _weights(train: np.ndarray, test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed weights of length 1 from the terms' counts in each text."""
    idf = np.log((1 + len(train)) / (1 + (train > 0).sum(axis=0))) + 1

    def weights(x: np.ndarray) -> np.ndarray:
        x = x * idf
        return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)

    return weights(train), weights(test)


def _terms(train: pd.Series, test: pd.Series, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the training texts' most frequent words and pairs of words."""
    docs = [_counted(t) for t in train]
    total: Counter = Counter()
    for d in docs:
        total.update(d)
    vocabulary = [t for t, _ in heapq.nsmallest(most, total.items(), key=lambda x: (-x[1], x[0]))]
    counts = lambda some: np.array([[d[t] for t in vocabulary] for d in some], dtype=float).reshape(len(some), len(vocabulary))
    return _weights(counts(docs), counts([_counted(t) for t in test]))


@dataclass(frozen=True)
class SharedTerms:
    """Counts by date (rows) and term (columns, sorted) of texts that all series share; the last row is that of other dates."""

    row: dict
    counts: np.ndarray

    def weights(self, train: pd.Series, test: pd.Series, most: int) -> tuple[np.ndarray, np.ndarray]:
        """As _terms, from the dates of the texts."""
        a, b = (self.counts[[self.row.get(d, -1) for d in some]] for some in (train, test))
        total = a.sum(axis=0)
        top = np.argsort(-total, kind="stable")[:most]
        top = top[total[top] > 0]
        return _weights(a[:, top], b[:, top])


def _leading(term: np.ndarray, at: np.ndarray, n: np.ndarray, sets: np.ndarray, dates: int, most: int) -> np.ndarray:
    """Which rows (term, date, count) have a term that is among the most frequent of any set of dates.

    sets: a row of packed bits for each. Terms come by their total over all dates, which bounds that
    over a set: a set is done once its last place can't be taken by any term that is left.
    """
    names, code = np.unique(term, return_inverse=True)
    size = len(names)
    total = np.bincount(code, n, size).astype(np.int64)
    turn = np.argsort(-total, kind="stable")
    rank = np.empty(size, dtype=np.int64)
    rank[turn] = np.arange(size)
    by_rank = np.argsort(rank[code], kind="stable")
    starts = np.searchsorted(rank[code][by_rank], np.arange(size + 1))
    found = np.zeros(size, dtype=bool)
    for k in range(0, len(sets), 2048):
        bits = np.unpackbits(sets[k : k + 2048], axis=1, count=dates).astype(float)
        best = np.full((len(bits), most), -1, dtype=np.int64)
        left = np.arange(len(bits))
        for lo in range(0, size, 256):
            left = left[best[left].min(axis=1) // size <= total[turn[lo]]]
            if not len(left):
                break
            some = turn[lo : lo + 256]
            rows = by_rank[starts[lo] : starts[lo + len(some)]]
            dense = np.zeros((dates, len(some)))
            np.add.at(dense, (at[rows], rank[code[rows]] - lo), n[rows])
            sums = (bits[left] @ dense).astype(np.int64)
            # one number for count and name: of equal counts the first name is ahead
            keys = np.where(sums > 0, sums * size + (size - 1 - some), -1)
            best[left] = -np.partition(-np.hstack([best[left], keys]), most - 1, axis=1)[:, :most]
        found[size - 1 - np.unique(best[best >= 0] % size)] = True
    return found[code]


def shared_terms(panel: DataFrame, by: list[str], models: list[Model], order: str, spans: list[tuple], texts: DataFrame, least: int) -> SharedTerms:
    """Counts of all terms that are among the most frequent of any series' training part of any fold.

    Texts (order, text) are counted once, not once a series. A term's counts of all dates lie in one
    group; groups keep the terms that lead there in any training part and meet in fewer groups,
    in the end in one. To the driver come the distinct training parts, a bit a date, and the last terms.
    """
    spark, text = panel.sparkSession, models[0].text
    parts, most = int(spark.conf.get("spark.sql.shuffle.partitions")), max(m.terms for m in models)
    kind = panel.schema[order].dataType.simpleString()

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, t in zip(pdf[order], pdf[text], strict=True):
                c = _counted(t)
                yield pd.DataFrame({order: [d] * len(c), "term": list(c), "n": list(c.values())})

    with Scratch(spark) as scratch:
        counts = stored(texts.filter(F.col(order).isNotNull()).select(order, text).repartition(parts, order).mapInPandas(counted, f"{order} {kind}, term string, n long"), "terms", scratch)
        dates = [r[0] for r in counts.select(order).distinct().orderBy(order).collect()]  # bounded by the calendar
        row = {d: k for k, d in enumerate(dates)}

        def trained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = set()
                for at in pdf["at"]:
                    for _, lo, start, _ in spans:
                        if len(train := [d for d in at if lo <= d < start]) >= least:
                            bits = np.zeros(len(dates), dtype=bool)
                            bits[[row[d] for d in train if d in row]] = True
                            out.add(np.packbits(bits).tobytes())
                yield pd.DataFrame({"bits": list(out)})

        met = functools.reduce(DataFrame.union, [panel.filter(F.col(t).isNotNull()).groupBy(*by).agg(F.collect_list(order).alias("at")).select("at") for t in dict.fromkeys(m.target for m in models)])
        bits = met.mapInPandas(trained, "bits binary").distinct().toArrow()["bits"].to_pylist()
        sets = np.frombuffer(b"".join(bits), dtype=np.uint8).reshape(len(bits), -(-len(dates) // 8))

        def led(pdf: pd.DataFrame) -> pd.DataFrame:
            return pdf[_leading(pdf["term"].to_numpy(dtype=object), np.array([row[d] for d in pdf[order]], dtype=int), pdf["n"].to_numpy(), sets, len(dates), most)]

        last, groups = counts, parts
        while True:
            last = last.groupBy(F.pmod(F.xxhash64("term"), F.lit(groups))).applyInPandas(led, counts.schema)
            if groups == 1:
                break
            groups = max(1, groups // 64)
        got = last.toPandas()
    column = {t: k for k, t in enumerate(sorted(set(got["term"])))}
    out = np.zeros((len(dates) + 1, len(column)))
    out[[row[d] for d in got[order]], [column[t] for t in got["term"]]] = got["n"]
    return SharedTerms(row, out)


_STOPPED = frozenset(STOP_WORDS)


def _imputed(train: pd.DataFrame, test: pd.DataFrame, columns: list[str], scale: bool) -> tuple[np.ndarray, np.ndarray]:
    """Both parts with the training part's medians for nulls and, if asked for, its means and deviations taken out."""
    t, z = train[columns].astype(float), test[columns].astype(float)
    med = t.median().fillna(0.0)
    t, z = t.fillna(med).to_numpy(), z.fillna(med).to_numpy()
    if not scale:
        return t, z
    mean, std = t.mean(axis=0), t.std(axis=0)
    std[std == 0] = 1.0
    return (t - mean) / std, (z - mean) / std


def fitted(train: pd.DataFrame, test: pd.DataFrame, m: Model, weights: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, float | None] | None:
    """(predictions for test, alpha) of a model; None where classes are asked for and the training part has one only.

    weights: those of the text's terms, if they are known.
    """
    y = train[m.target].to_numpy(dtype=float)
    x, z = _imputed(train, test, list(m.columns), not m.kind.startswith("boosted")) if m.columns else (np.zeros((len(train), 0)), np.zeros((len(test), 0)))
    if m.text:
        a, b = _terms(train[m.text], test[m.text], m.terms) if weights is None else weights
        x, z = np.hstack([x, a]), np.hstack([z, b])
    if m.kind == "ridge":
        alpha = grid_alpha(x, y) if m.alpha is None else m.alpha
        return ridge(x, y, alpha)(z), alpha
    if m.kind == "boosted":
        return boosted(x, y)(z), None
    if len(set(y)) < 2:
        return None
    if m.kind == "boosted_up":
        return np.clip(boosted(x, y, classes=True)(z), 1e-6, 1 - 1e-6), None
    two = len(m.classes) == 2
    p = softmax_fit(x, y, list(m.classes), 2.0 if two else 1.0, intercept=two)(z)
    return (p[:, -1] if len(m.classes) == 2 else np.array(m.classes, dtype=float)[p.argmax(axis=1)]), None


def walk_forward(panel: DataFrame, by: list[str], models: list[Model], order: str, folds: DataFrame, least: int = 20, texts: DataFrame | None = None) -> DataFrame:
    """(by, fold, model, order, y_true, y_pred, train_mean, alpha, n_train) of the test rows of each fold and model.

    A series' rows go to one task once, whatever the number of folds and models: it has one row
    a day or week, so the calendar bounds it (a repeated key fails). Folds with fewer training rows
    than `least`, or without test rows, give none. texts: (order, text) of models with a text, where
    all series share them; else the text is a column of the panel.
    """
    needed = list(dict.fromkeys(c for m in models for c in (*m.columns, m.target, *([m.text] if m.text and texts is None else []))))
    spans = [tuple(r) for r in folds.select("fold", "train_from", "test_from", "test_to").orderBy("fold").collect()]  # bounded, see fold_table
    kinds = {**{c: panel.schema[c].dataType.simpleString() for c in [*by, order]}}
    shared = shared_terms(panel, by, own, order, spans, texts, least) if texts is not None and (own := [m for m in models if m.text]) else None
    schema = ", ".join([f"{c} {kinds[c]}" for c in by] + ["fold int", "model string", f"{order} {kinds[order]}", "y_true double", "y_pred double", "train_mean double", "alpha double", "n_train long"])
    names = [x.split()[0] for x in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        if pdf[order].duplicated().any():
            raise ValueError(f"repeated key {by} {order}")
        at, out = pdf[order], []
        for fold, lo, start, end in spans:
            past, now = (at >= lo) & (at < start), (at >= start) & (at <= end)
            if not now.any():
                continue
            for m in models:
                usable = pdf[m.target].notna()
                train, test = pdf[past & usable], pdf[now & usable]
                if len(train) < least or test.empty:
                    continue
                weights = shared.weights(train[order], test[order], m.terms) if shared and m.text else None
                if (got := fitted(train, test, m, weights)) is None:
                    continue
                out.append(test[[*by, order]].assign(fold=fold, model=m.name, y_true=test[m.target].astype(float), y_pred=got[0], train_mean=train[m.target].astype(float).mean(), alpha=np.nan if got[1] is None else got[1], n_train=len(train))[names])
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=names)

    # models cost far more than their rows weigh: small partitions mustn't be put together
    parts = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return panel.select(*by, order, *needed).repartition(parts, *by).groupBy(*by).applyInPandas(run, schema)
