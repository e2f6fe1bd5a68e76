"""Totals and averages over trailing calendar periods, days without activity included.

Bars are reduced to one per entity and day, cut into chunks of CHUNK_DAYS days (more where a
window is longer) with the days before the chunk that its first windows reach back to, and
sorted inside partitions. A two-stack queue holds the active window: its back takes the
values pushed and their combination, its front the combinations of what is still to leave;
when the front is empty the back is turned over into it. That needs only an associative
operation: sums, counts, maxima and minima go alike, nothing is subtracted and nothing
drifts, at two operations a day on average. The queue carries LANES chunks side by side, a
vector an entry, as every chunk pushes one value each calendar day.

No task ever holds more than LANES chunks, so one entity with a third of all rows is spread
over its chunks. Defined results: of several bars of an entity and day the latest loaded
counts (then the greatest id); null values count as none; entities or days that are null
give no row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_DAYS = 512
LANES = 256
AGGREGATES = ("sum", "n", "avg", "max", "min")


class TwoStackQueue:
    """The last `width` entries pushed and their combination, for any associative operation; an entry is a vector of lanes."""

    def __init__(self, width: int, op: Callable[[np.ndarray, np.ndarray], np.ndarray], identity: np.ndarray) -> None:
        self.width, self.op, self.identity = width, op, identity
        self.front: list[np.ndarray] = []  # combinations from each entry to the newest of the front; the oldest last
        self.back: list[np.ndarray] = []
        self.pushed = identity  # combination of the back

    def push(self, value: np.ndarray) -> None:
        if len(self.front) + len(self.back) == self.width:
            self.evict()
        self.back.append(value)
        self.pushed = self.op(self.pushed, value)

    def evict(self) -> None:
        """Lets the oldest entry go."""
        if not self.front:
            held = self.identity
            while self.back:
                held = self.op(self.back.pop(), held)
                self.front.append(held)
            self.pushed = self.identity
        self.front.pop()

    def total(self) -> np.ndarray:
        return self.op(self.front[-1], self.pushed) if self.front else self.pushed


def over_windows(values: np.ndarray, width: int, op: Callable[[np.ndarray, np.ndarray], np.ndarray], identity: float) -> np.ndarray:
    """op over the last `width` columns up to each column (fewer at the start); a row is a lane."""
    queue = TwoStackQueue(width, op, np.full(len(values), identity, dtype=values.dtype))
    out = np.empty_like(values)
    for k in range(values.shape[1]):
        queue.push(values[:, k])
        out[:, k] = queue.total()
    return out


def _windows(columns: list[str], widths: list[int], aggregates: tuple[str, ...], chunk_days: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    reach = max(widths) - 1

    def emit(groups: list[pd.DataFrame]) -> pd.DataFrame:
        heads = [g.iloc[0] for g in groups]
        lo, hi, chunk = (np.array([int(h[c]) for h in heads]) for c in ("lo", "hi", "chunk"))
        start = chunk * chunk_days - reach
        days = start[:, None] + np.arange(chunk_days + reach)
        keep = (days >= np.maximum(lo, chunk * chunk_days)[:, None]) & (days <= hi[:, None])
        bars = pd.concat([g[g.is_bar].assign(lane=k) for k, g in enumerate(groups)], ignore_index=True)
        lane, at = bars.lane.to_numpy(dtype=int), bars.day.to_numpy(dtype="int64") - start[bars.lane.to_numpy(dtype=int)]
        out = {"entity": np.repeat([h.entity for h in heads], keep.sum(axis=1)), "day": days[keep].astype("int32")}
        for c in columns:
            raw = bars[c]
            there = raw.notna().to_numpy()
            kind = "int64" if raw.dtype.kind in "iu" or raw.dtype == "Int64" else "float64"
            where, v = (lane[there], at[there]), raw.to_numpy(dtype=kind, na_value=0)[there]

            def filled(kind: str, empty: float, value, where=where) -> np.ndarray:
                x = np.full(days.shape, empty, dtype=kind)
                x[where] = value
                return x

            # the number of values is needed for averages and for extremes of nothing
            inputs = {"sum": (filled(kind, 0, v), np.add, 0), "n": (filled("int64", 0, 1), np.add, 0), "max": (filled("float64", -np.inf, v), np.maximum, -np.inf), "min": (filled("float64", np.inf, v), np.minimum, np.inf)}
            for w in widths:
                for name in aggregates:
                    out[f"{c}_{name}_{w}"] = over_windows(inputs[name][0], w, *inputs[name][1:])[keep]
        return pd.DataFrame(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, ready = None, []
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if pdf.empty:
                continue
            key = (pdf.entity != pdf.entity.shift()) | (pdf.chunk != pdf.chunk.shift())
            starts = [*np.flatnonzero(key.to_numpy())]
            for a, b in zip(starts, starts[1:], strict=False):
                # without its mark a group is only the halo of a chunk beyond the entity's last day
                if not pdf.is_bar.iloc[a]:
                    ready.append(pdf.iloc[a:b])
                if len(ready) == LANES:
                    yield emit(ready)
                    ready = []
            rest = pdf.iloc[starts[-1] :]
        if rest is not None and not rest.is_bar.iloc[0]:
            ready.append(rest)
        if ready:
            yield emit(ready)

    return run


def trailing_totals(bars: DataFrame, entity: str, day: str, latest: list[str], columns: list[str], widths: list[int], aggregates: tuple[str, ...] = AGGREGATES) -> DataFrame:
    """(entity, day, <column>_<aggregate>_<width>): sums, counts (n), averages (avg, of both), maxima and minima as asked for, one row for each entity and day from its first to its last bar.

    day: name of a date column. latest: columns of which the greatest decides between bars of one
    day. Whole-number columns keep long totals. max and min come out as doubles.
    """
    reach = max(widths) - 1
    chunk_days = max(CHUNK_DAYS, reach + 1)  # the days before a chunk lie in the one before it
    held = tuple(a for a in AGGREGATES if a != "avg" and (a in aggregates or (a == "n" and {"max", "min", "avg"} & {*aggregates}) or (a == "sum" and "avg" in aggregates)))
    kinds = {c: "long" if bars.schema[c].dataType.typeName() in ("byte", "short", "integer", "long") else "double" for c in columns}
    one = (
        bars.select(F.col(entity).alias("entity"), F.datediff(F.col(day), F.lit("1970-01-01").cast("date")).alias("day"), F.struct(*[F.col(x).alias(f"l{i}") for i, x in enumerate(latest)], *[F.col(c).cast(kinds[c]).alias(f"v{i}") for i, c in enumerate(columns)]).alias("bar"))
        .filter("entity is not null and day is not null")
        .groupBy("entity", "day")
        .agg(F.max("bar").alias("bar"))
    )
    clean = [F.when(~F.isnan(F.col(f"bar.v{i}")), F.col(f"bar.v{i}")) if kinds[c] == "double" else F.col(f"bar.v{i}") for i, c in enumerate(columns)]
    one = one.select("entity", "day", *[x.alias(c) for x, c in zip(clean, columns, strict=True)])
    chunk = F.floor(F.col("day") / chunk_days).cast("int")
    span = one.groupBy("entity").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    marks = span.select("entity", F.explode(F.sequence(F.floor(F.col("lo") / chunk_days).cast("int"), F.floor(F.col("hi") / chunk_days).cast("int"))).alias("chunk"), "lo", "hi", F.lit(False).alias("is_bar"))
    halo = F.when(F.pmod(F.col("day"), F.lit(chunk_days)) >= chunk_days - reach, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    filled = one.select("*", F.explode(halo).alias("chunk"), F.lit(True).alias("is_bar"))
    rows = marks.unionByName(filled, allowMissingColumns=True).repartition("entity", "chunk").sortWithinPartitions("entity", "chunk", "is_bar", "day")
    kind = bars.schema[entity].dataType.simpleString()
    of = {"sum": None, "n": "long", "max": "double", "min": "double"}
    schema = f"entity {kind}, day int, " + ", ".join(f"{c}_{a}_{w} {of[a] or kinds[c]}" for c in columns for w in widths for a in held)
    out = rows.mapInPandas(_windows(columns, widths, held, chunk_days), schema)

    def result(c: str, a: str, w: int) -> Column:
        n = F.col(f"{c}_n_{w}") if "n" in held else None
        x = F.col(f"{c}_sum_{w}") / n if a == "avg" else F.col(f"{c}_{a}_{w}")
        return (F.when(n > 0, x) if a in ("avg", "max", "min") else x).alias(f"{c}_{a}_{w}")

    return out.select(F.col("entity").alias(entity), F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")).alias(day), *[result(c, a, w) for c in columns for w in widths for a in aggregates])
