"""Attributes as they were known at the time of an event.

Attribute versions arrive over time and may be late or corrected. The state of an
entity on a day is the best (greatest rank) of all versions known by that day. It is
materialised in a folder in two parts, both by period: snapshots (the best version known
before the period began) and change logs (the best new version of each day). An event
meets exactly one (entity, period) row by an equi-join and replays the few changes up to
its own day; a version that became known later can't reach it.

As the best is a maximum, new versions only add to the state: extend() writes their changes
and their share of the later snapshots as another load, whatever day they became known,
and carries the older snapshots on to new periods. Nothing is written again, and what was
known before isn't read but for its last period. A manifest names the loads that count, so
a failed one leaves no trace, and open() takes the state up in a later session.

Sizes: a change log holds at most one entry a day and load; a snapshot row exists for each
entity and period from the entity's first version to the last day asked for. An entity
that owns a third of all events is spread over its periods, and the join's large side is
split further by adaptive skew handling, as the state side of a key is a single small row.
Versions are pre-aggregated to one row per entity and day before any window, so an entity
with very many versions is combined on the map side.

Defined results: versions without entity or known day never count; events without
entity or day give no row; equal ranks are settled by the rank itself, which should end
in a unique column; repeated rows change nothing; empty inputs give an empty result.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.runtime import DAY_US, fresh_path, get_text, put_text, remove

PERIOD_DAYS = 28


def utc_day(ts: Column) -> Column:
    """Days since 1970-01-01 of an instant, in UTC whatever the session's zone."""
    us = F.unix_micros(ts)
    return ((us - F.pmod(us, F.lit(DAY_US))) / DAY_US).cast("int")


class KnownState:
    """Snapshots and change logs of entities, in a folder that any session can open."""

    def __init__(self, spark: SparkSession, path: str | None = None, period_days: int = PERIOD_DAYS) -> None:
        self.spark, self.path = spark, path or fresh_path(spark, "known")
        self.about: dict = {"loads": [], "period_days": period_days, "horizon": None, "schema": None}

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> KnownState:
        """The state that an earlier session left in a folder."""
        own = cls(spark, path)
        own.about = json.loads(get_text(spark, f"{path}/_manifest.json"))
        return own

    def _rows(self, part: str) -> DataFrame:
        """(entity, period, day, best) of the loads that count; day is null in snapshots."""
        schema = T.StructType.fromJson(self.about["schema"])
        return self._load(part, self.about["loads"]) if self.about["loads"] else self.spark.createDataFrame([], schema)

    def _load(self, part: str, loads: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(self.about["schema"]).add("load", "string")
        base = f"{self.path}/{part}"
        return self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/load={x}" for x in loads]).drop("load").select("entity", "period", "day", "best")

    def extend(self, versions: DataFrame, entity: str, known_day: str, rank: list[Column], value: Column, last_day: int | None) -> KnownState:
        """Adds versions, and carries all snapshots on to the period of last_day.

        known_day: name of an int column, days since 1970. rank: columns compared in turn, the
        greatest counts, nulls lowest. Rank and value must keep their types from load to load.
        """
        days, old = self.about["period_days"], self.about["horizon"]
        until = max([x for x in (old, None if last_day is None else last_day // days) if x is not None], default=None)
        best = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)], value.alias("value"))
        known = versions.select(F.col(entity).alias("entity"), F.col(known_day).cast("int").alias("day"), best.alias("best")).filter("entity is not null and day is not null")
        daily = known.groupBy("entity", "day").agg(F.max("best").alias("best")).withColumn("period", F.floor(F.col("day") / days).cast("int")).select("entity", "period", "day", "best")
        first, load = self.about["schema"] is None, uuid.uuid4().hex
        if first:
            self.about["schema"] = daily.schema.jsonValue()
        daily.write.partitionBy("period").parquet(f"{self.path}/changes/load={load}")
        if until is None:
            daily.limit(0).write.partitionBy("period").parquet(f"{self.path}/snapshots/load={load}")
        else:
            daily = self._load("changes", [load])
            w = Window.partitionBy("entity").orderBy("period")

            def runs_of(rows: DataFrame) -> DataFrame:
                """What is known from the period after a change to that of the next one."""
                per = rows.groupBy("entity", "period").agg(F.max("best").alias("best"))
                return per.select("entity", F.max("best").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("best"), (F.col("period") + 1).alias("a"), F.coalesce(F.lead("period").over(w), F.lit(until)).alias("b"))

            runs = runs_of(daily)
            if not first and old is None:
                runs = runs.unionByName(runs_of(self._rows("changes")))
            elif not first and until > old:
                # what was known in the last period, and changes that were known before their time
                ended = self._rows("snapshots").filter(F.col("period") == old).unionByName(self._rows("changes").filter(F.col("period") >= old))
                runs = runs.unionByName(runs_of(ended))
            filled = runs.select("entity", F.explode(F.when(F.col("a") <= F.col("b"), F.sequence("a", F.least("b", F.lit(until)))).otherwise(F.array().cast("array<int>"))).alias("period"), F.lit(None).cast("int").alias("day"), "best")
            filled.write.partitionBy("period").parquet(f"{self.path}/snapshots/load={load}")
        self.about["loads"], self.about["horizon"] = [*self.about["loads"], load], until
        put_text(self.spark, f"{self.path}/_manifest.json", json.dumps(self.about))
        return self

    def table(self) -> DataFrame:
        """(entity, period, snapshot, changes): what was known before each period and what became known in it."""
        rows = self._rows("snapshots").unionByName(self._rows("changes"))
        change = F.when(F.col("day").isNotNull(), F.struct("day", "best"))
        return rows.groupBy("entity", "period").agg(F.max(F.when(F.col("day").isNull(), F.col("best"))).alias("snapshot"), F.collect_list(change).alias("changes"))

    def drop(self) -> None:
        remove(self.spark, self.path)


def as_known(events: DataFrame, event_id: str, entity: str, day: Column, state: KnownState, out: str) -> DataFrame:
    """(event_id, out): each event with the value of the version that was in force on its day; the state must reach to the last event."""
    small = events.select(F.col(event_id).alias("event_id"), F.col(entity).alias("entity"), day.alias("day")).filter("entity is not null and day is not null")
    met = small.withColumn("period", F.floor(F.col("day") / state.about["period_days"]).cast("int")).join(state.table(), ["entity", "period"])
    replayed = F.array_max(F.transform(F.filter("changes", lambda c: c["day"] <= F.col("day")), lambda c: c["best"]))
    best = F.when(replayed.isNull() | (F.col("snapshot") > replayed), F.col("snapshot")).otherwise(replayed)
    return met.select("event_id", best.alias("best")).filter("best is not null").select(F.col("event_id").alias(event_id), F.col("best.value").alias(out))
