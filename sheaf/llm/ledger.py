"""Copies that differ only in formatting, collapsed and counted by an incremental ledger.

A record's canonical key keeps the letters and digits of its fields in order, case folded;
of a url the query parameters are sorted first. The ledger holds one row a key: the key's
128-bit digest, the number of copies so far and the earliest representative. It lies in the
shared folder in GROUPS x buckets files: a group is a Parquet partition, and inside it rows
are bucketed by key. A batch is aggregated on its own (combined on the map side, so a key
with a third of all rows arrives as one partial row a task) and met by a full outer join
with the groups that its keys fall into, and with no others; the ledger's side is read by
buckets and never shuffled. Only the groups met are written again, under the next version;
then a manifest that names each group's version replaces the last one, and what it no
longer names is deleted. A batch that fails before that leaves the ledger as it was, and
open() takes it up in any later session.

Digests are MD5 over the key with its field lengths: for N keys the chance of any false
match is below N^2 / 2^129. Defined results: a record with a null field has no key and is
left out; a field without letters and digits counts as empty; repeated rows are copies;
long texts are digested whole; an empty batch changes nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.runtime import BucketTable, Scratch, exists, fresh_path, get_text, put_text, remove, stored

GROUPS = 8


def letters_and_digits(text: Column) -> Column:
    """text without anything but letters and digits, in lower case, ß as the SS of its upper case."""
    return F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), "[^\\p{L}\\p{N}]+", "")


def canonical_url(url: Column) -> Column:
    """The letters and digits of a url, its query parameters in sorted order; null for null."""
    mark = F.instr(url, "?")
    path = F.when(mark > 0, F.substring(url, F.lit(1), mark - 1)).otherwise(url)
    query = F.when(mark > 0, F.substring(url, mark + 1, F.length(url))).otherwise(F.lit(""))
    params = F.array_sort(F.transform(F.split(query, "[&;]"), letters_and_digits))
    return F.when(url.isNotNull(), F.concat(letters_and_digits(path), F.array_join(params, "")))


def digest(*parts: Column) -> Column:
    """128 bits of the parts; null if one is null."""
    return F.unhex(F.md5(F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts])))


def loads(rows: DataFrame, batch: str, per_load: int) -> list[Column]:
    """Filters for runs of so many consecutive batches, in order; rows without a batch come with the first."""
    numbers = sorted(r[0] for r in rows.select(batch).distinct().collect() if r[0] is not None)  # one a batch
    runs = [numbers[i : i + per_load] for i in range(0, len(numbers), per_load)]
    first = F.col(batch).isNull()
    if not runs:
        return [first]
    return [F.col(batch).between(r[0], r[-1]) | (first if k == 0 else F.lit(False)) for k, r in enumerate(runs)]


class Ledger:
    """Counts and earliest representatives by canonical key, in a folder that any session can open."""

    def __init__(self, spark: SparkSession, path: str | None = None, order_type: str = "long", groups: int = GROUPS, buckets: int | None = None) -> None:
        self.spark, self.path = spark, path or fresh_path(spark, "ledger")
        self.about = {"order_type": order_type, "groups": groups, "buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "version": 0, "held": {}}
        self._attach()

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Ledger:
        """The ledger that an earlier session left in a folder."""
        own = cls.__new__(cls)
        own.spark, own.path, own.about = spark, path, json.loads(get_text(spark, f"{path}/_manifest.json"))
        own._attach()
        return own

    def _attach(self) -> None:
        self.table = BucketTable(self.spark, f"{self.path}/rows", f"key binary, n_copies long, first_id {self.about['order_type']}, grp int, version int", ["grp", "version"], "key", self.about["buckets"])

    def rows(self, groups: list[int] | None = None) -> DataFrame:
        """(key, n_copies, first_id) of all groups, or of some."""
        held = [f"{g}/{v}" for g, v in self.about["held"].items() if groups is None or int(g) in groups]
        return self.table.read().filter(F.concat_ws("/", "grp", "version").isin(held)).select("key", "n_copies", "first_id")

    def update(self, batch: DataFrame, key: Column, record_id: Column) -> Ledger:
        """Adds a batch; record_id orders the records, its smallest is the representative."""
        about = self.about
        group = F.pmod(F.xxhash64("key"), F.lit(about["groups"])).cast("int")
        new = batch.select(key.alias("key"), record_id.alias("id")).filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
        with Scratch(self.spark) as scratch:
            delta = stored(new.withColumn("grp", group), "batch", scratch)
            touched = sorted(r.grp for r in delta.select("grp").distinct().collect())  # at most as many as the ledger has groups
            if not touched:
                return self
            version = about["version"] + 1
            for g in touched:  # what a failed update may have left
                if exists(self.spark, f"{self.table.path}/grp={g}/version={version}"):
                    self.table.drop_part(grp=g, version=version)
            met = self.rows(touched).join(delta.drop("grp").hint("shuffle_merge"), "key", "full_outer")
            merged = met.select("key", (F.coalesce("n_copies", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n_copies"), F.least("first_id", "first").alias("first_id"))
            self.table.append(merged.withColumns({"grp": group, "version": F.lit(version)}))
        old = {g: about["held"].get(str(g)) for g in touched}
        about["version"], about["held"] = version, about["held"] | {str(g): version for g in touched}
        put_text(self.spark, f"{self.path}/_manifest.json", json.dumps(about))
        for g, v in old.items():
            if v is not None:
                self.table.drop_part(grp=g, version=v)
        return self

    def drop(self) -> None:
        self.table.close()
        remove(self.spark, self.path)
