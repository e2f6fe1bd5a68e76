"""Session settings and the shared folder for cut lineages and written tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DAY_US = 86_400_000_000


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all executors share.

    Only a session that runs on one machine (tests) may name none: it is given a temporary one.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not (now := spark.sparkContext.getCheckpointDir()):
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(own := tempfile.mkdtemp(prefix="sheaf-"))
        atexit.register(shutil.rmtree, own, True)
        now = spark.sparkContext.getCheckpointDir()
    return now


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: a lost executor loses none of it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no run has used before."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, scratch: Scratch | None = None) -> DataFrame:
    """df, written once as compressed Parquet in the shared folder and read back; kept unless a scratch holds it."""
    path = fresh_path(df.sparkSession, name)
    if scratch is not None:
        scratch.paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder or file with all it holds, if it is there."""
    fs, p = _at(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, path: str, to: str) -> bool:
    fs, p = _at(spark, path)
    return fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(to))


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file whole: under another name first, so that a reader never meets half of it."""
    fs, p = _at(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    # a rename onto an existing file fails on some file systems
    if not fs.rename(draft, p):
        fs.delete(p, False)
        fs.rename(draft, p)


def get_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    there = fs.open(p)
    try:
        return bytes(there.readAllBytes()).decode()
    finally:
        there.close()


class Scratch:
    """Stored tables that are deleted when the work that needs them ends, whether it succeeds or not."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *what) -> None:
        for p in self.paths:
            remove(self.spark, p)


class BucketTable:
    """A Parquet table in a folder, partitioned by some columns and bucketed by one, that any later session can open.

    Only its folder holds anything; the catalog entry is made anew by each session under a
    name of its own, and dropping it leaves the files.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, parts: list[str], key: str, buckets: int) -> None:
        self.spark, self.path, self.parts, self.key, self.buckets = spark, path, parts, key, buckets
        self.name = f"sheaf_{uuid.uuid4().hex}"
        by = f"PARTITIONED BY ({', '.join(parts)}) " if parts else ""
        spark.sql(f"CREATE TABLE {self.name} ({schema}) USING parquet {by}CLUSTERED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
        if parts and exists(spark, path):
            spark.catalog.recoverPartitions(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, df: DataFrame) -> None:
        """Adds rows; df must have been shuffled to the buckets, so that each task writes one file a partition."""
        columns = self.spark.table(self.name).columns
        df.select(*columns).write.mode("append").format("parquet").partitionBy(*self.parts).bucketBy(self.buckets, self.key).option("path", self.path).saveAsTable(self.name)

    def drop_part(self, **values: int) -> None:
        """Deletes one partition with its files."""
        self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION ({', '.join(f'{k} = {v}' for k, v in values.items())})")
        remove(self.spark, "/".join([self.path, *(f"{k}={values[k]}" for k in self.parts)]))

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
