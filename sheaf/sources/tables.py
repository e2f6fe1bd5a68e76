"""Table readers and writers with the conventions of the pipelines."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.runtime import exists, get_text, put_text, rename
from sheaf.sources.demo import demo_prices

DATE_COLUMNS = ("date", "week", "release_date")
DATE_ALIASES = ("date", "Date", "datetime", "Datetime", "time")
CLOSE_ALIASES = ("adj_close", "Adj Close", "close", "Close", "price")


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or its sibling with .csv, is there; on any file system Spark reads."""
    jvm = spark._jvm
    found = lambda p: (q := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(q)
    return found(path) or found(path.rsplit(".", 1)[0] + ".csv")


def coerce_dates(df: DataFrame, columns: tuple[str, ...] = DATE_COLUMNS) -> DataFrame:
    """Named columns as dates; what isn't one becomes null."""
    return df.withColumns({c: F.col(c).try_cast("date") for c in columns if c in df.columns and df.schema[c].dataType != T.DateType()})


def read_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A Parquet table, or the CSV of the same stem where there is no Parquet."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return coerce_dates(spark.read.parquet(path))
    reader = spark.read.option("header", True)
    return coerce_dates((reader.schema(schema) if schema is not None else reader).csv(path.rsplit(".", 1)[0] + ".csv"))


def read_price_csv(spark: SparkSession, path: str) -> DataFrame:
    """(date, close) of a CSV with any of the usual column names; rows without either fall away."""
    df = spark.read.option("header", True).csv(path)
    day, close = (next((c for c in names if c in df.columns), None) for names in (DATE_ALIASES, CLOSE_ALIASES))
    if day is None or close is None:
        raise ValueError(f"no date or close column in {df.columns}")
    return df.select(F.substring(F.col(f"`{day}`"), 1, 10).try_cast("date").alias("date"), F.col(f"`{close}`").try_cast("double").alias("close")).na.drop().orderBy("date")


def read_months(spark: SparkSession, root: str) -> DataFrame:
    """A table laid out as year=YYYY/month=MM; filters on those two prune the folders."""
    return spark.read.parquet(root)


def find_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, length, modificationTime) of a file, or of the files of a folder that match, in order of their paths; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime").orderBy("path")


def normal_bars(df: DataFrame) -> DataFrame:
    """(date, open, high, low, close, adj_close, volume) from the usual names in any letter case, in order of the date; rows without close fall away.

    Without adjusted close the close stands for it; other columns that are missing are null.
    """
    have = {c.lower().replace(" ", "_"): c for c in df.columns}
    day = next((have[c] for c in ("date", "datetime", "index") if c in have), None)
    if day is None or "close" not in have:
        raise ValueError(f"no date or close column in {df.columns}")
    pick = lambda name, kind: (F.col(f"`{have[name]}`") if name in have else F.lit(None)).cast(kind).alias(name)
    adjusted = pick("adj_close", "double") if "adj_close" in have else pick("close", "double").alias("adj_close")
    return df.select(F.col(f"`{day}`").cast("date").alias("date"), *[pick(c, "double") for c in ("open", "high", "low", "close")], adjusted, pick("volume", "long")).filter("close is not null").orderBy("date")


def load_prices(spark: SparkSession, path: str, start: str, end: str, demo: bool = False) -> DataFrame:
    """The cached table's days of an inclusive span, or made-up bars."""
    if demo:
        return demo_prices(spark, start, end)
    if not table_exists(spark, path):
        raise FileNotFoundError(f"no price table at {path}; fill it, or ask for demo bars")
    return normal_bars(read_table(spark, path)).filter(F.col("date").between(start, end))


def save_metrics(spark: SparkSession, path: str, metrics: dict) -> None:
    """A small JSON file; NaN is allowed."""
    put_text(spark, path, json.dumps(metrics, indent=2, sort_keys=True, default=str))


def load_metrics(spark: SparkSession, path: str) -> dict:
    return json.loads(get_text(spark, path))


def run_metadata(spark: SparkSession, inputs: dict[str, str], parameters: dict, results: dict[str, DataFrame]) -> dict:
    """What a run read, with which parameters, and the rows and columns of what it made."""
    return {"made_at": datetime.now(UTC).isoformat(timespec="seconds"), "spark": spark.version, "inputs": inputs, "parameters": parameters, "results": {k: {"rows": df.count(), "columns": df.columns} for k, df in results.items()}}


def replace_with_backup(df: DataFrame, path: str, overwrite: bool = False) -> str | None:
    """Writes a table; one that is there is refused, or (overwrite) kept under the returned name. df may read from it."""
    spark = df.sparkSession
    if not exists(spark, path):
        df.write.parquet(path)
        return None
    if not overwrite:
        raise FileExistsError(f"{path} is there; allow overwriting to replace it")
    kept = f"{path}.{datetime.now(UTC):%Y%m%dT%H%M%S%f}.bak"
    fresh = f"{path}.new"
    df.write.mode("overwrite").parquet(fresh)
    for a, b in ((path, kept), (fresh, path)):
        if not rename(spark, a, b):
            raise OSError(f"{a} can't be renamed to {b}")
    return kept


def append_missing(wanted: DataFrame, path: str, keys: list[str], make) -> int:
    """Makes and appends the rows whose key a table doesn't hold yet, so that an interrupted run goes on where it stopped; the number appended."""
    spark = wanted.sparkSession
    rest = wanted.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti") if exists(spark, path) else wanted
    before = spark.read.parquet(path).count() if exists(spark, path) else 0
    make(rest).write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def write_table(df: DataFrame, path: str, overwrite: bool = True) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_months(df: DataFrame, root: str, day: str, overwrite: bool = False) -> None:
    """Month folders; only those that df touches are written, and without overwrite only those that aren't there."""
    spark = df.sparkSession
    out = df.withColumns({"year": F.date_format(day, "yyyy"), "month": F.date_format(day, "MM")})
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not overwrite and p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        there = spark.read.option("basePath", root).parquet(root).select(F.lpad(F.col("year").cast("string"), 4, "0").alias("year"), F.lpad(F.col("month").cast("string"), 2, "0").alias("month")).distinct()
        out = out.join(there, ["year", "month"], "left_anti")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(root)
