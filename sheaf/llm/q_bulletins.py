"""Queries over the bulletins: p5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.scans import repaired
from sheaf.runtime import read

FIELDS = ["weather_highlights", "corn_section", "corn_table_text", "report_text"]


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bulletin's fields as continuous paragraphs and table lines, with the kinds of noise they had."""
    return repaired(read(spark, sf_dir, "wwcb_core_text"), "bulletin_id", FIELDS, ["national_ag_summary"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of scan noise in each field of each bulletin."""
    return p5_repaired(spark, sf_dir).select("bulletin_id", "field_name", F.explode("kinds").alias("noise_kind"))


QUERIES = {"p5_found": p5_found, "p5_repaired": p5_repaired}
ORACLE: dict[str, str] = {}
