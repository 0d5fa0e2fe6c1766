"""Markdown files with YAML front matter."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import WS
from ..schema import METADATA, METADATA_KEYS, metadata_violations, require

FRONT_MATTER = rf"(?s)\A---[{WS}]*\n(.*?)\n---[{WS}]*\n(.*)\z"


@F.pandas_udf(T.StringType())
def yaml_to_json(s: pd.Series) -> pd.Series:
    """A YAML mapping as JSON; null for any other YAML. Dates become ISO text, other scalars keep their type."""
    import yaml

    def one(x):
        if x is None:
            return None
        value = yaml.safe_load(x)
        return json.dumps(value, default=str) if isinstance(value, dict) else None

    return s.map(one)


def parse_documents(files: DataFrame) -> DataFrame:
    """Metadata columns, ``source_path`` and ``raw_text`` of rows ``(source_path, value)``; fails on a file that breaks a rule."""

    def need(ok, message):
        return F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(message), F.col("source_path"))).cast("boolean"))

    text = files.withColumn("value", F.regexp_replace("value", r"\r\n?", "\n"))
    text = text.where(need(F.col("value").rlike(FRONT_MATTER), "no front matter in "))
    text = text.select("source_path", yaml_to_json(F.regexp_extract("value", FRONT_MATTER, 1)).alias("meta"), F.regexp_replace(F.regexp_extract("value", FRONT_MATTER, 2), f"^[{WS}]+|[{WS}]+$", "").alias("raw_text"))
    text = text.where(need(F.col("meta").isNotNull(), "front matter is no mapping in ")).where(need(F.col("raw_text") != "", "no content in "))
    extra = F.array_except(F.json_object_keys("meta"), F.array(*map(F.lit, METADATA_KEYS)))
    text = text.where(need(F.size(extra) == 0, "unknown metadata key in "))
    # a number or boolean where text is due is an error, not a conversion
    wrong = [k for k in METADATA_KEYS if k != "effective_date"]
    typed = text.withColumn("v", F.try_parse_json("meta"))
    strings = None
    for k in wrong:
        ok = F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant")) == "STRING"
        strings = ok if strings is None else strings & ok
    typed = typed.where(need(F.coalesce(strings, F.lit(False)), "metadata that is missing or no text in "))
    typed = typed.select(F.from_json("meta", METADATA).alias("m"), "source_path", "raw_text").select("m.*", "source_path", "raw_text")
    return require(typed, metadata_violations(), "document metadata")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """All ``*.md`` files directly in ``folder``; an empty folder fails."""
    try:
        files = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
        empty = not files.inputFiles()
    except Exception as e:  # Spark names a missing folder in its own exception
        if "PATH_NOT_FOUND" not in str(e):
            raise
        empty = True
    if empty:
        raise FileNotFoundError(f"no Markdown files in {folder}")
    return parse_documents(files.select(F.col("_metadata.file_path").alias("source_path"), "value"))
