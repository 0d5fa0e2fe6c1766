"""Evaluation cases from a JSON list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FILTER_FIELDS
from ..schema import CASE, case_violations, require, unknown_keys

KEYS = tuple(x.split()[0] for x in CASE.split(", "))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Validated cases with ``ordinal``; anything but a list fails, as do unknown keys."""
    raw = spark.read.text(path, wholetext=True)
    listed = raw.select(F.from_json("value", "array<string>").alias("rows"), F.substring(F.trim("value"), 1, 1).alias("first"))
    listed = listed.where(F.when(F.col("first") == "[", F.lit(True)).otherwise(F.raise_error(F.lit("evaluation cases are no list")).cast("boolean")))
    rows = listed.select(F.posexplode("rows").alias("ordinal", "row"))
    extra = F.concat(unknown_keys(F.col("row"), KEYS), F.coalesce(unknown_keys(F.get_json_object("row", "$.filters"), FILTER_FIELDS), F.array().cast("array<string>")))
    rows = require(rows, extra, "unknown keys of an evaluation case")
    cases = rows.select("ordinal", F.from_json("row", CASE).alias("c")).select("ordinal", "c.*")
    empty = F.array().cast("array<string>")
    cases = cases.withColumns({k: F.coalesce(F.col(k), empty) for k in ("expected_citation_document_ids", "must_include_terms", "must_not_include_terms")})
    return require(cases, case_violations(), "evaluation case")
