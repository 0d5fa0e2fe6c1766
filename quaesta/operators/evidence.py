"""Evidence for findings: citations, unresolved findings and a status for each request, all requests in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import KNOWLEDGE_BASE_VERSION

CITATIONS = "array<struct<citation_id:string,source_document_id:string,source_document_title:string,section_reference:string,excerpt:string,relevance_score:double,supported_finding_id:string>>"


def citations(findings: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per citation, with ``request_id, pos, rank``. ``findings``: ``request_id, pos, supported_finding_id, query_id``."""
    joined = findings.select("request_id", "pos", "supported_finding_id", F.col("query_id").cast("string")).join(hits, "query_id")
    return joined.select(
        "request_id", "pos", "rank", F.concat_ws(":", "supported_finding_id", "chunk_id").alias("citation_id"), F.col("document_id").alias("source_document_id"),
        F.col("document_name").alias("source_document_title"), F.col("section_title").alias("section_reference"), F.col("text").alias("excerpt"),
        F.col("score").alias("relevance_score"), "supported_finding_id",
    )


def unresolved(findings: DataFrame, hits: DataFrame) -> DataFrame:
    """Findings without a hit, by request and position."""
    return findings.join(hits.select("query_id").distinct(), "query_id", "left_anti").select("request_id", "pos", "supported_finding_id")


def respond(findings: DataFrame, hits: DataFrame, knowledge_base_version: str = KNOWLEDGE_BASE_VERSION) -> DataFrame:
    """One response per request; both lists go in request order, citations of a finding by rank."""
    findings = findings.withColumn("query_id", F.col("query_id").cast("string"))
    cited = citations(findings, hits)
    fields = [c for c in cited.columns if c not in ("request_id", "pos", "rank")]
    lists = cited.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("pos", "rank", *fields))).alias("c"))
    lists = lists.select("request_id", F.transform("c", lambda x: F.struct(*(x[f].alias(f) for f in fields))).cast(CITATIONS).alias("citations"))
    open_ = unresolved(findings, hits).groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("pos", "supported_finding_id"))).alias("u"))
    open_ = open_.select("request_id", F.transform("u", lambda x: x["supported_finding_id"]).alias("unresolved_finding_ids"))
    out = findings.select("request_id").distinct().join(lists, "request_id", "left").join(open_, "request_id", "left")
    status = F.when(F.col("citations").isNull(), "INSUFFICIENT_CONTEXT").when(F.col("unresolved_finding_ids").isNotNull(), "PARTIAL").otherwise("SUCCESS")
    return out.select(
        "request_id", status.alias("retrieval_status"), F.coalesce("citations", F.array().cast(CITATIONS)).alias("citations"),
        F.coalesce("unresolved_finding_ids", F.array().cast("array<string>")).alias("unresolved_finding_ids"), F.lit(knowledge_base_version).alias("knowledge_base_version"),
    )
