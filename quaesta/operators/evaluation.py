"""Retrieval and generation metrics. A ratio without a denominator is null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_evaluation, normalize_evaluation_all


def _or_null(df: DataFrame, **columns: str) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def retrieval_cases(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """Per case: recall of expected documents, first relevant rank over chunk hits, reciprocal rank, abstention, pass.

    ``cases``: ``case_id, expected_document_ids, expect_retrieval`` and ``question``; ``hits``: ``query_id`` (the case), ``document_id, rank``
    and ``chunk_id, section_title, score``, which the retrieved passages show. Columns that are absent are null.
    """
    hits = _or_null(hits, chunk_id="string", section_title="string", score="double")
    cases = _or_null(cases, question="string")
    got = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "document_id", "section_title", "score"))).alias("h"))
    j = cases.join(got, cases["case_id"] == got["query_id"], "left")
    h = F.coalesce("h", F.array().cast("array<struct<rank:int,chunk_id:string,document_id:string,section_title:string,score:double>>"))
    docs = F.transform(h, lambda x: x["document_id"])
    expected = F.array_distinct("expected_document_ids")
    first = F.array_min(F.transform(F.filter(h, lambda x: F.array_contains("expected_document_ids", x["document_id"])), lambda x: x["rank"]))
    answerable = F.col("expect_retrieval")
    recall = F.when(answerable, F.size(F.array_intersect(docs, expected)) / F.nullif(F.size(expected), F.lit(0)))
    out = j.select(
        "case_id", "question", h.alias("retrieved_passages"), answerable.alias("expect_retrieval"), F.when(answerable, F.array_sort(expected)).otherwise(F.array().cast("array<string>")).alias("expected_document_ids"),
        docs.alias("retrieved_document_ids"), (F.size(docs) > 0).alias("retrieval_sufficient"), recall.alias("recall_at_k"), F.when(answerable, first).alias("first_relevant_rank"),
        F.when(answerable, F.coalesce(1.0 / first, F.lit(0.0))).alias("reciprocal_rank"), F.when(~answerable, F.size(docs) == 0).alias("correct_abstention"),
    )
    return out.withColumn("passed", F.when(F.col("expect_retrieval"), F.coalesce(F.col("recall_at_k") > 0, F.lit(False))).otherwise(F.col("correct_abstention")))


def retrieval_metrics(case_rows: DataFrame) -> DataFrame:
    return case_rows.agg(
        F.count("*").alias("total_cases"), F.count_if("expect_retrieval").alias("answerable_cases"), F.count_if(~F.col("expect_retrieval")).alias("unanswerable_cases"),
        F.avg("recall_at_k").alias("macro_recall_at_k"), F.avg("reciprocal_rank").alias("mean_reciprocal_rank"), F.avg(F.col("correct_abstention").cast("int")).alias("correct_abstention_rate"),
    )


def generation_cases(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Per case: grounding, citation documents (each citation counted), terms missing or forbidden, pass.

    ``answers``: ``query_id`` (the case), ``response``, ``error``. A failed answer keeps its case in the denominators of
    grounding, has no citations, and fails its constraints if the case has any.
    """
    cases = _or_null(cases, question="string")
    j = cases.join(answers.select(F.col("query_id").alias("case_id"), "response", "error"), "case_id", "left")
    said = {f.name for f in answers.schema["response"].dataType.fields}
    field = lambda name: (F.col(f"response.{name}") if name in said else F.lit(None).cast("string")).alias(name)
    failed = F.col("response").isNull()
    docs = F.coalesce(F.transform("response.citations", lambda c: c["document_id"]), F.array().cast("array<string>"))
    j = j.withColumns({"docs": docs, "text": normalize_evaluation(F.col("response.answer")), "must": normalize_evaluation_all("must_include_terms"), "not": normalize_evaluation_all("must_not_include_terms")})

    def terms(raw: str, norm: str, present: bool):
        pairs = F.filter(F.arrays_zip(F.col(raw).alias("r"), F.col(norm).alias("n")), lambda p: F.col("text").contains(p["n"]) if present else ~F.col("text").contains(p["n"]))
        return F.when(failed, F.array().cast("array<string>")).otherwise(F.transform(pairs, lambda p: p["r"]))

    constrained = (F.size("must_include_terms") + F.size("must_not_include_terms")) > 0
    out = j.select(
        "case_id", "question", field("answer"), field("confidence"), field("insufficient_context_reason"), F.array_sort(F.array_distinct("expected_citation_document_ids")).alias("expected_citation_document_ids"),
        "must_include_terms", "must_not_include_terms", "expected_grounded", F.col("response.grounded").alias("actual_grounded"), F.col("docs").alias("citation_document_ids"), F.size("docs").alias("citation_count"),
        F.size(F.filter("docs", lambda d: F.array_contains("expected_citation_document_ids", d))).alias("expected_citations"), constrained.alias("has_constraints"),
        terms("must_include_terms", "must", False).alias("missing_required_terms"), terms("must_not_include_terms", "not", True).alias("present_forbidden_terms"),
        failed.alias("failed"), F.col("error").alias("generation_error"),
    )
    ok = ~F.col("failed") & (F.size("missing_required_terms") == 0) & (F.size("present_forbidden_terms") == 0)
    out = out.withColumn("grounding_matches_expectation", F.coalesce(F.col("actual_grounded") == F.col("expected_grounded"), F.lit(False))).withColumn("answer_constraints_passed", ok)
    return out.withColumn("passed", F.col("grounding_matches_expectation") & F.col("answer_constraints_passed"))


def generation_metrics(case_rows: DataFrame) -> DataFrame:
    g, a = F.col("expected_grounded"), F.coalesce(F.col("actual_grounded"), F.lit(False))
    both = F.count_if(g & a)
    neither = F.count_if(~g & ~F.coalesce(F.col("actual_grounded"), F.lit(True)))
    ratio = lambda x, n: x / F.nullif(n, F.lit(0))
    return case_rows.agg(
        F.count("*").alias("total_cases"), F.count_if("failed").alias("generation_errors"), ratio(both, F.count_if(g)).alias("grounded_answer_rate"),
        ratio(neither, F.count_if(~g)).alias("correct_grounded_abstention_rate"), ratio(F.sum("expected_citations"), F.sum("citation_count")).alias("citation_document_precision"),
        F.avg(F.when(F.col("has_constraints"), F.col("answer_constraints_passed").cast("int"))).alias("answer_constraint_pass_rate"), ratio(both + neither, F.count("*")).alias("overall_grounding_accuracy"),
    )
