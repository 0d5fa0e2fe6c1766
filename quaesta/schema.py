"""Schemas of the data model and the constraints on its rows, as columns.

A row's violations are an array of codes; strict callers raise on the first, batch
callers keep the rows and filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .config import CONFIDENCES, DOCUMENT_TYPES, LANGUAGES, STATUSES

METADATA = (
    "document_id string, title string, document_type string, coverage string, jurisdiction string, "
    "language string, version string, effective_date date, status string"
)
METADATA_KEYS = tuple(x.split()[0] for x in METADATA.split(", "))
CHUNK = (
    "chunk_id string, document_id string, document_name string, document_type string, coverage string, jurisdiction string, "
    "language string, version string, effective_date date, section_title string, section_path array<string>, "
    "page_start int, page_end int, chunk_index int, text string, content_hash string"
)
CHUNK_COLUMNS = tuple(x.split()[0] for x in CHUNK.split(", "))
HIT_COLUMNS = (
    "chunk_id", "document_id", "document_name", "section_title", "section_path", "page_start", "page_end",
    "text", "score", "rank", "language", "coverage", "jurisdiction", "version",
)
CITATION = (
    "struct<chunk_id:string,document_id:string,document_name:string,section_title:string,page_start:int,page_end:int,quote:string,retrieval_score:double>"
)
ANSWER = f"struct<answer:string,answer_language:string,grounded:boolean,confidence:string,citations:array<{CITATION}>,insufficient_context_reason:string>"
ANSWER_KEYS = ("answer", "answer_language", "grounded", "confidence", "citations", "insufficient_context_reason")
CITATION_KEYS = ("chunk_id", "document_id", "document_name", "section_title", "page_start", "page_end", "quote", "retrieval_score")
CASE = (
    "case_id string, question string, filters struct<coverage:string,jurisdiction:string,language:string,document_type:string,version:string>, "
    "expected_document_ids array<string>, expected_citation_document_ids array<string>, expect_retrieval boolean, expected_grounded boolean, "
    "must_include_terms array<string>, must_not_include_terms array<string>"
)


def violations(*checks: tuple[str, Column]) -> Column:
    """Codes of the checks that do not hold; a check that is null does not hold."""
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in checks)), lambda c: c.isNotNull())


def _long(c: str, least: int = 1) -> tuple[str, Column]:
    return f"{c}:too_short", F.length(c) >= least


def _one_of(c: str, values: tuple[str, ...]) -> tuple[str, Column]:
    return f"{c}:not_allowed", F.col(c).isin(*values)


def metadata_violations() -> Column:
    return violations(
        *(_long(c) for c in ("document_id", "title", "coverage", "jurisdiction", "version")),
        _one_of("document_type", DOCUMENT_TYPES), _one_of("language", LANGUAGES), _one_of("status", STATUSES), ("effective_date:missing", F.col("effective_date").isNotNull()),
    )


def chunk_violations() -> Column:
    page = lambda c: (f"{c}:below_one", F.col(c).isNull() | (F.col(c) >= 1))
    return violations(
        _long("chunk_id"), _long("document_id"), _long("text"), ("chunk_index:negative", F.col("chunk_index") >= 0),
        ("content_hash:length", F.length("content_hash") == 64), page("page_start"), page("page_end"),
    )


def query_violations(most: int = 20) -> Column:
    return violations(_long("query", 3), ("top_k:out_of_range", F.col("top_k").between(1, most)))


def case_violations() -> Column:
    return violations(_long("case_id"), _long("question", 3), ("expected_document_ids:missing", F.col("expected_document_ids").isNotNull()))


def answer_violations(a: str = "response") -> Column:
    """Field bounds, then the four rules between grounding, citations and reason."""
    r = F.col(a)
    cited = F.size(F.coalesce(r["citations"], F.array().cast(f"array<{CITATION}>"))) > 0
    reason = r["insufficient_context_reason"].isNotNull()
    return violations(
        ("answer:too_short", F.length(r["answer"]) >= 1), ("answer_language:not_allowed", r["answer_language"].isin(*LANGUAGES)), ("confidence:not_allowed", r["confidence"].isin(*CONFIDENCES)),
        ("quote:too_short", F.forall(F.coalesce(r["citations"], F.array().cast(f"array<{CITATION}>")), lambda c: F.length(c["quote"]) >= 1)),
        ("grounded_without_citations", ~r["grounded"] | cited), ("grounded_with_reason", ~r["grounded"] | ~reason),
        ("ungrounded_with_citations", r["grounded"] | ~cited), ("ungrounded_without_reason", r["grounded"] | reason),
    )


def unknown_keys(json: Column, allowed: tuple[str, ...]) -> Column:
    """Keys of a JSON object that its model does not have."""
    return F.array_except(F.json_object_keys(json), F.array(*map(F.lit, allowed)))


def require(df: DataFrame, bad: Column, what: str) -> DataFrame:
    """``df``, failing at run time on the first row with violations."""
    return df.where(F.when(F.size(bad) == 0, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), F.array_join(bad, ", "))).cast("boolean")))
