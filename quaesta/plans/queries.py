"""Registered queries of the engine over the test tables, and the SQL they are held against.

``embeddings`` plays the index (label: document), every vector whose id is divisible by 20 a query;
``documents`` the texts to chunk, hash and normalise; ``benchmark`` the quotes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import point_id
from ..operators import chunking, evaluation, evidence, generation
from ..operators.search import ranked_ids, results
from ..operators.search import search as search_hits
from ..schema import chunk_violations, metadata_violations
from ..sources.markdown import parse_documents

EVERY, GATE, K = 20, 0.35, 5


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _index(spark: SparkSession, d: str) -> DataFrame:
    label = F.concat(F.lit("doc"), F.col("label").cast("string"))
    return _t(spark, d, "embeddings").select(
        F.format_string("v%08d", "vec_id").alias("chunk_id"), "embedding", label.alias("document_id"), F.concat(F.lit("Document "), F.col("label").cast("string")).alias("document_name"),
        F.lit("Body").alias("section_title"), F.array(F.lit("Body")).alias("section_path"), F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"),
        F.concat(F.lit("Vector "), F.col("vec_id").cast("string")).alias("text"), F.lit("en").alias("language"), label.alias("coverage"), F.lit("canada").alias("jurisdiction"),
        F.lit("1.0").alias("version"), F.lit("procedure").alias("document_type"),
    )


def _queries(spark: SparkSession, d: str, filtered: bool = False) -> DataFrame:
    """Every vector whose id is divisible by 20, numbered ``n``; one passage more than wanted, as each finds itself."""
    q = _t(spark, d, "embeddings").where(f"vec_id % {EVERY} = 0").withColumn("n", F.expr(f"vec_id div {EVERY}"))
    label = F.concat(F.lit("doc"), F.col("label").cast("string"))
    return q.select(
        F.format_string("v%08d", "vec_id").alias("query_id"), "vec_id", "n", "embedding", label.alias("doc"), F.concat(F.lit("Question "), F.col("vec_id").cast("string")).alias("query"),
        *([label.alias("coverage")] if filtered else []), F.lit(K + 1).alias("top_k"),
    )


def _others(hits: DataFrame) -> DataFrame:
    """Hits without a query's own vector, ranked anew."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy("rank")
    return hits.where("query_id <> chunk_id").withColumn("rank", F.row_number().over(w)).where(f"rank <= {K}")


def _hits(spark: SparkSession, d: str, gate: float = GATE, filtered: bool = False) -> DataFrame:
    return _others(search_hits(_queries(spark, d, filtered), _index(spark, d), gate))


def vector_topk(spark, d):
    ids = _others(ranked_ids(_queries(spark, d), _index(spark, d), -1.0))
    return ids.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def vector_topk_filtered(spark, d):
    ids = _others(ranked_ids(_queries(spark, d, True), _index(spark, d), -1.0))
    return ids.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def relevance_gate(spark, d):
    return _hits(spark, d).select("query_id", "chunk_id", "document_id", F.round("score", 6).alias("score"), "rank")


def retrieval_sufficient(spark, d):
    r = results(_queries(spark, d), _hits(spark, d).select("query_id", "rank", "chunk_id"))
    return r.select("query_id", "retrieval_sufficient", F.size("results").cast("long").alias("n_results"))


def _findings(spark, d):
    return _queries(spark, d).select(
        F.concat(F.lit("r"), F.expr("n div 3").cast("string")).alias("request_id"), (F.col("n") % 3).cast("int").alias("pos"), F.concat(F.lit("f"), F.col("vec_id").cast("string")).alias("supported_finding_id"), "query_id"
    )


def evidence_status(spark, d):
    r = evidence.respond(_findings(spark, d), _hits(spark, d))
    return r.select("request_id", "retrieval_status", F.size("citations").cast("long").alias("n_citations"), F.array_join("unresolved_finding_ids", ",").alias("unresolved"), "knowledge_base_version")


def evidence_status_filtered(spark, d):
    r = evidence.respond(_findings(spark, d), _hits(spark, d, 0.30, True))
    return r.select("request_id", "retrieval_status", F.array_join(F.transform("citations", lambda c: c["citation_id"]), ",").alias("citation_ids"))


def evidence_citations(spark, d):
    c = evidence.citations(_findings(spark, d), _hits(spark, d))
    return c.select("request_id", "citation_id", "source_document_id", "source_document_title", "section_reference", "excerpt", F.round("relevance_score", 6).alias("relevance_score"), "supported_finding_id")


def unresolved_findings(spark, d):
    return evidence.unresolved(_findings(spark, d), _hits(spark, d)).select("request_id", "supported_finding_id")


def _cases(spark, d):
    return _queries(spark, d).select(F.col("query_id").alias("case_id"), F.array("doc").alias("expected_document_ids"), (F.col("n") % 5 != 4).alias("expect_retrieval"))


def eval_cases(spark, d):
    r = evaluation.retrieval_cases(_cases(spark, d), _hits(spark, d))
    return r.select("case_id", F.col("recall_at_k").cast("double").alias("recall_at_k"), F.col("first_relevant_rank").cast("long").alias("first_relevant_rank"), F.round(F.col("reciprocal_rank").cast("double"), 6).alias("reciprocal_rank"), "correct_abstention", "passed")


def eval_metrics(spark, d):
    m = evaluation.retrieval_metrics(evaluation.retrieval_cases(_cases(spark, d), _hits(spark, d)))
    return m.select("total_cases", "answerable_cases", "unanswerable_cases", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in ("macro_recall_at_k", "mean_reciprocal_rank", "correct_abstention_rate")))


def _docs(spark, d):
    return _t(spark, d, "documents").select("doc_id", "text")


def chunk_text(spark, d):
    parts = chunking.splitter(1600, 200)(tx.normalize_whitespace(F.col("text")))
    c = _docs(spark, d).select("doc_id", F.posexplode(parts).alias("part", "chunk"))
    return c.select("doc_id", F.col("part").cast("long").alias("part"), F.length("chunk").cast("long").alias("n_chars"), F.sha2("chunk", 256).alias("chunk_sha256"))


def content_hashes(spark, d):
    return _docs(spark, d).select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"))


def dedup_by_hash(spark, d):
    return content_hashes(spark, d).groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def slugify_titles(spark, d):
    first = F.element_at(F.split("text", "\n"), 1)
    return _docs(spark, d).select("doc_id", tx.slugify(first).alias("slug"))


def chunk_ids(spark, d):
    slug = tx.slugify(F.element_at(F.split("text", "\n"), 1))
    return _docs(spark, d).select("doc_id", F.concat_ws(":", F.concat(F.lit("doc"), F.col("doc_id").cast("string")), slug, F.format_string("%03d", F.col("doc_id"))).alias("chunk_id"))


def point_ids(spark, d):
    return chunk_ids(spark, d).select("doc_id", point_id(F.col("chunk_id")).alias("point_id"))


def section_parse(spark, d):
    """Documents with a heading before every third line, of levels 1 to 3 in turn."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 0, F.concat(F.repeat(F.lit("#"), (F.expr("1") + F.floor(i / 3) % 3).cast("int")), F.lit(" H"), (i / 3).cast("int").cast("string"), F.lit("\n"), x)).otherwise(x))
    s = chunking.with_sections(_docs(spark, d), F.array_join(lines, "\n"), "all").select("doc_id", F.posexplode("all").alias("ord", "s"))
    return s.select("doc_id", F.col("s.title").alias("title"), F.array_join("s.path", " > ").alias("path"), F.sha2(tx.normalize_whitespace(F.col("s.content")), 256).alias("content_sha256"))


def citation_normalize(spark, d):
    odd = F.replace(F.replace(F.col("text"), F.lit(" the "), F.lit("\u00a0the ")), F.lit("th"), F.lit("t\u2011h"))
    return _docs(spark, d).select("doc_id", F.sha2(tx.normalize_citation(odd), 256).alias("normalized_sha256"))


def citation_verify(spark, d):
    """Benchmark texts as quotes of the documents that hold them and of the next one; the quotes with other spaces and hyphens."""
    items = _t(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"))
    docs = _docs(spark, d)
    pairs = _holding(docs, items)
    cites = pairs.unionByName(pairs.select((F.col("doc_id") + 1).alias("doc_id"), "item_id")).distinct()
    cites = cites.join(items, "item_id").join(docs, "doc_id")
    quote = F.replace(F.col("quote"), F.lit(" the "), F.lit("\u00a0the "))
    key = F.concat_ws(":", "doc_id", "item_id")
    one = F.struct(
        F.col("doc_id").cast("string").alias("chunk_id"), F.lit("d").alias("document_id"), F.lit("D").alias("document_name"), F.lit("S").alias("section_title"),
        F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"), quote.alias("quote"), F.lit(0.0).alias("retrieval_score"),
    )
    answers = cites.select(key.alias("query_id"), F.struct(F.array(one).alias("citations")).alias("response"))
    # every seventh document was not retrieved, every fifth has another name
    hits = cites.where("doc_id % 7 <> 0").select(
        key.alias("query_id"), F.col("doc_id").cast("string").alias("chunk_id"), F.lit("d").alias("document_id"), F.when(F.col("doc_id") % 5 == 0, "E").otherwise("D").alias("document_name"),
        F.lit("S").alias("section_title"), "text", F.lit(0.5).alias("score"), F.lit(1).alias("rank"),
    )
    return generation.verify_citations(answers, hits).select("query_id", "failure")


def _holding(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id`` where a document's text contains a quote: looked up by the quote's longest word between two spaces, then compared.

    Such a word stands between two spaces in every text that holds the quote. A quote without one is compared with each text.
    """
    inner = F.filter(F.slice(F.split("quote", " "), 2, F.greatest(F.size(F.split("quote", " ")) - 2, F.lit(0))), lambda w: w != "")
    named = items.withColumn("word", F.get(F.reverse(F.array_sort(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))), F.lit(0))["w"])
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    found = words.join(named.where("word is not null").select("word", "item_id"), "word").select("doc_id", "item_id")
    found = found.join(items, "item_id").join(docs, "doc_id").where(F.col("text").contains(F.col("quote"))).select("doc_id", "item_id")
    short = docs.join(named.where("word is null"), F.col("text").contains(F.col("quote"))).select("doc_id", "item_id")
    return found.unionByName(short)


def eval_text_normalize(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(tx.normalize_evaluation(F.col("text")), 256).alias("normalized_sha256"))


def term_constraints(spark, d):
    """Documents as answers that must hold one term and must not hold another, with two citations each; every tenth failed."""
    docs = _docs(spark, d)
    terms = lambda *ts: F.array(*map(F.lit, ts))
    cases = docs.select(
        F.col("doc_id").cast("string").alias("case_id"), (F.col("doc_id") % 3 != 0).alias("expected_grounded"), terms("d0", "d1").alias("expected_citation_document_ids"),
        terms("The of", "in").alias("must_include_terms"), terms("de la", "Straße").alias("must_not_include_terms"),
    )
    cited = F.array(*(F.struct(F.concat(F.lit("d"), (F.col("doc_id") % k).cast("string")).alias("document_id")) for k in (4, 6)))
    response = F.struct(F.col("text").alias("answer"), (F.col("doc_id") % 4 != 0).alias("grounded"), cited.alias("citations"))
    failed = F.col("doc_id") % 10 == 0
    answers = docs.select(F.col("doc_id").cast("string").alias("query_id"), F.when(~failed, response).alias("response"), F.when(failed, "failed").alias("error"))
    return evaluation.generation_cases(cases, answers)


def term_constraint_cases(spark, d):
    c = term_constraints(spark, d)
    return c.select("case_id", F.array_join("missing_required_terms", ",").alias("missing"), F.array_join("present_forbidden_terms", ",").alias("forbidden"), "answer_constraints_passed", "grounding_matches_expectation", "passed")


def generation_metrics(spark, d):
    m = evaluation.generation_metrics(term_constraints(spark, d))
    return m.select("total_cases", "generation_errors", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in ("grounded_answer_rate", "correct_grounded_abstention_rate", "citation_document_precision", "answer_constraint_pass_rate", "overall_grounding_accuracy")))


def prompt_build(spark, d):
    p = generation.prompts(_queries(spark, d), _hits(spark, d))
    return p.select("query_id", F.length("prompt").cast("long").alias("n_chars"), F.sha2("prompt", 256).alias("prompt_sha256"))


def eval_passages(spark, d):
    r = evaluation.retrieval_cases(_cases(spark, d).withColumn("question", F.concat(F.lit("Question "), "case_id")), _hits(spark, d))
    p = r.select("case_id", "question", F.array_join("expected_document_ids", ",").alias("expected"), F.inline("retrieved_passages"))
    return p.select("case_id", "question", "expected", "rank", "chunk_id", "document_id", "section_title", F.round("score", 6).alias("score"))


def ingest_chunks(spark, d):
    """Documents as Markdown files with front matter: parsed, checked and chunked by section."""
    number = F.col("doc_id").cast("string")
    head = F.format_string('---\ndocument_id: d%s\ntitle: Doc %s\ndocument_type: procedure\ncoverage: cyber\njurisdiction: canada\nlanguage: en\nversion: "1.0"\neffective_date: 2026-01-01\nstatus: active\n---\n', number, number)
    body = F.concat(F.lit("lead\n\n# Doc "), number, F.lit("\n\n## Part\nText. "), F.coalesce("text", F.lit("")), F.lit("\n\n### End\n\nDone."))
    files = _docs(spark, d).select(number.alias("source_path"), F.concat(head, body).alias("value"))
    c = chunking.chunk_documents(parse_documents(files), 1 << 30, 0)
    return c.select("chunk_id", "document_id", "document_name", F.col("effective_date").cast("string").alias("effective_date"), F.array_join("section_path", " > ").alias("path"), F.col("chunk_index").cast("long").alias("chunk_index"), F.length("text").cast("long").alias("n_chars"), "content_hash")


def metadata_checks(spark, d):
    """Violations of metadata made from the documents' columns."""
    m = _t(spark, d, "documents").select(
        "doc_id", F.lit("d").alias("document_id"), F.when(F.col("doc_id") % 3 != 0, "t").otherwise("").alias("title"), F.when(F.col("doc_id") % 5 != 0, "procedure").otherwise("poem").alias("document_type"),
        "source", F.col("source").alias("coverage"), F.when(F.col("doc_id") % 7 != 0, "canada").alias("jurisdiction"), F.col("lang").alias("language"), F.lit("1").alias("version"),
        F.when(F.col("doc_id") % 11 != 0, F.to_date(F.lit("2026-01-01"))).alias("effective_date"), F.lit("active").alias("status"),
    )
    return m.select("doc_id", F.array_join(metadata_violations(), ",").alias("violations"))


def chunk_checks(spark, d):
    """Violations of chunks made from the documents' columns."""
    c = _docs(spark, d).select(
        "doc_id", F.when(F.col("doc_id") % 3 != 0, "c").otherwise("").alias("chunk_id"), F.lit("d").alias("document_id"), F.substring("text", 1, (F.col("doc_id") % 2).cast("int")).alias("text"),
        (F.col("doc_id") % 5 - 1).alias("chunk_index"), F.sha2("text", 256).alias("content_hash"), (F.col("doc_id") % 4).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"),
    )
    return c.select("doc_id", F.array_join(chunk_violations(), ",").alias("violations"))


def excerpts_and_places(spark, d):
    """Excerpts of the documents and labels of their places."""
    start = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 9 + 1)
    return _docs(spark, d).select("doc_id", F.sha2(tx.excerpt(F.col("text")), 256).alias("excerpt_sha256"), tx.location_label(start, start + 1).alias("place"), tx.metric_label(F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") / 8.0)).alias("label"))


def metadata_facets(spark, d):
    return _index(spark, d).groupBy("document_id").agg(F.count("*").alias("n"))


def exact_count(spark, d):
    return _index(spark, d).agg(F.count("*").alias("n"))


_ALL = (
    vector_topk, vector_topk_filtered, relevance_gate, retrieval_sufficient, evidence_status, evidence_status_filtered, evidence_citations, unresolved_findings, eval_cases, eval_metrics,
    chunk_text, content_hashes, dedup_by_hash, slugify_titles, chunk_ids, point_ids, section_parse, citation_normalize, citation_verify, eval_text_normalize, term_constraint_cases,
    generation_metrics, eval_passages, ingest_chunks, metadata_checks, chunk_checks, excerpts_and_places, prompt_build, metadata_facets, exact_count,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
