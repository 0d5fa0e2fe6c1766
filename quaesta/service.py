"""Services over an index: search, evidence, answers, evaluation; and the HTTP form of evidence."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import FILTER_FIELDS, MIN_RETRIEVAL_SCORE, TOP_K
from .operators import evaluation, generation
from .operators.embed import Embedder
from .operators.evidence import respond
from .operators.search import search
from .schema import query_violations, require
from .sources.index import ChunkIndex

QUERY = "query_id string, query string, top_k int, " + ", ".join(f"{f} string" for f in FILTER_FIELDS)


class SearchService:
    def __init__(self, spark: SparkSession, index: ChunkIndex, embedder: Embedder, min_score: float = MIN_RETRIEVAL_SCORE):
        self.spark, self.index, self.embedder, self.min_score = spark, index, embedder, min_score

    def query_rows(self, rows: list[dict]) -> DataFrame:
        known = [x.split()[0] for x in QUERY.split(", ")]
        if extra := {k for r in rows for k in r} - set(known):
            raise ValueError(f"unknown fields: {', '.join(sorted(extra))}")
        return self.spark.createDataFrame([tuple(r.get(k, TOP_K if k == "top_k" else None) for k in known) for r in rows], QUERY)

    def search(self, queries: DataFrame, most: int = 20) -> DataFrame:
        queries = require(queries, query_violations(most), "search query")
        index = self.index.read()
        if not index.isEmpty() and (size := len(index.select("embedding").first()[0])) != self.embedder.dimensions:
            raise ValueError(f"queries have {self.embedder.dimensions} dimensions, the index {size}")
        return search(queries.withColumn("embedding", self.embedder.queries(F.col("query"))), index, self.min_score)

    def answer(self, queries: DataFrame, client: generation.StructuredClient) -> DataFrame:
        hits = self.search(queries).cache()
        return generation.generate(queries, hits, client)

    def evaluate(self, cases: DataFrame, top_k: int = TOP_K, client: generation.StructuredClient | None = None) -> dict:
        queries = cases.select(F.col("case_id").alias("query_id"), F.col("question").alias("query"), F.lit(top_k).alias("top_k"), *(F.col(f"filters.{f}").alias(f) for f in FILTER_FIELDS))
        hits = self.search(queries).cache()
        rows = evaluation.retrieval_cases(cases, hits)
        report = {"evaluation_type": "document_level_retrieval", "top_k": top_k} | evaluation.retrieval_metrics(rows).first().asDict()
        report["case_results"] = [r.asDict(True) for r in rows.orderBy("case_id").collect()]
        if client is not None:
            rows = evaluation.generation_cases(cases, generation.generate(queries, hits, client)).cache()
            report["generation"] = evaluation.generation_metrics(rows).first().asDict() | {"case_results": [r.asDict(True) for r in rows.orderBy("case_id").collect()]}
        return report


class InvalidRequest(ValueError):
    """A request that breaks its model."""


def parse_request(body: dict) -> dict:
    if not isinstance(body, dict) or set(body) - {"request_id", "queries", "top_k", "filters"}:
        raise InvalidRequest("unknown or missing fields")
    out = {"request_id": body.get("request_id"), "queries": body.get("queries"), "top_k": body.get("top_k", 3), "filters": body.get("filters", {})}
    if not isinstance(out["request_id"], str) or not out["request_id"]:
        raise InvalidRequest("request_id is required")
    if not isinstance(out["queries"], list) or not 1 <= len(out["queries"]) <= 10:
        raise InvalidRequest("1 to 10 queries are required")
    if isinstance(out["top_k"], bool) or not isinstance(out["top_k"], int) or not 1 <= out["top_k"] <= 10:
        raise InvalidRequest("top_k lies between 1 and 10")
    if not isinstance(out["filters"], dict) or set(out["filters"]) - set(FILTER_FIELDS):
        raise InvalidRequest("unknown filter")
    if any(v is not None and not isinstance(v, str) for v in out["filters"].values()):
        raise InvalidRequest("a filter is text")
    for q in out["queries"]:
        known = isinstance(q, dict) and set(q) == {"supported_finding_id", "query"} and all(isinstance(v, str) for v in q.values())
        if not known or not q["supported_finding_id"] or len(q["query"]) < 3:
            raise InvalidRequest("a query has a finding id and at least 3 characters")
    return out


def retrieve_evidence(service: SearchService, body: dict) -> dict:
    """One request as the HTTP endpoint takes it; all its findings are searched in one plan."""
    r = parse_request(body)
    ids = [f"{i:02d}" for i in range(len(r["queries"]))]
    queries = service.query_rows([{"query_id": i, "query": q["query"], "top_k": r["top_k"], **r["filters"]} for i, q in zip(ids, r["queries"], strict=True)])
    findings = service.spark.createDataFrame(
        [(r["request_id"], k, q["supported_finding_id"], i) for k, (i, q) in enumerate(zip(ids, r["queries"], strict=True))], "request_id string, pos int, supported_finding_id string, query_id string"
    )
    out = respond(findings, service.search(queries, 10).cache(), service.index.name).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
    return json.loads(out.first()["j"])


def health() -> dict[str, str]:
    return {"service": "quaesta", "status": "ok"}


def handler(service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, body: dict) -> None:
            raw = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self):  # noqa: N802
            self._send(200, health()) if self.path == "/health" else self._send(404, {"detail": "Not Found"})

        def do_POST(self):  # noqa: N802
            if self.path != "/v1/retrieve-evidence":
                return self._send(404, {"detail": "Not Found"})
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
                self._send(200, retrieve_evidence(service, body))
            except (InvalidRequest, json.JSONDecodeError, UnicodeDecodeError) as e:
                self._send(422, {"detail": str(e)})
            except RuntimeError as e:  # a missing index is one
                self._send(503, {"detail": str(e)})

        def log_message(self, *args):
            pass

    return Handler


def serve(service: SearchService, port: int = 8001, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    return ThreadingHTTPServer((host, port), handler(service))
