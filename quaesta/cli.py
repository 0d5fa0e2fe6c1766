"""Command line: version, ingest, search, ask, evaluate, serve."""

from __future__ import annotations

import argparse
import os
import sys

from . import __version__
from .config import FILTER_FIELDS, MIN_RETRIEVAL_SCORE, TOP_K, Settings


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quaesta")
    p.add_argument("--index", default="data/index")
    p.add_argument("--dimensions", type=int, default=768)
    p.add_argument("--embedder", choices=("model", "hashing"), default="hashing", help="a trained sentence model, or feature hashing for runs without one")
    p.add_argument("--model", default="intfloat/multilingual-e5-base")
    p.add_argument("--min-score", type=float, default=MIN_RETRIEVAL_SCORE)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    c = sub.add_parser("ingest")
    c.add_argument("--source-dir", default="data/raw")
    c.add_argument("--output-path", default="data/chunks")
    c.add_argument("--recreate", action="store_true")
    for name in ("search", "ask"):
        c = sub.add_parser(name)
        c.add_argument("-q", "--query", required=True)
        c.add_argument("--top-k", type=int, default=TOP_K, choices=range(1, 21), metavar="1..20")
        for f in FILTER_FIELDS:
            c.add_argument("--" + f.replace("_", "-"))
    c = sub.add_parser("evaluate")
    c.add_argument("--cases", default="data/cases.json")
    c.add_argument("--output", default="data/retrieval_evaluation_report.json")
    c.add_argument("--top-k", type=int, default=TOP_K)
    c.add_argument("--with-generation", action="store_true")
    c = sub.add_parser("serve")
    c.add_argument("--port", type=int, default=8001)
    return p


def label(x: float | None) -> str:
    return "N/A" if x is None else f"{x:.3f}"


def show_hit(h) -> str:
    place = f"pages {h['page_start']}-{h['page_end']}" if h["page_start"] is not None and h["page_end"] is not None else "Markdown section"
    return f"\n[{h['rank']}] Score: {h['score']:.3f}\nDocument: {h['document_name']}\nSection: {h['section_title']} ({place})\nChunk ID: {h['chunk_id']}\nText: {h['text']}\n"


def show_answer(r) -> str:
    lines = [f"\nAnswer:\n{r['answer']}", f"\nGrounded: {r['grounded']}", f"Confidence: {r['confidence']}"]
    if r["insufficient_context_reason"] is not None:
        lines.append(f"\nInsufficient context reason:\n{r['insufficient_context_reason']}")
    if r["citations"]:
        lines.append("\nCitations:")
    for c in r["citations"]:
        place = f"pages {c['page_start']}-{c['page_end']}" if c["page_start"] is not None and c["page_end"] is not None else "Markdown section"
        lines.append(f"\n- [{c['chunk_id']}]\n  Document: {c['document_name']}\n  Section: {c['section_title']} ({place})\n  Supporting quote: \"{c['quote']}\"")
        if c["retrieval_score"] is not None:
            lines.append(f"  Retrieval score: {c['retrieval_score']:.3f}")
    return "\n".join(lines)


def show_report(report: dict, path: str, top_k: int) -> str:
    lines = [f"Evaluation report written to: {path}", f"Cases evaluated: {report['total_cases']}"]
    lines += [f"Macro Recall@{top_k}: {label(report['macro_recall_at_k'])}", f"MRR: {label(report['mean_reciprocal_rank'])}", f"Correct abstention rate: {label(report['correct_abstention_rate'])}"]
    if g := report.get("generation"):
        names = {"grounded_answer_rate": "Grounded answer rate", "correct_grounded_abstention_rate": "Correct grounded abstention rate", "citation_document_precision": "Citation document precision", "answer_constraint_pass_rate": "Answer constraint pass rate"}
        lines += ["\nGeneration evaluation:", *(f"{name}: {label(g[k])}" for k, name in names.items()), f"Generation errors: {g['generation_errors']}"]
    return "\n".join(lines)


def client():
    from .operators.generation import HttpClient

    s = Settings.load()
    return HttpClient(os.environ.get("LLM_URL", "http://127.0.0.1:8000/v1/chat/completions"), s.llm_model_name, s.llm_api_key)


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    if a.command == "version":
        print(f"quaesta {__version__}")
        return 0
    from pyspark.sql import SparkSession

    from .operators.embed import HashingEmbedder, SentenceEmbedder
    from .service import SearchService, serve
    from .sources.index import ChunkIndex

    spark = spark or SparkSession.builder.appName("quaesta").getOrCreate()
    embedder = SentenceEmbedder(a.model, a.dimensions) if a.embedder == "model" else HashingEmbedder(a.dimensions)
    index = ChunkIndex(spark, a.index, dimensions=a.dimensions)
    service = SearchService(spark, index, embedder, a.min_score)
    if a.command == "ingest":
        from .operators.ingest import ingest

        n = ingest(spark, a.source_dir, a.output_path, index, embedder, a.recreate).count()
        print(f"Ingested and indexed {n} chunks into {a.output_path}")
    elif a.command == "serve":
        serve(service, a.port).serve_forever()
    elif a.command == "evaluate":
        from .sources.cases import read_cases
        from .sources.sinks import write_report

        report = service.evaluate(read_cases(spark, a.cases), a.top_k, client() if a.with_generation else None)
        write_report(report, a.output)
        print(show_report(report, a.output, a.top_k))
    else:
        asked = service.query_rows([{"query_id": "q", "query": a.query, "top_k": a.top_k, **{f: getattr(a, f) for f in FILTER_FIELDS}}])
        if a.command == "search":
            hits = service.search(asked).orderBy("rank").collect()
            if not hits:
                print(f"No passages met the minimum relevance threshold ({a.min_score:.2f}).")
                return 1
            for h in hits:
                print(show_hit(h))
        else:
            row = service.answer(asked, client()).first()
            if row["error"]:
                print(row["error"], file=sys.stderr)
                return 1
            print(show_answer(row["response"].asDict(True)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
