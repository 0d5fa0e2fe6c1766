"""The retrieval engine: text rules, ingestion, index, search, evidence, answers, metrics, service."""

import json
import random
import threading
import unicodedata
import urllib.error
import urllib.request
import uuid

import pytest
from pyspark.sql import functions as F

from quaesta import cli, service
from quaesta.functions import text as tx
from quaesta.functions.vectors import cosine, point_id
from quaesta.operators import chunking, evaluation, evidence, generation
from quaesta.operators.embed import HashingEmbedder
from quaesta.operators.ingest import ingest
from quaesta.operators.search import ranked_ids, results
from quaesta.sources.cases import read_cases
from quaesta.sources.index import ChunkIndex, IndexMissing
from quaesta.sources.markdown import parse_documents, read_documents

HEAD = '---\ndocument_id: {id}\ntitle: {title}\ndocument_type: procedure\ncoverage: {cov}\njurisdiction: canada\nlanguage: en\nversion: "1.0"\neffective_date: 2026-01-01\nstatus: active\n---\n'


def one(spark, c, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(c(F.col("x"))).collect()]


def test_white_space_is_pythons(spark):
    ws = [chr(i) for i in range(0x10000) if chr(i).isspace() and not 0xD800 <= i < 0xE000]
    assert len(ws) == 29
    assert one(spark, tx.normalize_whitespace, *(f" a{w}{w}b{w}" for w in ws)) == ["a b"] * 29
    assert one(spark, tx.normalize_whitespace, "a​b") == ["a​b"]


def test_normal_forms(spark):
    assert one(spark, tx.normalize_evaluation, "Five‑year cyber incident", "CAD 2,500", "Critères d'admissibilité", "Straße") == ["five year cyber incident", "cad 2 500", "criteres d admissibilite", "strasse"]
    a, b, c, d = one(spark, tx.normalize_citation, "Five‑year  “x” ﬁ…", 'Five-year "x" fi...', "Covered", "covered")
    assert a == b and c != d
    assert one(spark, tx.slugify, "  Critères d’éligibilité — 2. ", "Œuvre á") == ["criteres-d-eligibilite-2", "uvre"]
    assert one(spark, lambda c: tx.fixed_point(c.cast("double"), F.lit(3)), "0.0045", None) == ["0.004", None]


def test_point_ids_are_uuid5(spark):
    ids = ["a:b:000", "é" * 40, ""] + [f"x{i}" for i in range(300)]
    assert one(spark, point_id, *ids) == [str(uuid.uuid5(uuid.NAMESPACE_URL, i)) for i in ids]


def literal_split(text, most, overlap):
    """The packing rule word by word."""
    words, out, cur = text.split(" "), [], []
    if len(text) <= most:
        return [text]
    i = 0
    while i < len(words):
        if cur and len(" ".join([*cur, words[i]])) > most:
            out.append(cur)
            tail = []
            while len(tail) < len(cur) and len(" ".join([cur[-len(tail) - 1], *tail])) <= overlap:
                tail = [cur[-len(tail) - 1], *tail]
            cur = [] if len(tail) == len(cur) else tail
            if cur and len(" ".join([*cur, words[i]])) > most:
                out.append(cur)
                cur = []
            continue
        cur.append(words[i])
        i += 1
    return [" ".join(c) for c in [*out, cur]]


def test_chunks_hold_all_words_within_the_limit():
    rng = random.Random(1)
    for _ in range(3000):
        text = " ".join("x" * rng.randint(1, 9) for _ in range(rng.randint(1, 40)))
        most, overlap = rng.randint(3, 40), rng.randint(0, 12)
        got = chunking.split_words(text, most, overlap)
        assert all(len(c) <= most or " " not in c for c in got)
        if overlap == 0:
            assert " ".join(got) == text and got == literal_split(text, most, 0)
        assert got[0] == text[: len(got[0])] and text.endswith(got[-1])
    assert chunking.split_words("aa bb cc dd", 5, 2) == ["aa bb", "bb cc", "cc dd"]


def test_sections(spark):
    body = "lead\n# Policy\n\n## Deductible\nPay.\n### Deep\nx\n## Exclusions \nNone.\n####### seven\n#no\n```\n# code ##\ny\n"
    df = chunking.with_sections(spark.createDataFrame([(body,)], "b string"), F.col("b"), "s")
    got = [(s["title"], list(s["path"]), s["content"]) for s in df.first()["s"]]
    assert got == [("Deductible", ["Policy", "Deductible"], "Pay."), ("Deep", ["Policy", "Deductible", "Deep"], "x"), ("Exclusions", ["Policy", "Exclusions"], "None.\n####### seven\n#no\n```"), ("code ##", ["code ##"], "y")]


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    (folder / "a.md").write_text(HEAD.format(id="flood", title="Flood guide", cov="property") + "# Flood\n\n## Water damage\nSudden water damage is covered above the deductible.\n\n## Exclusions\nGradual leaks are not covered.\n", newline="\r\n")
    (folder / "b.md").write_text(HEAD.format(id="cyber", title="Cyber guide", cov="cyber") + "# Cyber\n\n## Referral\nMissing multi factor authentication needs a referral.\n" + "word " * 700)
    return folder


@pytest.fixture(scope="module")
def app(spark, corpus, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")
    index = ChunkIndex(spark, f"file://{out}/index", dimensions=256)
    emb = HashingEmbedder(256)
    with pytest.raises(IndexMissing):
        index.read()
    chunks = ingest(spark, f"file://{corpus}", f"file://{out}/chunks", index, emb)
    assert index.count() == chunks.count() == 5
    return service.SearchService(spark, index, emb, 0.1)


def test_ingest_writes_lines_and_upserts_by_id(spark, app, corpus, tmp_path):
    rows = {r["chunk_id"]: r for r in app.index.read().collect()}
    assert "flood:flood-water-damage:000" in rows and len(rows["flood:flood-water-damage:000"]["content_hash"]) == 64
    assert rows["flood:flood-water-damage:000"]["text"] == "Flood > Water damage Sudden water damage is covered above the deductible."
    assert [r["chunk_index"] for k, r in sorted(rows.items()) if k.startswith("cyber")] == [0, 1, 2]
    ingest(spark, f"file://{corpus}", f"file://{tmp_path}/c", app.index, app.embedder)
    assert app.index.count() == 5
    line = json.loads(next((tmp_path / "c").glob("*.json")).read_text().splitlines()[0])
    assert line["page_start"] is None and line["effective_date"] == "2026-01-01"
    with pytest.raises(Exception, match="has not 256"):
        app.index.upsert(app.index.read().drop("point_id").withColumn("embedding", F.array(F.lit(1.0))))


@pytest.mark.parametrize("text", ["no front matter", "---\n- a\n---\nx", HEAD.format(id="a", title="t", cov="c"), HEAD.format(id="a", title="t", cov="c").replace("status", "extra: 1\nstatus") + "# x\ny", HEAD.format(id="a", title="t", cov="c").replace('"1.0"', "1.0") + "# x\ny", "﻿" + HEAD.format(id="a", title="t", cov="c") + "x"])
def test_bad_documents_fail(spark, text):
    with pytest.raises(Exception):  # noqa: B017
        parse_documents(spark.createDataFrame([("p", text)], "source_path string, value string")).collect()


def test_empty_folder_and_sectionless_document_fail(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_documents(spark, f"file://{tmp_path}")
    docs = parse_documents(spark.createDataFrame([("p", HEAD.format(id="a", title="t", cov="c") + "no heading")], "source_path string, value string"))
    with pytest.raises(Exception, match="no Markdown section"):
        chunking.chunk_documents(docs).collect()


def test_search_filters_gates_and_ties(spark, app):
    rows = [{"query_id": "w", "query": "water damage deductible", "top_k": 2}, {"query_id": "f", "query": "water damage", "coverage": "cyber"}, {"query_id": "n", "query": "zzz qqq"}, {"query_id": "c", "query": "water damage", "coverage": "Property"}]
    q = app.query_rows(rows)
    hits = app.search(q).collect()
    assert [(h["query_id"], h["chunk_id"]) for h in hits if h["rank"] == 1 and h["query_id"] == "w"] == [("w", "flood:flood-water-damage:000")]
    assert all(h["coverage"] == "cyber" for h in hits if h["query_id"] == "f") and not [h for h in hits if h["query_id"] in "nc"]
    r = {x["query_id"]: x["retrieval_sufficient"] for x in results(q, app.search(q)).collect()}
    assert r["w"] and not r["n"] and not r["c"]
    ix = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("z", [0.0, 0.0]), ("m", None), ("c", [1.0, 1.0])], "chunk_id string, embedding array<double>")
    got = ranked_ids(spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>"), ix, 0.0, 2).orderBy("rank").collect()
    assert [(g["chunk_id"], g["score"]) for g in got] == [("a", 1.0), ("b", 1.0)]
    assert ix.where("chunk_id = 'z'").select(cosine(F.col("embedding"), F.col("embedding"))).first()[0] is None
    with pytest.raises(Exception, match="top_k"):
        app.search(app.query_rows([{"query_id": "x", "query": "abc", "top_k": 21}])).collect()


def test_evidence_statuses(spark):
    f = spark.createDataFrame([("s", 0, "a", "1"), ("p", 0, "d", "2"), ("p", 1, "d", "3"), ("i", 0, "x", "4")], "request_id string, pos int, supported_finding_id string, query_id string")
    hit = lambda q: (q, "c1", "doc", "Doc", "Sec", "text", 0.9, 1)
    h = spark.createDataFrame([hit("1"), hit("2")], "query_id string, chunk_id string, document_id string, document_name string, section_title string, text string, score double, rank int")
    got = {r["request_id"]: r for r in evidence.respond(f, h).collect()}
    assert [got[k]["retrieval_status"] for k in "spi"] == ["SUCCESS", "PARTIAL", "INSUFFICIENT_CONTEXT"]
    assert got["p"]["citations"][0]["citation_id"] == "d:c1" and got["p"]["unresolved_finding_ids"] == ["d"]


def citation(**over):
    return {"chunk_id": "flood:flood-water-damage:000", "document_id": "flood", "document_name": "Flood guide", "section_title": "Water damage", "page_start": None, "page_end": None, "quote": "Sudden water damage", "retrieval_score": 0.0} | over


def reply(*citations, **over):
    return {"answer": "Yes.", "answer_language": "en", "grounded": True, "confidence": "high", "citations": list(citations), "insufficient_context_reason": None} | over


@pytest.mark.parametrize(
    "response,error",
    [
        (reply(citation()), None), (reply(citation(quote="Sudden water  damage")), None), (reply(citation(chunk_id="invented")), "non-retrieved chunk"), (reply(citation(quote="sudden water")), "quote not verbatim"),
        (reply(citation(document_id="x")), "wrong document_id"), (reply(citation(document_name="x")), "wrong document_name"), (reply(citation(section_title="x")), "wrong section_title"),
        (reply(), "grounded_without_citations"), (reply(citation(), insufficient_context_reason="r"), "grounded_with_reason"), (reply(citation(), grounded=False, insufficient_context_reason="r"), "ungrounded_with_citations"),
        (reply(grounded=False), "ungrounded_without_reason"), (reply(grounded=False, insufficient_context_reason=""), None), (reply(citation(), extra=1), "unknown keys"), (reply(citation(), confidence="sure"), "confidence"),
    ],
)
def test_answers_are_checked(app, response, error):
    r = app.answer(app.query_rows([{"query_id": "w", "query": "water damage deductible"}]), generation.FixedClient(response)).first()
    assert (r["error"] is None) == (error is None) and (error is None or error in r["error"])
    if error is None and r["response"]["citations"]:
        assert r["response"]["citations"][0]["retrieval_score"] > 0.1


def test_refusal_needs_no_model(app):
    r = app.answer(app.query_rows([{"query_id": "n", "query": "zzz qqq"}]), generation.FixedClient({"bad": 1})).first()
    assert r["error"] is None and not r["response"]["grounded"] and r["response"]["answer"] == generation.REFUSAL


def test_metrics_without_denominators_are_null(spark):
    cases = spark.createDataFrame([("1", ["a"], True), ("2", ["a", "b", "b"], True)], "case_id string, expected_document_ids array<string>, expect_retrieval boolean")
    hits = spark.createDataFrame([("1", "x", 1), ("1", "a", 2), ("1", "a", 3), ("2", "b", 1)], "query_id string, document_id string, rank int")
    rows = evaluation.retrieval_cases(cases, hits)
    m = evaluation.retrieval_metrics(rows).first()
    assert (m["macro_recall_at_k"], m["mean_reciprocal_rank"], m["correct_abstention_rate"]) == (0.75, 0.75, None)
    m = evaluation.retrieval_metrics(rows.limit(0)).first()
    assert m["macro_recall_at_k"] is None and m["total_cases"] == 0


def test_generation_metrics(spark):
    case = "case_id string, expected_grounded boolean, expected_citation_document_ids array<string>, must_include_terms array<string>, must_not_include_terms array<string>"
    cases = spark.createDataFrame([("1", True, ["a"], ["CAD 5,000"], []), ("2", True, [], [], ["5 000"]), ("3", False, [], [], []), ("4", False, [], ["x"], [])], case)
    ans = "query_id string, response struct<answer:string,grounded:boolean,citations:array<struct<document_id:string>>>, error string"
    rows = [("1", ("pays cad 5 000", True, [("a",), ("a",), ("b",)]), None), ("2", ("15 000", True, []), None), ("3", ("no", False, []), None), ("4", None, "boom")]
    got = evaluation.generation_cases(cases, spark.createDataFrame(rows, ans))
    assert {r["case_id"]: r["passed"] for r in got.collect()} == {"1": True, "2": False, "3": True, "4": False}
    m = evaluation.generation_metrics(got).first()
    assert (m["generation_errors"], m["grounded_answer_rate"], m["correct_grounded_abstention_rate"], m["overall_grounding_accuracy"]) == (1, 1.0, 0.5, 0.75)
    assert abs(m["citation_document_precision"] - 2 / 3) < 1e-9 and abs(m["answer_constraint_pass_rate"] - 1 / 3) < 1e-9


def test_evaluate_and_commands(spark, app, tmp_path, capsys):
    path = tmp_path / "cases.json"
    case = {"case_id": "1", "question": "water damage deductible", "filters": {"coverage": "property"}, "expected_document_ids": ["flood"], "expect_retrieval": True, "expected_grounded": True}
    path.write_text(json.dumps([case, {**case, "case_id": "2", "question": "zzz qqq", "expect_retrieval": False, "expected_grounded": False}]))
    report = app.evaluate(read_cases(spark, f"file://{path}"), client=generation.FixedClient(reply(citation())))
    assert report["macro_recall_at_k"] == 1.0 and report["correct_abstention_rate"] == 1.0 and report["generation"]["overall_grounding_accuracy"] == 1.0
    for bad in ({"a": 1}, [{**case, "wrong": 1}]):
        path.write_text(json.dumps(bad))
        with pytest.raises(Exception):  # noqa: B017
            read_cases(spark, f"file://{path}").collect()
    assert cli.main(["version"]) == 0
    args = ["--index", app.index.root.rsplit("/", 1)[0], "--dimensions", "256", "--min-score", "0.1", "search", "-q"]
    assert cli.main([*args, "water damage"], spark) == 0 and "Markdown section" in capsys.readouterr().out
    assert cli.main([*args, "zzz qqq"], spark) == 1 and "(0.10)" in capsys.readouterr().out


def test_http(app):
    server = service.serve(app, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert json.load(urllib.request.urlopen(f"{url}/health"))["status"] == "ok"

    def post(body):
        try:
            return json.load(urllib.request.urlopen(urllib.request.Request(f"{url}/v1/retrieve-evidence", json.dumps(body).encode())))
        except urllib.error.HTTPError as e:
            return e.code

    body = {"request_id": "r", "queries": [{"supported_finding_id": "a", "query": "water damage"}, {"supported_finding_id": "b", "query": "zzz qqq"}], "filters": {"coverage": "property", "language": None}}
    out = post(body)
    assert out["retrieval_status"] == "PARTIAL" and out["unresolved_finding_ids"] == ["b"] and out["citations"][0]["citation_id"].startswith("a:flood")
    assert post({**body, "top_k": 11}) == post({**body, "queries": []}) == post({**body, "x": 1}) == 422
    server.shutdown()


def test_streaming_ingest(spark, corpus, tmp_path):
    from quaesta.streaming.ingest import stream_ingest

    index = ChunkIndex(spark, f"file://{tmp_path}/index", dimensions=64)
    stream_ingest(spark, f"file://{corpus}", index, HashingEmbedder(64), f"file://{tmp_path}/cp", available_now=True).awaitTermination(120)
    assert index.count() == 5


def test_sections_are_linear_in_headings():
    import time

    def took(n):
        body = "".join(f"{'#' * (1 + i % 6)} Heading {i}\nline {i}\n" for i in range(n))
        began = time.process_time()
        found = chunking.sections(body)
        assert len(found) == n and found[-1][1][-1] == f"Heading {n - 1}" and len(found[-1][1]) == 1 + (n - 1) % 6
        return time.process_time() - began

    took(800)
    assert took(80_000) < 40 * max(took(8000), 0.01)


def test_a_broken_write_leaves_the_index_as_it_was(spark, app, tmp_path):
    index = ChunkIndex(spark, f"file://{tmp_path}/index", dimensions=256)
    with pytest.raises(IndexMissing):
        index.read()
    index.ensure()
    chunks = app.index.read().drop("point_id")
    index.upsert(chunks)
    reader, n = index.read(), index.count()
    with pytest.raises(Exception, match="has not 256"):
        index.upsert(chunks.withColumn("embedding", F.array(F.lit(1.0))))
    # a version that was begun and never committed
    (tmp_path / "index" / index.name / "v-000000000099-dead").mkdir()
    assert index.exists() and index.count() == n
    index.ensure()
    index.upsert(chunks.limit(1))
    assert index.count() == n and reader.count() == n
    names = [p.name for p in (tmp_path / "index" / index.name).iterdir() if p.name.startswith("v-")]
    assert len(names) == 2 and all("dead" not in x for x in names)
    index.recreate()
    assert index.count() == 0


@pytest.mark.parametrize("change", [{"queries": [{"supported_finding_id": "a", "query": 5}]}, {"queries": [{"supported_finding_id": 7, "query": "abc"}]}, {"filters": {"coverage": 5}}, {"filters": []}, {"filters": None}, {"top_k": True}, {"request_id": ""}])
def test_requests_of_wrong_types_are_refused(change):
    good = {"request_id": "r", "queries": [{"supported_finding_id": "a", "query": "abc"}], "filters": {"coverage": None}}
    assert service.parse_request(good)["top_k"] == 3
    with pytest.raises(service.InvalidRequest):
        service.parse_request(good | change)


def test_reports_and_answers_are_shown():
    report = {"total_cases": 2, "macro_recall_at_k": 0.5, "mean_reciprocal_rank": None, "correct_abstention_rate": 1.0}
    assert cli.show_report(report, "r.json", 5).splitlines() == ["Evaluation report written to: r.json", "Cases evaluated: 2", "Macro Recall@5: 0.500", "MRR: N/A", "Correct abstention rate: 1.000"]
    g = {"grounded_answer_rate": 1.0, "correct_grounded_abstention_rate": None, "citation_document_precision": 0.25, "answer_constraint_pass_rate": None, "generation_errors": 1}
    assert "Citation document precision: 0.250" in cli.show_report({**report, "generation": g}, "r.json", 5) and "Generation errors: 1" in cli.show_report({**report, "generation": g}, "r.json", 5)
    shown = cli.show_answer(reply(citation(retrieval_score=0.5)))
    assert "[flood:flood-water-damage:000]" in shown and "Document: Flood guide" in shown and 'Supporting quote: "Sudden water damage"' in shown and "Retrieval score: 0.500" in shown
    args = cli.parser().parse_args(["--embedder", "model", "evaluate"])
    assert args.embedder == "model" and args.cases and args.output


def test_cases_tell_question_passages_and_answers(spark, app):
    cases = spark.createDataFrame([("1", "water damage deductible", ["flood"], True, True, ["flood"], ["sudden"], [])], "case_id string, question string, expected_document_ids array<string>, expect_retrieval boolean, expected_grounded boolean, expected_citation_document_ids array<string>, must_include_terms array<string>, must_not_include_terms array<string>")
    q = app.query_rows([{"query_id": "1", "query": "water damage deductible"}])
    row = evaluation.retrieval_cases(cases, app.search(q)).first()
    assert row["question"] == "water damage deductible" and row["retrieved_passages"][0].asDict().keys() == {"rank", "chunk_id", "document_id", "section_title", "score"}
    assert row["retrieved_passages"][0]["document_id"] == "flood"
    got = evaluation.generation_cases(cases, app.answer(q, generation.FixedClient(reply(citation())))).first()
    assert (got["question"], got["answer"], got["confidence"], got["insufficient_context_reason"], got["expected_citation_document_ids"], got["must_include_terms"]) == ("water damage deductible", "Yes.", "high", None, ["flood"], ["sudden"])


def test_normal_form_order():
    assert unicodedata.normalize("NFKC", "‑") == "‐"
