"""URL aliases, chat format, WARC, decontamination, licences: brute force, round trips, edge cases."""

import hashlib
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from quaesta.llm import chat_format, decontam, license_digest, url_alias, warc_zstd


def test_url_verdicts_spread_over_aliases(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "https://a.org/x", link.format("https://b.org/y")), (2, "https://b.org/y", '<meta http-equiv="refresh" content="0; url=http://q.net/fr/1">'),
        (3, "http://q.net/fr/1#top", ""), (4, "https://c.org/", link.format("http://q.net/es/2")), (5, "https://d.org/", link.format("https://c.org/")),
        (6, "https://d.org/?q", link.format("https://z.com/ok") + link.format("https://c.org/")), (7, "https://e.org/", "<!-- " + link.format("http://q.net/es/2") + " -->"),
        (8, "http://WWW.Example.COM/en/1", ""), (9, "http://m.example.com/en/1", ""), (10, "http://xexample.com/en/", ""), (11, None, None), (12, "no scheme", link.format("http://q.net/es/2")),
        (13, "https://f.org", None), (14, "http://q.net/es/", ""), (14, "http://q.net/es/", ""), (15, "https://g.org/a/b", '<link href=../x rel=canonical>'),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("verdict", F.lit("mine")).withColumn("id", F.lit(0))
    got = {r["page_id"]: (r["rule"], r["verdict"], r["source"]) for r in url_alias.url_verdicts(df).collect()}
    assert got[1] == (None, "block", "alias") and got[2] == (None, "block", "alias") and got[3][:2] == ("net/fr/", "block")
    # one component: 4, 5 and 6 with a blocked and an allowed alias: the allow wins, the blocked page keeps its own rule
    assert got[4] == got[5] == got[6] == (None, "allow", "alias")
    assert got[7] == (None, "allow", "default") and got[8][:2] == ("www.example.com/en/", "allow") and got[9][:2] == ("example.com/en/", "block")
    assert got[10][:2] == ("com/", "allow") and got[11] == got[12] == got[13] == (None, "allow", "default") and got[14][1] == "block"
    assert url_alias.url_verdicts(df).count() == len(rows) and url_alias.url_verdicts(df.limit(0)).count() == 0
    edge = spark.createDataFrame([("https://f.org", "http://q.net/es/9"), (None, "x")], "src string, dst string")
    assert {r["page_id"]: r["verdict"] for r in url_alias.url_verdicts(df, redirects=edge).collect()}[13] == "block"


@pytest.mark.parametrize("ref,want", [("http://x/", "http://x/"), ("//h/p", "https://h/p"), ("/p", "https://s.t/p"), ("q", "https://s.t/a/q"), ("?z", "https://s.t/a/b?z")])
def test_links_are_resolved(spark, ref, want):
    assert spark.range(1).select(url_alias._resolve(F.lit("https://s.t/a/b?y"), F.lit(ref))).first()[0] == want


def test_chat_round_trip(spark):
    rng = random.Random(2)
    bits = ["\\", "#", "<", "###", " </turn>\n", "### assistant: ", ":", "\n", "\\b", "\\l", "\\h", "é😀", "x ", " ", "\\\\b"]
    rows, want = [], {}
    for c in range(60):
        turns = []
        for t in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "system", "a:b#", ""])
            turns.append((role, "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))))
            rows.append((c, t, *turns[-1]))
        want[c] = turns
    rows += [(None, 0, None, None), (99, None, "user", "late"), (99, 1, "assistant", None), (99, 1, "assistant", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = chat_format.format_conversations(df)
    got = {r["conv_id"]: r for r in out.select("*", chat_format.parse_turns(F.col("formatted")).alias("t"), chat_format.loss_text(F.col("segments")).alias("l")).collect()}
    for c, turns in want.items():
        assert [(t["role"], t["text"]) for t in got[c]["t"]] == turns
        assert got[c]["l"] == "".join(t for r, t in turns if r == "assistant")
    assert [tuple(t) for t in got[None]["t"]] == [("", "")] and [t["role"] for t in got[99]["t"]] == ["user", "assistant", "assistant"]
    assert not got[99]["valid"] and got[99]["end_state"] == "invalid"
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_chat_turn_order(spark):
    cases = {"su": True, "sua": True, "ua": True, "uaua": True, "s": False, "a": False, "uu": False, "usa": False, "us": False, "sau": False}
    name = {"s": "system", "u": "user", "a": "assistant"}
    rows = [(c, i, name[x], "t") for c in cases for i, x in enumerate(c)]
    got = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()
    assert {r["conv_id"]: r["valid"] for r in got} == cases


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc_zstd, "ARCHIVE_BYTES", 4000)
    rng = random.Random(4)
    same = "<p>" + "x" * 300
    rows = [(i, f"http://h/{i}\r\nEvil: 1", "<html>" + "".join(rng.choice("abc é\r\n") for _ in range(rng.randint(0, 900)))) for i in range(40)]
    rows += [(50, "u", same), (41, None, same), (60, "u", same), (60, "u", same), (None, "u", same), (70, "u", "tiny"), (71, "u", "tiny"), (72, "u", None), (73, "u", ""), (41, "again", same)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(3)).withColumn("d", F.lit(3))
    got = warc_zstd.archive_round_trip(df).collect()
    assert len(got) == len(rows)
    key = lambda r: tuple(map(str, r))
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = h == same and i != 41
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 41 if again else None))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert warc_zstd.archive_round_trip(df.limit(0)).count() == 0


def archive(records, dictionary=b"", squeeze=True):
    import struct

    body = zstandard.ZstdCompressor().compress(dictionary) if squeeze else dictionary
    lead = struct.pack("<II", warc_zstd.DICT_MAGIC, len(body)) + body if dictionary else b""
    c = warc_zstd._compressor(dictionary)
    return lead + b"".join(c.compress(r) for r in records)


def record(payload: bytes, digest=None):
    return warc_zstd.record_bytes(1, "http://x/", payload, digest or hashlib.sha256(payload).hexdigest(), "response", None)


def test_warc_archives_do_not_depend_on_the_order_rows_arrive_in(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc_zstd, "ARCHIVE_BYTES", 4000)
    # too few samples for a dictionary, which is fitted on the first rows
    rows = [(i, f"http://h/{i % 5}", "x" * (90 + 300 * (i % 4))) for i in range(14)]
    found = []
    for name, order in (("a", rows), ("b", rows[::-1])):
        warc_zstd.write_archives(spark.createDataFrame(order, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/{name}")
        found.append({f.name: f.read_bytes() for f in (tmp_path / name).glob("*.warc.zst")})
    assert found[0] == found[1] and len(found[0]) >= 1


def test_warc_reader_takes_dictionaries_and_rejects_damage():
    d = warc_zstd.train_dictionary([f"<html><body>page {i} of the same kind, number {i * 7}</body>".encode() * 3 for i in range(200)])
    payloads = [b"", b"a" * 300_000, bytes(range(256)) * 700]
    for dictionary in (b"", d):
        for squeeze in (True, False):
            assert [p for _, _, p in warc_zstd.read_archive(archive(map(record, payloads), dictionary, squeeze))] == payloads
    whole = archive([record(b"payload" * 50)])
    head, rest = record(b"x").split(b"\r\n\r\n", 1)
    said = head.rsplit(b" ", 1)[1]
    longer = head[: -len(said)] + str(int(said) + 1).encode() + b"\r\n\r\n" + rest
    for bad in (whole[:-3], whole[:20], b"junk" + whole, whole[:40] + b"\x00" + whole[41:], archive([record(b"x", "0" * 64)]), archive([record(b"x")[:-1]]), archive([b"HTTP/1.1 200"]),
                archive([record(b"x").replace(b"WARC-Date", b"WARC-Data")]), archive([longer])):
        with pytest.raises(warc_zstd.WarcError):
            list(warc_zstd.read_archive(bad))


def words(t):
    out, cur = [], ""
    for ch in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "") + " ":
        if ch.isascii() and not ch.isalnum():
            out, cur = (out + [cur] if cur else out), ""
        else:
            cur += ch
    return out


def decontam_brute(docs, items, slop):
    out = []
    for doc, text in docs:
        w, hit, exact, near = words(text), set(), set(), set()
        for item, t in items:
            q = words(t)
            for i in range(max(1, len(q) - 9)) if q else ():
                win = q[i : i + 10]
                for s in range(-slop, len(w) + slop):
                    if s >= 0 and w[s : s + len(win)] == win:
                        hit |= set(range(s, s + len(win)))
                        exact.add(str(item) if item is not None else "null")
                    if slop and all(any(0 <= p < len(w) and w[p] == x for p in range(s + k - slop, s + k + slop + 1)) for k, x in enumerate(win)):
                        near.add(str(item) if item is not None else "null")
        out.append((doc, len(w), len(hit), len(exact), hashlib.sha256(",".join(sorted(exact)).encode()).hexdigest(), bool(hit), len(near - exact)))
    return out


@pytest.mark.parametrize("pass_bytes", [32 << 20, 200])
def test_decontaminate_equals_brute_force(spark, monkeypatch, pass_bytes):
    monkeypatch.setattr(decontam, "PASS_BYTES", pass_bytes)
    monkeypatch.setattr(decontam, "SEGMENT_TOKENS", 150)
    rng = random.Random(9)
    vocab = ["the", "of", "é", "x1", "Über"] + [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([1, 4, 10, 12, 25]))) for i in range(12)] + [(3, text(11)), (None, text(10)), (90, None), (91, "..."), (10, "The, of; é!")]
    docs = []
    for i in range(40):
        t = text(rng.randint(0, 60))
        if i % 3 == 0:
            q = rng.choice(items[:12])[1].split()
            if i % 2:
                q.insert(len(q) // 2, "extra")
            t = f"{t} {'-'.join(q)} {text(5)}"
        docs.append((i, t))
    docs += [(100, None), (101, ""), (5, items[2][1]), (None, items[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", F.lit(0))
    got = decontam.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), slop=2).collect()
    assert sorted(map(tuple, got), key=str) == sorted(decontam_brute(docs, items, 2), key=str)


def test_decontaminate_edges(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontam.decontaminate(docs.limit(0), items).count() == 0
    assert [r["contaminated"] for r in decontam.decontaminate(docs, items.limit(0)).collect()] == [False]
    with pytest.raises(ValueError):
        decontam.find_matches(docs, items, slop=40)


def test_licences_match_in_any_spelling(spark):
    mit = dict(license_digest.KNOWN[:1])["MIT"]
    odd = "Copyright (c) 2020 Someone\nAll rights reserved.\r\n\r\n" + mit.upper().replace("SOFTWARE", "Software").replace("\n", "\r\n\r\n  * ").replace(",", " --") + "\n(C) 1999 Else"
    rows = [(1, mit), (2, odd), (3, mit + " More."), (4, "Text\n  released UNDER the MIT licence!\nmore"), (5, None), (6, ""), (7, "Copyright 2000 A"), (8, "released under the mit license"), (8, "released under the mit license"), (None, "a " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("license_id", F.lit(1))
    got = license_digest.scan_licenses(df).collect()
    by = {r["doc_id"]: (r["license_id"], r["line_licenses"]) for r in got}
    assert len(got) == len(rows)
    assert by[1][0] == by[2][0] == "MIT" and by[3][0] is None and by[4] == (None, ["MIT"]) and by[5] == by[6] == by[7] == by[None] == (None, []) and by[8] == ("MIT", ["MIT"])
    assert [r["digest"] for r in got if r["doc_id"] == 5] == [None] and license_digest.scan_licenses(df.limit(0)).count() == 0


def test_licence_texts_are_known_however_they_are_wrapped(spark):
    import textwrap

    rows, want = [], []
    for name, text in license_digest.KNOWN[:5]:
        for width in (*range(55, 100, 3), 10**6):
            wrapped = "\n".join(textwrap.fill(part, width, break_on_hyphens=True) for part in text.split("\n"))
            head = {"MIT": "MIT License", "ISC": "ISC License", "0BSD": "Zero-Clause BSD", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License"}[name]
            rows += [(len(rows), wrapped), (len(rows) + 1, f"{head}\n\nCopyright (c) 2020-2024 Some One <a@b.example>\nAll rights reserved.\n\n{wrapped}\n")]
            want += [name, name]
    rows += [(len(rows), "copyright holders said so\n(c) 2020 x\ncopyright 1999 y\n© z"), (len(rows) + 1, "copyright holders said so")]
    got = license_digest.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["license_id"] for r in got[:-2]] == want and got[-1]["digest"] == got[-2]["digest"] and got[-1]["license_id"] is None
