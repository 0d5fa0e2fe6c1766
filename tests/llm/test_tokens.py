"""Token cache, packing, ordering, language ID and the pipeline."""

import random
import sys
import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from quaesta.llm import bm25_pack, feistel_order, langid, tokens
from quaesta.llm.common import table

SF = "/root/testdata/sf0.001"
ODD = ["", "  ", "Café ÉLAN naïve. Straße, İstanbul ǅ don't it's 'S we'll,'re ...?!.. a.b 12,5 ½", "\x1c\x1d a\x85b c d　e", "été 日本語. ΣΑΣ ς", "<|endoftext|> <|ENDOFTEXT|>x", "ﬁ Ⅷ ạ̈", "a" * 300 + "."]


def test_cached_pieces_equal_the_tokenizer(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_PIECES", 20)
    tok = tokens.WordTokenizer(tokens.default_vocabulary())
    for text in ODD * 2:
        assert np.frombuffer(tok.encode([text])[0], "<u2").tolist() == tok.tok.encode(text, add_special_tokens=False).ids
    assert tok.encode([None]) == [b""]


def check_pieces(rows, pieces, window=bm25_pack.WINDOW):
    tok = tokens.load(tokens.default_vocabulary()).tok
    want = sorted((d, tuple(tok.encode(t or "", add_special_tokens=False).ids + [1])) for d, t in rows)
    by_seq, got = {}, {}
    for p in pieces:
        by_seq.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        got.setdefault(p["doc_id"], []).append((p["start"], list(np.frombuffer(bytes(p["ids"]), "<u4")), p["doc_tokens"]))
        assert len(p["ids"]) == 4 * p["length"]
    padding = 0
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0
    for d, ids in want:
        if sum(x[0] == d for x in want) == 1:
            whole = [t for _, ids_, _ in sorted(got[d]) for t in ids_]
            assert tuple(whole) == ids and all(n == len(ids) for *_, n in got[d])
            assert [s for s, *_ in sorted(got[d])] == np.cumsum([0, *(len(i) for _, i, _ in sorted(got[d]))]).tolist()[:-1]
    assert sum(len(i) for v in got.values() for _, i, _ in v) == sum(len(i) for _, i in want)


def test_packing_keeps_every_id(spark):
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "éa"]) for _ in range(rng.choice([0, 3, 200, 900, 5000])))) for i in range(80)]
    rows += [(100, None), (101, ""), (7000, "x y z"), (7000, "x y z"), (7001, "<|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).repartition(3)
    check_pieces(rows, bm25_pack.pack_documents(df).collect())
    assert bm25_pack.pack_documents(df.limit(0)).count() == 0
    assert bm25_pack.pack_documents(df.where("doc_id = 100")).count() == 1


def test_packing_prefers_like_documents():
    a, b = [np.array([10 * k + j for j in range(10)] * 50, "<u2") for k in (1, 5)]
    docs = [a, b, a.copy(), b.copy()]
    df = np.zeros(100)
    for d in docs:
        df[np.unique(d)] += 1
    rows = list(bm25_pack.pack(docs, np.log1p((4 - df + 0.5) / (df + 0.5)).astype(np.float32), 500, 1000))
    assert [d for s, d, *_ in rows if s == 0] == [0, 2] and [d for s, d, *_ in rows if s == 1] == [1, 3]


def bm25_brute(docs, seed, idf, mean):
    """Score of each document for all distinct terms of the seed."""
    k1, b, scores = bm25_pack.K1, bm25_pack.B, []
    for d in docs:
        tf = {t: int((d == t).sum()) for t in set(docs[seed].tolist())}
        scores.append(sum(float(idf[t]) * n * (k1 + 1) / (n + k1 * (1 - b + b * len(d) / mean)) for t, n in tf.items() if n))
    return np.array(scores)


def test_neighbours_are_scored_by_all_terms_of_the_seed():
    rng = np.random.default_rng(5)
    docs = [(rng.random(rng.integers(60, 120)) ** 2 * 200).astype("<u2") for _ in range(60)]
    df = np.zeros(200)
    for d in docs:
        df[np.unique(d)] += 1
    idf, mean = np.log1p((60 - df + 0.5) / (df + 0.5)).astype(np.float32), float(np.mean([len(d) for d in docs]))
    index = bm25_pack.Shard(docs, idf, mean)
    for seed in range(60):
        assert len(np.unique(docs[seed])) > 12
        np.testing.assert_allclose(index.scores(seed), bm25_brute(docs, seed, idf, mean), rtol=1e-4)
    # each sequence is filled by the best documents unused at its turn
    rest, seen = np.array([len(d) for d in docs]), {}
    for seq, d, start, length, offset in bm25_pack.pack(docs, idf, mean, 500):
        seen.setdefault(seq, []).append((offset, d, start, length))
    for seq in sorted(seen):
        parts = sorted(seen[seq])
        score = bm25_brute(docs, parts[0][1], idf, mean)
        rest[parts[0][1]] -= parts[0][3]
        if sum(x[3] for x in parts) == 500:
            for _, d, _, length in parts[1:]:
                assert score[d] >= score[rest > 0].max() - 1e-3
                left = rest[d] - length
                rest[d], score[d] = 0, 0
                if left:
                    rest[d] = left


def test_packing_brings_near_copies_of_other_partitions_together(spark, monkeypatch):
    """Rows are dealt to shards by content: near copies far apart share a sequence (a shard of a few documents may end between two copies)."""
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    texts = [" ".join(rng.choice(vocab[20 * k : 20 * k + 20]) for _ in range(150)) for k in range(20)]
    df = spark.createDataFrame([(i, texts[i % 20]) for i in range(40)], "doc_id long, text string").repartitionByRange(5, "doc_id")
    window = len(tokens.load(tokens.default_vocabulary()).encode([texts[0]])[0])  # two texts: an id has two bytes
    for shard_tokens in (6000, 1_000_000):
        monkeypatch.setattr(bm25_pack, "SHARD_TOKENS", shard_tokens)
        rows = bm25_pack.pack_documents(df, window=window).collect()
        check_pieces([(i, texts[i % 20]) for i in range(40)], rows, window)
        seqs = {}
        for r in rows:
            seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["doc_id"], r["start"]))
        pairs = [v for v in map(sorted, seqs.values()) if len(v) > 1 and v[0][2] == v[1][2] == 0]
        assert len(pairs) >= 5 and sum(v[0][1] % 20 == v[1][1] % 20 for v in pairs) >= 0.8 * len(pairs)


def test_a_hot_range_is_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(bm25_pack, "PART_TOKENS", 400)
    rows = [(i, "the same text of nine words for all rows") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("x"))
    docs = df.select("doc_id", "text")
    held, _, n, total = bm25_pack.tokenised(docs, tokens.default_vocabulary(), 1)
    parts = bm25_pack.dealt(held, total).groupBy("part").count().collect()
    assert n == 200 and len(parts) >= total // 400 - 1 and max(r["count"] for r in parts) < 200 / len(parts) * 2.5
    check_pieces(rows, bm25_pack.pack_documents(df).collect())


def test_words_merge_as_the_tokenizer_merges_them():
    from quaesta.llm import bpe

    tok = tokens.load(tokens.default_vocabulary()).tok
    rng = random.Random(4)
    letters = "".join(chr(c) for c in range(97, 123)) + "aeiouéüñ"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(3000)] + ["a" * 500, "the", "é"]
    got = bpe.Merger(tok, tokens._byte_letters()).encode([w.encode() for w in words])
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [tok.encode(w, add_special_tokens=False).ids for w in words]


def test_feistel_is_a_keyed_permutation():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        x = feistel_order.permute(np.arange(n), n, 7)
        assert sorted(x.tolist()) == list(range(n))
    assert (feistel_order.permute(np.arange(1000), 1000, 7) != feistel_order.permute(np.arange(1000), 1000, 8)).any()


def test_shards_hold_every_sequence_at_its_slot(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(1, None), (1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("number", F.lit(0)).coalesce(2)
    folder = f"file://{tmp_path}/order"
    m = feistel_order.write_order(df, folder, 11, seq_len=16, per_shard=7)
    out = list(feistel_order.read_slots(folder, 0, 10**9))
    n = m["sequences"]
    assert [s for s, *_ in out] == list(range(n)) and sorted(x for _, x, *_ in out) == list(range(n))
    assert [s for s, *_ in out] == [int(feistel_order.permute(np.array([x]), n, 11)[0]) for _, x, *_ in out]
    tok = tokens.load(tokens.default_vocabulary()).tok
    want = sorted(t for _, x in rows for t in tok.encode(x or "", add_special_tokens=False).ids + [feistel_order.PAD_ID])
    assert sorted(t for *_, k, ids in out for t in ids[:k].tolist()) == want
    assert [x[:3] for x in feistel_order.read_slots(folder, 9, 4)] == [x[:3] for x in out[9:13]]
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "order").glob("*.bin")}
    lost = sorted(before)[1]
    lost.unlink()
    feistel_order.write_order(df, folder, 11, seq_len=16, per_shard=7)
    assert [x[:3] for x in feistel_order.read_slots(folder, 0, 10**9)] == [x[:3] for x in out]
    assert all(p.stat().st_mtime_ns == t for p, t in before.items() if p != lost)
    rows = feistel_order.order_rows(spark, folder, m).collect()
    assert sorted(r["slot"] for r in rows) == list(range(n)) and all(r["byte_offset"] == r["slot"] % 7 * m["stride"] for r in rows)
    assert {r["slot"]: r["ids_crc32"] for r in rows} == {s: zlib.crc32(ids.tobytes()) for s, _, _, ids in out}
    damaged = sorted(before)[0]
    raw = bytearray(damaged.read_bytes())
    raw[-1] ^= 1
    damaged.write_bytes(raw)
    feistel_order.write_order(df, folder, 11, seq_len=16, per_shard=7)
    assert [x[:3] for x in feistel_order.read_slots(folder, 0, 10**9)] == [x[:3] for x in out]
    assert feistel_order.materialised_order(df.limit(0), 1).count() == 0


def test_shards_of_another_key_or_corpus_are_never_kept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feistel_order, "MAX_WRITERS", 3)
    folder, other = f"file://{tmp_path}/order", f"file://{tmp_path}/other"
    corpora = [spark.createDataFrame([(f"{w} " * (i % 9), ) for i in range(60)], "text string").coalesce(2) for w in ("one", "two")]
    for docs, key in ((corpora[0], 11), (corpora[0], 12), (corpora[1], 12), (corpora[1], 11)):
        m = feistel_order.write_order(docs, folder, key, seq_len=16, per_shard=7)
        feistel_order.write_order(docs, other + f"{key}", key, seq_len=16, per_shard=7)
        got, want = ([(s, n, t, ids.tolist()) for s, n, t, ids in feistel_order.read_slots(x, 0, 10**9)] for x in (folder, other + f"{key}"))
        assert got == want and len(got) == m["sequences"]
        assert [s for s, *_ in got] == [int(feistel_order.permute(np.array([n]), m["sequences"], key)[0]) for _, n, *_ in got]
        assert len(list((tmp_path / "order").glob("shard-*"))) == -(-m["sequences"] // 7)


def test_language_of_held_out_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    train, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    model = langid.train(train, "text", "lang")
    out = langid.identify(test, model, F.col("text")).select("lang", "pred_lang", "accepted").collect()
    assert np.mean([r["lang"] == r["pred_lang"] for r in out]) > 0.97 and np.mean([r["accepted"] for r in out]) > 0.99


def test_language_evidence_is_fused(spark):
    model = langid.train(table(spark, SF, "documents"), "text", "lang")
    rows = [("x1", "de", "a.de"), ("x2", "fr-CA", "b.example.fr"), ("x3", None, None), ("...", "de", "a.de"), (None, "de", "a.de"), ("", "de", None), ("x4", "xx", "h.example.es"), ("x4", "xx", "h.example.es")]
    df = spark.createDataFrame(rows, "t string, d string, h string").withColumn("posterior", F.lit("clash")).withColumn("n", F.lit(1))
    got = langid.identify(df, model, F.col("t"), F.col("d"), F.col("h")).collect()
    by = {(r["t"], r["d"]): r for r in got}
    assert len(got) == len(rows) and by["x1", "de"]["pred_lang"] == "de" and by["x2", "fr-CA"]["pred_lang"] == "fr" and by["x4", "xx"]["pred_lang"] == "es"
    assert all(by[k]["pred_lang"] is None and not by[k]["accepted"] for k in (("...", "de"), (None, "de"), ("", "de")))
    assert langid.identify(df.limit(0), model, F.col("t"), F.col("d"), F.col("h")).count() == 0


def test_language_evidence_compiles(spark):
    """Without the fallback, code that is too long for the JVM is an error."""
    docs = table(spark, SF, "documents")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        out = langid.identify(docs, langid.train(docs, "text", "lang"), F.col("text"), declared=F.col("lang"), host=F.col("source"))
        out.write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_pages_by_markup_and_host(spark):
    pages = table(spark, SF, "pages")
    model = langid.train(table(spark, SF, "documents"), "text", "lang")
    extra = spark.createDataFrame([
        (-1, "https://user@news.example.de:8080/x", "<!-- <html lang=es> --><HTML class=a lang='de-AT'><script>the of and</script><p>Die Menschen sind frei und gleich an Recht geboren</p>"),
        (-2, None, "<html lang=fr>"), (-3, "no scheme", None), (-4, "http://a.example.fr/", "<p>" + FOREIGN[0] + "</p>"),
    ], pages.schema)
    got = {r["page_id"]: r for r in langid.page_languages(pages.unionByName(extra).withColumn("posterior", F.lit(1)), model).collect()}
    assert len(got) == pages.count() + 4
    assert np.mean([r["pred_lang"] == r["declared"] for i, r in got.items() if i >= 0]) > 0.8
    assert (got[-1]["host"], got[-1]["declared"], got[-1]["pred_lang"]) == ("news.example.de", "de-AT", "de")
    assert (got[-2]["host"], got[-2]["declared"], got[-2]["pred_lang"], got[-3]["pred_lang"]) == ("", "fr", None, None) and not got[-4]["accepted"]


#: Texts in other scripts and languages, code, random letters.
FOREIGN = (
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "def walk(xs, f):\n    out = []\n    for i, x in enumerate(xs):\n        if x is None: continue\n        out.append(f(x) ** 2)\n    return {k: v for k, v in out}",
    "xkq zzv qwpt vbnm hjkl wrtz pqxj kkzv mnbq xcvz lkjh gfds qpwo zmxn",
)


def test_foreign_texts_and_code_are_not_accepted(spark, monkeypatch):
    docs = table(spark, SF, "documents")
    rows = docs.unionByName(spark.createDataFrame([(10**6 + i, t, "en", "src1", 1) for i, t in enumerate(FOREIGN)], docs.schema))
    model = langid.train(docs, "text", "lang")
    got = {}
    for hosts in (langid.BROADCAST_HOSTS, 3):  # hosts broadcast, and joined
        monkeypatch.setattr(langid, "BROADCAST_HOSTS", hosts)
        out = langid.identify(rows, model, F.col("text"), declared=F.col("lang"), host=F.col("source")).collect()
        got[hosts] = {r["doc_id"]: (r["pred_lang"], round(r["posterior"] or 0, 9), r["accepted"], r["text"]) for r in out}
        assert all(x[:1] == ("other",) and not x[2] for i, x in got[hosts].items() if i >= 10**6)
        assert np.mean([x[2] for i, x in got[hosts].items() if i < 10**6]) > 0.99
    assert got[3] == got[langid.BROADCAST_HOSTS]
    import corpus_pipeline as cp

    # rows of a wrong label would train the model
    rows = rows.withColumn("lang", F.when(F.col("doc_id") < 10**6, F.col("lang")))
    assert {r["doc_id"] for r in cp.identify_language(spark, rows, SF).collect()} == {r["doc_id"] for r in docs.collect()}


def test_fused_posterior_equals_brute_force(spark):
    """Evidence, grouped priors of host, domain, suffix and corpus without the row's own share, fused in plain Python."""
    model = langid.train(table(spark, SF, "documents"), "text", "lang")
    docs = table(spark, SF, "documents").where("doc_id < 40").select("text", "lang").collect()
    hosts = ["a.example.de", "b.example.de", "b.example.de", "c.other.fr", "d.uk", None]
    rows = [(i, r["text"], [r["lang"], "fr", None, "xx"][i % 4], hosts[i % 6]) for i, r in enumerate(docs)] + [(98, "", "de", "d.uk"), (99, None, None, None)]
    k = len(langid.LANGUAGES) + 1

    def softmax(x):
        e = np.exp(x - x.max())
        return e / e.sum()

    def likelihood(value, right):
        out = np.zeros(k)
        if value in langid.LANGUAGES:
            out[:] = np.log((1 - right) / (k - 1))
            out[langid.LANGUAGES.index(value)] = np.log(right)
        return out

    ev = {}
    for i, text, lang, host in rows:
        g = np.concatenate([np.empty(0, np.int64), *langid.trigrams(text)]).astype(int)
        if len(g):
            suffix = langid.SUFFIXES.get((host or "").rsplit(".", 1)[-1]) if "." in (host or "") else None
            ev[i] = model[:, g].astype(float).mean(axis=1) * min(len(g), langid.EFFECTIVE) + likelihood(lang, langid.DECLARED_RIGHT) + likelihood(suffix, langid.SUFFIX_RIGHT)
    first = {i: softmax(e) for i, e in ev.items()}
    host = {i: h or "" for i, _, _, h in rows}
    domain = {h: ".".join(h.split(".")[-2:]) for h in host.values()}
    suffix = {h: h.rsplit(".", 1)[1] if "." in h else "" for h in host.values()}

    def sums(key):
        out = {}
        for i, p in first.items():
            n, c = out.get(key(host[i]), (0, np.zeros(k)))
            out[key(host[i])] = n + 1, c + p
        return out

    by_host, by_domain, by_suffix, (n, c) = sums(lambda h: h), sums(lambda h: (domain[h], suffix[h])), sums(lambda h: suffix[h]), sums(lambda h: 0)[0]
    world = (c + 1) / (n + k)
    want = {}
    for i, e in ev.items():
        h, prior = host[i], world
        for held in (by_suffix[suffix[h]], by_domain[domain[h], suffix[h]]):
            prior = (held[1] + langid.KAPPA * prior) / (held[0] + langid.KAPPA)
        n, c = by_host[h]
        prior = (np.maximum(c - first[i], 0) + langid.KAPPA * prior) / (n - 1 + langid.KAPPA)
        want[i] = softmax(e + np.log(prior))
    df = spark.createDataFrame(rows, "i int, t string, d string, h string")
    got = {r["i"]: r for r in langid.identify(df, model, F.col("t"), F.col("d"), F.col("h")).collect()}
    for i in host:
        if i in want:
            assert abs(got[i]["posterior"] - want[i].max()) < 1e-5 and got[i]["pred_lang"] == (*langid.LANGUAGES, langid.OTHER)[int(want[i].argmax())]
        else:
            assert got[i]["pred_lang"] is None


def test_pipeline_equals_brute_force(spark):
    sys.path.insert(0, str(Path(__file__).parents[2]))
    import corpus_pipeline as cp

    from .test_pairs import brute
    from .test_texts import decontam_brute

    docs = table(spark, SF, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    extra = spark.createDataFrame([(None, "12 34", "en", None, 5), (9999, None, None, "s", 0)], docs.schema)
    out = docs.unionByName(extra)
    for name, stage in cp.STAGES[:3]:
        found = stage(spark, out, SF)
        assert found.columns == docs.columns, name
        out = cp.written(found, name)
        if name == "language_id":
            assert {r["doc_id"] for r in out.collect()} == {i for i, _ in rows}
        if name == "near_dedup":
            want = {i for i, (_, c) in brute(rows, 5, 80).items() if i == c}
            assert sorted(r["doc_id"] for r in out.collect()) == sorted(want)
    left = [(i, t) for i, t in rows if i in want]
    clean = [r[0] for r in decontam_brute(left, items, 0) if not r[5]]
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(clean)
    pieces = bm25_pack.pack_documents(out).collect()
    check_pieces([x for x in left if x[0] in set(clean)], pieces)


def test_pipeline_stages_take_nulls_repeats_and_nothing(spark):
    import corpus_pipeline as cp

    item = table(spark, SF, "benchmark").first()["text"]
    rows = [(1, "the of and " * 9, "en", "s", 1), (1, "the of and " * 9, "en", "s", 1), (None, item, "en", None, 1), (None, "and the of in to that", "en", None, None), (2, item, "fr", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r["doc_id"]) for r in cp.drop_near_duplicates(spark, docs, SF).collect()) == ["1", "2", "None", "None"]
    assert sorted(str(r["doc_id"]) for r in cp.decontaminate(spark, docs, SF).collect()) == ["1", "1", "None"]
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
