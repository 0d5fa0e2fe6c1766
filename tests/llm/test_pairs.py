"""Near-dedup, embedding near-dedup and components against brute force, and their edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaesta.llm import cover_tree, near_dup
from quaesta.llm.components import connected_components


def groups(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_of_paths_hubs_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (None, 3), (200, 199), (200, 199)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = groups({x for e in edges for x in e if x is not None}, [(a, b) for a, b in edges if a is not None])
    assert got == {k: v for k, v in want.items() if k in got} and len(got) == 41 + 50 + 2
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in groups(ids, links).items()}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(3, 160))]
        for _ in range(rng.randint(1, 14)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 25))):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((n, " ".join(t)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t "), (n + 3, "ONE two"), (n + 4, "one TWO"), (n + 5, "one two x")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 4, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_open_buckets_are_searched_whole(spark, monkeypatch):
    """Chains in which no member is like the smallest; chunks of two members."""
    monkeypatch.setattr(near_dup, "CHUNK", 2)
    rng = random.Random(1)
    base, rows = [f"a{rng.random()}" for _ in range(120)], []
    for i in range(10):
        rows.append((i, " ".join(base)))
        for _ in range(2):
            base[rng.randrange(120)] = f"b{rng.random()}"
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 4, 80)


def test_near_duplicates_edges(spark):
    rows = [(1, "a b c d e f", 1), (1, "z y x w v u", 2), (2, "z y x w v u", 3), (None, "a b c d e f", 4), (None, None, 5), (3, "a b c d e f", 6), (3, "a b c d e f", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest int").withColumnRenamed("digest", "component_id")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True), (None, None, True), (3, 1, False), (3, 1, False)], key=str)
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_estimate_is_near_the_similarity(spark):
    a, b = (" ".join(f"w{i}" for i in r) for r in (range(1000), range(100, 1100)))
    s = near_dup.signatures(spark.createDataFrame([(0, a), (1, b)], "doc_id long, text string"), k=5)
    x, y = s.where("doc_id = 0").select(F.col("planes").alias("x")), s.where("doc_id = 1").select(F.col("planes").alias("y"))
    assert abs(x.join(y).select(near_dup.estimate(F.col("x"), F.col("y"))).first()[0] - 896 / 1096) < 0.15
    assert near_dup.cut(0.8) < 0.65


def cosine_brute(rows, threshold=0.9):
    ok = {i: np.array(v, float) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = []
    ids = sorted(ok)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= threshold:
                links.append((a, b))
    comp = groups([i for i, _ in rows], links)
    return {i: (sum(i in p for p in links), comp[i]) for i, _ in rows}


@pytest.mark.parametrize("spread", [0.02, 0.15])
def test_embedding_duplicates_equal_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(cover_tree, "BLOCK", 40)
    monkeypatch.setattr(cover_tree, "LEAF", 4)
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(8):
        c = rng.normal(size=8)
        for _ in range(int(rng.integers(5, 30))):
            rows.append((len(rows), [float(np.float32(x)) for x in c + spread * np.linalg.norm(c) * rng.normal(size=8)]))
    rows += [(len(rows) + i, list(rows[0][1])) for i in range(5)]
    rows += [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [None] + [1.0] * 7), (1004, [1.0, 2.0]), (1005, [2.0, 4.0]), (1006, []), (1007, [float("inf")] * 8)]
    got = cover_tree.embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == cosine_brute(rows)


def test_embedding_duplicates_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 2.0], 1), (None, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, n_links int")
    got = sorted(((r["vec_id"], r["component_id"], r["kept"]) for r in cover_tree.embedding_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True)], key=str)
    assert cover_tree.embedding_duplicates(df.limit(0)).count() == 0


def test_cover_tree_levels_nest_and_cover():
    rng = np.random.default_rng(0)
    x = cover_tree.unit(np.concatenate([c + 0.05 * rng.normal(size=(60, 6)) for c in rng.normal(size=(10, 6))]))
    built = cover_tree.CoverTree(x, 0.05)
    t = cover_tree.CoverTree.load(built.dump())
    y = x[built.order]
    assert sorted(built.order.tolist()) == list(range(len(x))) and len(t.start) > 100
    for i in range(len(t.start)):
        assert (cover_tree.chord(y[t.start[i] : t.end[i]] @ y[t.center[i]]) <= t.radius[i] + cover_tree.EPS).all()
        if t.kids[i]:
            first, last = t.kid[i], t.kid[i] + t.kids[i] - 1
            assert t.center[i] == t.center[first] and t.start[first] == t.start[i] and t.end[last] == t.end[i]


def test_dual_traversal_of_clusters_is_not_quadratic():
    rng, work = np.random.default_rng(6), []
    centres = rng.normal(size=(400, 32))
    for n in (2000, 4000):
        v = (centres[: n // 10].repeat(10, axis=0) + 0.03 * rng.normal(size=(n, 32))).astype(np.float32).astype(float)
        x = cover_tree.unit(v)
        tree = cover_tree.CoverTree(x, 0.1)
        seen: dict = {}
        w = np.ones(n, np.int64)
        na, nb, forest = cover_tree.join_blocks(v[tree.order], w, tree, v[tree.order], w, tree, 0.9, True, seen)
        assert ((na + nb)[np.argsort(tree.order)] == ((x @ x.T >= 0.9).sum(axis=1) - 1)).all() and len(forest) == n - n // 10
        work.append(seen["pairs"])
    # two levels below the root: centres in pairs, and points of near centres only
    assert work[0] < 2000 * 2000 / 8 and work[1] < 4.2 * work[0]


def test_cells_split_until_blocks_hold_them(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 16)
    rng = np.random.default_rng(9)
    v = (rng.normal(size=(40, 16)).repeat(25, axis=0) + 0.02 * rng.normal(size=(1000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "rep long, v array<double>, w long")
    blocks, pairs = cover_tree._blocks(df, 0.9)
    n = blocks.count()
    assert n > 10 and pairs.count() < n * (n + 1) / 2 / 3
    whole = v.astype(float)
    got = cover_tree.embedding_duplicates(df.select(F.col("rep").alias("vec_id"), F.col("v").alias("embedding"))).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == cosine_brute(list(enumerate(whole.tolist())))
