"""Embedding near-dedup by dual traversal of cover trees (operator 9).

Equal vectors are one class. Levels are built in two places. Across the cluster, farthest-first pivots of a bounded
sample split the space into cells, again and again while a cell is expected to exceed a block, and
a cell that does is cut by its vectors' distances from the pivot; cells, and blocks by
centre and covering radius, that are too far apart are never paired. Within a block there is a
cover tree: nested levels of centres, radii halving, every point within its centre's radius.
Two blocks are compared by walking both trees: a pair of nodes goes when its centres' distance exceeds
both radii plus the threshold distance, links as a whole when it is surely inside it, and else
both nodes are replaced by their children, down to points, which are compared exactly.

A task returns, for its pair of blocks, link counts per class and a spanning forest of
the links, never the links themselves, so dense groups stay linear in what is moved. On unrelated
vectors in many dimensions every point is a child of the root, nothing can be pruned, and all
pairs of points are compared, which is quadratic as an exact answer on such data is.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected_components

#: Vectors of a block, fewer where they are long, and bytes of one at most.
BLOCK, BLOCK_BYTES = 4096, 8 << 20
LEAF = 16
#: Vectors at most that cells are made from, and cells at most of each dimension; they change work only.
SAMPLE, PIVOTS, MAX_CELLS = 8192, 16, 1024
#: Parts that a cell's distances from its pivot are counted in.
RINGS = 256
#: Slack of a distance, and of a cosine in four bytes: more than rounding can make of either.
EPS, LOOSE = 1e-6, 2e-5


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def chord(cos):
    """Distance of unit vectors with this cosine."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos))


def block_rows(dim: int) -> int:
    return max(16, min(BLOCK, BLOCK_BYTES // (8 * max(1, dim))))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Places of farthest-first centres of unit vectors."""
    chosen, far = [0], chord(sample @ sample[0])
    while len(chosen) < min(count, len(sample)) and far.max() > EPS:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, chord(sample @ sample[chosen[-1]]))
    return np.array(chosen)


class Cells:
    """A tree of pivots: ``inner[i]`` are the children of a split node as ``(pivots, nodes)``; ``leaf`` maps nodes without children to cells."""

    def __init__(self, sample: np.ndarray, rows: int):
        self.inner: dict[int, tuple[np.ndarray, list[int]]] = {}
        self.leaf, self.centres, nodes = {}, [], 1
        most = block_rows(sample.shape[1])
        todo = [(0, np.arange(len(sample)), sample[0])]
        while todo:
            me, own, centre = todo.pop(0)
            expected = len(own) / len(sample) * rows
            at = choose_pivots(sample[own], int(np.clip(math.ceil(expected / most), 2, PIVOTS))) if expected > 2 * most and len(own) > 1 else own[:0]
            if len(at) < 2 or len(self.centres) + len(todo) + len(at) > MAX_CELLS:
                self.leaf[me] = len(self.centres)
                self.centres.append(centre)
                continue
            pivots = sample[own[at]]
            near = (sample[own] @ pivots.T).argmax(axis=1)
            self.inner[me] = (pivots, list(range(nodes, nodes + len(at))))
            todo += [(nodes + j, own[near == j], pivots[j]) for j in range(len(at))]
            nodes += len(at)
        self.centres = np.array(self.centres)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each unit vector and distance from its centre."""
        node, todo = np.zeros(len(x), np.int64), [0] if 0 in self.inner else []
        while todo:
            me = todo.pop()
            pivots, kids = self.inner[me]
            at = np.nonzero(node == me)[0]
            if len(at):
                node[at] = np.array(kids)[(x[at] @ pivots.T).argmax(axis=1)]
            todo += [k for k in kids if k in self.inner]
        cell = np.array([self.leaf.get(i, -1) for i in range(max(self.leaf) + 1)])[node]
        return cell, chord(np.einsum("ij,ij->i", x, self.centres[cell]))


class CoverTree:
    """Nodes in order of level: node i holds points ``start[i]:end[i]`` of ``order`` within ``radius[i]`` of point ``center[i]``; its children are ``kid[i]:kid[i] + kids[i]``."""

    def __init__(self, x: np.ndarray, least: float):
        start, end, center, radius, kid, kids = [0], [len(x)], [0], [], [], []
        order = np.arange(len(x))
        d = chord(x @ x[0])
        held = [(order, d, float(d.max()))]
        i = 0
        while i < len(held):
            points, dist, cover = held[i]
            radius.append(float(dist.max()) if len(points) > 1 else 0.0)
            kid.append(len(held)), kids.append(0)
            order[start[i] : end[i]] = points
            if len(points) > LEAF and cover > least:
                at = start[i]
                for c, own, near in self._cover(x, points, center[i], dist, cover / 2):
                    start.append(at), end.append(at + len(own)), center.append(c), held.append((own, near, cover / 2))
                    at += len(own)
                    kids[i] += 1
            held[i] = None
            i += 1
        place = np.empty(len(x), np.int64)
        place[order] = np.arange(len(x))
        self.order, self.start, self.end, self.radius = order, np.array(start), np.array(end), np.array(radius)
        self.center, self.kid, self.kids = place[np.array(center)], np.array(kid), np.array(kids)

    @staticmethod
    def _cover(x, points, center, dist, radius):
        """Groups within ``radius`` of centres that are farther apart than it, the parent's centre first."""
        near = dist <= radius
        yield center, points[near], dist[near]
        left = points[~near]
        y, free = x[left], np.ones(len(left), bool)
        for i in range(len(left)):
            if free[i]:
                d = chord(y @ y[i])
                near = free & (d <= radius)
                near[i] = True
                free &= ~near
                yield int(left[i]), left[near], d[near]

    FIELDS = ("start", "end", "center", "kid", "kids")

    def dump(self) -> bytes:
        return np.stack([getattr(self, f) for f in self.FIELDS]).astype("<i4").tobytes() + self.radius.astype("<f8").tobytes()

    @classmethod
    def load(cls, raw: bytes) -> CoverTree:
        self, n = cls.__new__(cls), len(raw) // (4 * len(cls.FIELDS) + 8)
        for f, row in zip(cls.FIELDS, np.frombuffer(raw, "<i4", n * len(cls.FIELDS)).reshape(-1, n), strict=True):
            setattr(self, f, row.astype(np.int64))
        self.radius = np.frombuffer(raw, "<f8", offset=4 * len(cls.FIELDS) * n)
        return self

    def expand(self, e: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What stands below an entity: entities, their places and radii. A node is its number, a point the complement of its place."""
        if e < 0:
            return np.array([e]), np.array([~e]), np.zeros(1)
        if self.kids[e]:
            k = np.arange(self.kid[e], self.kid[e] + self.kids[e])
            single = self.end[k] - self.start[k] == 1
            return np.where(single, ~self.start[k], k), self.center[k], self.radius[k]
        p = np.arange(self.start[e], self.end[e])
        return ~p, p, np.zeros(len(p))

    def span(self, e: int) -> tuple[int, int]:
        return (~e, ~e + 1) if e < 0 else (int(self.start[e]), int(self.end[e]))


def walk(xa, ta: CoverTree, xb, tb: CoverTree, reach: float, same: bool, seen: dict):
    """Yield ``(True, span, span)`` that link as a whole and ``(False, points, points)`` to compare exactly. Within one tree each pair once."""
    todo = [(0, 0)]
    while todo:
        a, b = todo.pop()
        ea, pa_, ra = ta.expand(a)
        eb, pb, rb = tb.expand(b)
        own = same and a == b
        for at in range(0, len(ea), 2048):
            part = slice(at, at + 2048)
            cos = xa[pa_[part]] @ xb[pb].T
            seen["pairs"] = seen.get("pairs", 0) + cos.size
            if not ra[part].any() and not rb.any():
                near = cos >= 1 - reach * reach / 2 - LOOSE
                whole = None
            else:
                both = (ra[part, None] + rb).astype(np.float32)
                near = cos >= 1 - (both + np.float32(reach)) ** 2 / 2 - np.float32(LOOSE)
                room = np.maximum(np.float32(reach) - both, 0)
                whole = near & (both > 0) & (cos >= 1 - room * room / 2 + np.float32(LOOSE))
            if own:
                near &= np.arange(at, at + len(cos))[:, None] <= np.arange(len(eb))
                if whole is not None:
                    whole &= near
            i, j = np.nonzero(near)
            i += at
            points = (ea[i] < 0) & (eb[j] < 0)
            if own:
                points &= i != j
            seen["compared"] = seen.get("compared", 0) + int(points.sum())
            if points.any():
                yield False, ~ea[i[points]], ~eb[j[points]]
            deeper = ~((ea[i] < 0) & (eb[j] < 0))
            for k, m in zip(i[deeper].tolist(), j[deeper].tolist(), strict=True):
                x, y = int(ea[k]), int(eb[m])
                if own and k == m:
                    # all of a node's points link with each other within half the threshold distance of its centre
                    if 2 * ra[k] <= reach - EPS:
                        yield True, ta.span(x), tb.span(y)
                    else:
                        todo.append((x, y))
                elif whole is not None and whole[k - at, m]:
                    yield True, ta.span(x), tb.span(y)
                else:
                    todo.append((x, y))


def _exact(a: np.ndarray, b: np.ndarray) -> float:
    dot, aa, bb = (math.fsum(float(p) * float(q) for p, q in zip(x, y, strict=True)) for x, y in ((a, b), (a, a), (b, b)))
    return dot / math.sqrt(aa * bb)


def join_blocks(va, wa, ta: CoverTree, vb, wb, tb: CoverTree, threshold: float, same: bool, seen: dict | None = None):
    """Links between two blocks: counts per member of each (weights of the others), and ``(i, j)`` forest edges over both (b's after a's).

    Of one block with itself the counts of both have to be added.
    """
    xa, xb = unit(va), unit(vb)
    na, nb = np.zeros(len(xa), np.int64), np.zeros(len(xb), np.int64)
    label = np.arange(len(xa) + (0 if same else len(xb)))
    off = 0 if same else len(xa)

    def unite(i, j):
        while True:
            low = np.minimum(label[i], label[j])
            if (label[i] == low).all() and (label[j] == low).all():
                return
            # roots move too, so that earlier members follow
            np.minimum.at(label, label[i], low), np.minimum.at(label, label[j], low)
            np.minimum.at(label, i, low), np.minimum.at(label, j, low)
            while (label[label] != label).any():
                label[:] = label[label]

    near_a, near_b = xa.astype(np.float32), xb.astype(np.float32)
    for whole, p, q in walk(near_a, ta, near_b, tb, float(chord(threshold)), same, {} if seen is None else seen):
        if whole:
            (s, e), (u, v) = p, q
            if same and (s, e) == (u, v):
                na[s:e] += wa[s:e].sum() - wa[s:e]
            else:
                na[s:e] += wb[u:v].sum()
                nb[u:v] += wa[s:e].sum()
            unite(np.arange(s, e), np.full(e - s, off + u))
            unite(np.full(v - u, s), off + np.arange(u, v))
            continue
        for at in range(0, len(p), 65536):
            i, j = p[at : at + 65536], q[at : at + 65536]
            c = np.einsum("ij,ij->i", xa[i], xb[j])
            hit = c >= threshold - 1e-12
            for k in np.nonzero(hit & (c <= threshold + 1e-12))[0]:
                hit[k] = _exact(va[i[k]], vb[j[k]]) >= threshold
            i, j = i[hit], j[hit]
            if len(i):
                np.add.at(na, i, wb[j])
                np.add.at(nb, j, wa[i])
                unite(i, off + j)
    child = np.nonzero(label != np.arange(len(label)))[0]
    return na, nb, np.stack([label[child], child], 1)


def _vectors(rows, dim: int) -> np.ndarray:
    return np.stack([np.asarray(r, np.float64) for r in rows]) if len(rows) else np.empty((0, dim))


def _narrow(v: np.ndarray) -> np.ndarray:
    """In four bytes a number where that loses nothing."""
    narrow = v.astype(np.float32)
    return narrow if (narrow == v).all() else v


BLOCKS = "dim int, cell int, block long, center array<double>, radius double, vectors binary, reps binary, weights binary, tree binary"


def _build(least: float):
    def run(pdf):
        import pandas as pd

        v = _vectors(pdf["v"].tolist(), int(pdf["dim"].iloc[0]))
        order = np.argsort(pdf["rep"].to_numpy())
        v, rep, w = v[order], pdf["rep"].to_numpy()[order], pdf["w"].to_numpy()[order]
        x = unit(v)
        tree = CoverTree(x, least)
        o = tree.order
        return pd.DataFrame([{
            "dim": v.shape[1], "cell": int(pdf["cell"].iloc[0]), "block": int(pdf["block"].iloc[0]), "center": x[o][tree.center[0]].tolist(), "radius": float(tree.radius[0]),
            "vectors": _narrow(v[o]).tobytes(), "reps": rep[o].astype("<i8").tobytes(), "weights": w[o].astype("<i8").tobytes(), "tree": tree.dump(),
        }])

    return run


def _compare(threshold: float):
    def load(v, r, w, t, dim):
        kind = np.float32 if len(v) * 2 == len(r) * dim else np.float64
        return np.frombuffer(v, kind).reshape(-1, dim).astype(np.float64), np.frombuffer(r, "<i8"), np.frombuffer(w, "<i8"), CoverTree.load(t)

    def run(batches):
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                a, b, dim, *blobs = (x.as_py() for x in row)
                va, ra, wa, ta = load(*blobs[:4], dim)
                vb, rb, wb, tb = load(*blobs[4:], dim)
                na, nb, forest = join_blocks(va, wa, ta, vb, wb, tb, threshold, a == b)
                both = ra if a == b else np.concatenate([ra, rb])
                n = na + nb if a == b else np.concatenate([na, nb])
                at = np.nonzero(n)[0]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([both[at], both[forest[:, 0]]]), pa.int64()),
                        pa.array(np.concatenate([np.full(len(at), -1), both[forest[:, 1]]]), pa.int64(), mask=np.arange(len(at) + len(forest)) < len(at)),
                        pa.array(np.concatenate([n[at], np.zeros(len(forest), np.int64)]), pa.int64()),
                    ],
                    ["a", "b", "n"],
                )

    return run


def embedding_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """Per input row ``vec_id, n_links, component_id, kept``.

    Vectors that are null, empty, zero, or hold nulls or non-finite numbers link with nothing, as do vectors of other
    dimensions with each other. Rows with one id are one vector for components; each counts as a link of the others.
    A null id has a null component and is kept, and is no part of other rows' counts. Other columns are ignored; an empty table gives no rows.
    """
    if not 0 < threshold < 1:
        raise ValueError("the threshold lies between 0 and 1")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(F.coalesce(finite, F.lit(False)) & F.col("vec_id").isNotNull(), F.transform("v", lambda x: x + 0.0)))
    rows = rows.withColumn("top", F.array_max(F.transform("v", F.abs)))
    # halves of large numbers cannot overflow when squared, and scale changes no cosine
    rows = rows.withColumn("v", F.when(F.col("top").between(1e-100, 1e100), F.col("v")).otherwise(F.transform("v", lambda x: x / F.col("top"))))
    # 128 bits name a vector
    rows = written(rows.select("vec_id", F.when(F.col("v").isNotNull(), F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(9), "v").alias("b"))).alias("key"), "v"), "rows")
    valid = rows.where("key is not null")
    classes = written(valid.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"), F.first("v").alias("v")), "classes")
    blocks, pairs = _blocks(classes, threshold)
    blob = ("vectors", "reps", "weights", "tree")
    left = blocks.select(F.col("id").alias("a"), "dim", *(F.col(c).alias(f"{c}_a") for c in blob))
    right = blocks.select(F.col("id").alias("b"), *(F.col(c).alias(f"{c}_b") for c in blob))
    found = pairs.join(left, "a").join(right, "b").select("a", "b", "dim", *(f"{c}_a" for c in blob), *(f"{c}_b" for c in blob))
    found = written(found.mapInArrow(_compare(threshold), "a long, b long, n long"), "links")
    comp = connected_components(found.where("b is not null").select("a", "b").unionByName(_repeated_ids(valid, classes)))
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    of = (
        classes.select("key", "rep", "w").join(counts, "rep", "left").join(comp, F.col("rep") == F.col("id"), "left")
        .select("key", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    out = valid.select("vec_id", "key").join(of, "key").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    # rows without a vector meet no join: they would all wait at one null key
    none = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    none = none.join(comp, none["vec_id"] == comp["id"], "left").select("vec_id", "n_links", F.coalesce("component", "component_id").alias("component_id")) if _ids_with_both(rows) else none
    return out.unionByName(none).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _ids_with_both(rows: DataFrame) -> bool:
    """Whether an id has rows with a vector and rows without."""
    none = rows.where("key is null and vec_id is not null").select("vec_id")
    return not none.join(rows.where("key is not null").select("vec_id"), "vec_id", "left_semi").isEmpty()


def _repeated_ids(valid: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges that tie the classes of rows with one id."""
    twice = valid.groupBy("vec_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("vec_id")
    held = valid.select("vec_id", "key").join(twice, "vec_id", "left_semi")
    return held.join(classes.select("key", "rep"), "key").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))


def _placed(cells: dict[int, Cells]):
    """Classes with their dimension, cell and distance ``d`` from its centre."""

    def run(batches):
        for batch in batches:
            vs = batch.column(2)
            dims = np.array([len(v) for v in vs])
            cell, d = np.zeros(len(vs), np.int32), np.zeros(len(vs))
            for dim in np.unique(dims):
                at = np.nonzero(dims == dim)[0]
                x = vs.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                cell[at], d[at] = cells.value[int(dim)].assign(unit(x))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims, pa.int32()), pa.array(cell), pa.array(d)], ["rep", "w", "v", "dim", "cell", "d"])

    return run


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _blocks(classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Blocks, each with its cover tree, and the pairs ``(a, b)`` of their ids that can hold a link."""
    spark, reach = classes.sparkSession, float(chord(threshold))
    sized = classes.select("rep", "w", "v", F.size("v").alias("dim"))
    cells: dict[int, Cells] = {}
    for r in sized.groupBy("dim").agg(F.count("*").alias("n")).collect():
        some = sized.where(F.col("dim") == r["dim"])
        if r["n"] > SAMPLE:
            some = some.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int(SAMPLE / r["n"] * (1 << 30)))
        sample = np.array([x["v"] for x in some.orderBy(F.xxhash64("rep"), "rep").select("v").limit(SAMPLE).collect()], np.float64)
        cells[r["dim"]] = Cells(unit(sample), r["n"])
    shared = spark.sparkContext.broadcast(cells)
    placed = written(classes.select("rep", "w", "v").mapInArrow(_placed(shared), "rep long, w long, v array<double>, dim int, cell int, d double"), "cells")
    # at most RINGS rows of each of at most MAX_CELLS cells come to the driver and are broadcast
    ring = F.least(F.floor(F.col("d") / 2.0 * RINGS), F.lit(RINGS - 1)).cast("int")
    rings = sorted(tuple(r) for r in placed.groupBy("dim", "cell", ring.alias("ring")).agg(F.count("*").alias("n"), F.max("d").alias("d")).collect())
    table, farthest, last, block, held = [], {}, None, -1, 0
    for dim, cell, k, n, d in rings:
        most = block_rows(dim)
        splits = max(1, round(n / most))
        if (dim, cell) != last or splits > 1 or held + n > most:
            last, block, held = (dim, cell), block + 1, 0
        table.append((dim, cell, k, block, splits))
        block, held = block + splits - 1, held + n if splits == 1 else 1 << 62
        farthest[dim, cell] = max(farthest.get((dim, cell), 0.0), d)
    where = spark.createDataFrame(table, "dim int, cell int, ring int, first long, splits int")
    dealt = placed.withColumn("ring", ring).join(F.broadcast(where), ["dim", "cell", "ring"])
    dealt = dealt.select("rep", "w", "v", "dim", "cell", (F.col("first") + F.pmod(F.xxhash64("rep"), F.col("splits"))).alias("block"))
    blocks = dealt.groupBy("dim", "cell", "block").applyInPandas(_build(reach / 4), BLOCKS)
    blocks = written(blocks.withColumnRenamed("block", "id"), "blocks")
    pairs = []
    for dim in cells:
        names = [c for d, c in farthest if d == dim]
        centre, r = cells[dim].centres[names], np.array([farthest[dim, c] for c in names])
        near = chord(centre @ centre.T) <= r[:, None] + r + reach + EPS
        np.fill_diagonal(near, True)
        pairs += [(dim, names[i], names[j]) for i, j in np.argwhere(near).tolist()]
    near = spark.createDataFrame(pairs, "dim int, ca int, cb int")
    a, b = (blocks.select(F.col("id").alias(x), F.col("cell").alias(f"c{x}"), "dim", F.col("center").alias(f"m{x}"), F.col("radius").alias(f"r{x}")) for x in "ab")
    far = F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * _dot(F.col("ma"), F.col("mb")))) > F.col("ra") + F.col("rb") + reach + EPS
    found = a.join(F.broadcast(near), ["dim", "ca"]).join(b, ["dim", "cb"]).where((F.col("a") <= F.col("b")) & ((F.col("a") == F.col("b")) | ~far))
    return blocks, found.select("a", "b")
