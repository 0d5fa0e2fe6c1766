"""MinHash near-dedup with b-bit signatures (operator 2).

Per text: the set of distinct word shingles, 128 minima, 32 band keys of four minima
each, and the lowest four bits of every minimum as four 128-bit planes. Two texts that
share a band key are candidates; their similarity is estimated from the planes by bit
counts, corrected for the 1/16 of unequal minima whose low bits agree by chance, and
candidates more than six standard errors below the threshold go. What is left is
confirmed on the full shingle sets. A pair at similarity 0.8 misses every band with
probability 5e-8.

Groups of copies stay linear: equal sets are one class; each class first confirms its
best candidate among the smallest members of its buckets, which joins a group of
near copies to one component; then buckets are searched for links between *different*
components only. That search compares members within chunks of a bucket, first by their planes, then all that pass
the estimate on their full sets, and returns a forest of links, so its results stay linear too. Where many texts share a bucket
and are nearly but not quite similar, its comparisons are quadratic, as an exact result needs, and a member
of a bucket of c chunks is sent to c tasks, so the rows moved for n of them are n * n / CHUNK.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, enter, mix64, settle, space_words, written
from .components import connected_components

N_HASH, BANDS, ROWS, BITS = 128, 32, 4, 4
MAX_WORDS = 250_000
#: Members of a bucket that are compared at once; a larger bucket is cut into chunks, and these are paired.
CHUNK = 1024
#: Shingles of a chunk, expected: bounds the bytes of full sets that a task holds.
CHUNK_SHINGLES = 2_000_000
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 1 << 31, N_HASH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, N_HASH, dtype=np.uint32)


class _WordHash(dict):
    """Word -> 64-bit hash; emptied when full, so a worker's memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _WordHash()
CACHES["near_dup"] = _WORDS.clear


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; one for a shorter text, none for no words."""
    words = space_words(text or "")
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    width = min(k, len(h))
    acc = mix64(h[: len(h) - width + 1] + np.uint64(width))
    for j in range(1, width):
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - width + 1 + j])
    return np.unique(acc)


def _minima(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(N_HASH, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(best, (x[i : i + 1024, None] * _A + _B).min(axis=0), out=best)
    return best


def _band_keys(minima: np.ndarray) -> np.ndarray:
    m = minima.astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        key = mix64(key ^ (m[:, j] + np.uint64(0x632BE59BD9B4E019)))
    return key.view(np.int64)


def _planes(minima: np.ndarray) -> np.ndarray:
    """Low bits as BITS planes of N_HASH bits each, in longs."""
    m = minima.astype(np.uint32)
    m = (m ^ (m >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    m ^= m >> np.uint32(13)
    return np.concatenate([np.packbits((m >> np.uint32(j)).astype(np.uint8) & 1) for j in range(BITS)]).view(np.int64)


def _signatures(k: int):
    def run(batches):
        enter("near_dup")
        for batch in batches:
            n, digest, keys, planes = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), k)
                n.append(len(s))
                if not len(s):
                    digest.append(None), keys.append(None), planes.append(None)
                    continue
                m = _minima(s)
                digest.append(xxhash.xxh3_128_digest(s.tobytes())), keys.append(_band_keys(m)), planes.append(_planes(m))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())), pa.array(planes, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "digest", "bands", "planes"],
            )
        settle()

    return run


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """One row per input row: id, set size, digest of the set, band keys, bit planes (null without words)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _signatures(k), "doc_id long, n_shingles long, digest binary, bands array<long>, planes array<long>"
    )


def estimate(x, y):
    """Collision-corrected similarity of two plane arrays."""
    half = N_HASH // 64
    unequal = F.lit(0)
    for w in range(half):
        diff = None
        for j in range(BITS):
            d = x[j * half + w].bitwiseXOR(y[j * half + w])
            diff = d if diff is None else diff.bitwiseOR(d)
        unequal = unequal + F.bit_count(diff)
    chance = 1.0 / (1 << BITS)
    return ((1.0 - unequal / F.lit(float(N_HASH))) - chance) / (1.0 - chance)


def cut(threshold: float) -> float:
    """The estimate six standard errors below the threshold."""
    chance = 1.0 / (1 << BITS)
    p = threshold + (1 - threshold) * chance
    return (p - 6 * (p * (1 - p) / N_HASH) ** 0.5 - chance) / (1 - chance)


def _confirm(k: int, percent: int):
    def run(batches):
        enter("near_dup")
        last: tuple = (None, None)
        for batch in batches:
            a, b = [], []
            for row in zip(*(batch.column(i) for i in range(6)), strict=True):
                ia, ib, da, db, ta, tb = (x.as_py() for x in row)
                if last[0] != (ia, da) or last[2] != ta:
                    last = ((ia, da), shingle_set(ta, k), ta)
                x, y = last[1], shingle_set(tb, k)
                # where an id is repeated with other texts, only the rows of these sets count
                if xxhash.xxh3_128_digest(x.tobytes()) != da or xxhash.xxh3_128_digest(y.tobytes()) != db:
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    a.append(ia), b.append(ib)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs ``(a, b, da, db)`` those whose full sets reach the threshold. Texts of paired documents only are moved."""
    ta = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    tb = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(tb, "b").join(ta, "a").select("a", "b", "da", "db", "ta", "tb").mapInArrow(
        _confirm(k, percent), "a long, b long"
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80
) -> DataFrame:
    """Per input row: ``doc_id, n_shingles, component_id, kept``.

    Rows with one doc_id are one document for linking. A row without words or text
    links with nothing and is its own component. A null doc_id never links: component
    null, kept. Of a very long text all shingles count (a task holds the sets of one pair of chunks, some CHUNK_SHINGLES each). Other columns of ``docs``, whatever their names, are ignored. An empty
    table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sig = written(signatures(docs, k=k), "signatures")
    links, classes = _links(sig, docs, k, percent)
    twice = (
        sig.where("doc_id is not null and digest is not null").select("doc_id", "digest")
        .groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
    )
    held = sig.join(twice, "doc_id", "left_semi").join(classes.select("digest", "rep"), "digest")
    edges = links.unionByName(held.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    comp = connected_components(edges)
    of_class = classes.join(comp, F.col("rep") == F.col("id"), "left").select(
        "digest", F.coalesce("component", "rep").alias("of_class")
    )
    out = sig.where("digest is not null").select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left").select("doc_id", "n_shingles", "of_class")
    # rows without words meet no join: they would all wait at one null key
    out = out.unionByName(sig.where("digest is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("of_class")))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("of_class", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _links(sig: DataFrame, docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Confirmed links between class representatives that span every component; the classes."""
    least = cut(percent / 100)
    classes = (
        sig.where("digest is not null").groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("planes").alias("planes"))
        .where("rep is not null")
    )
    classes = written(classes, "classes")
    side = classes.select("rep", "digest", "n", "planes")
    members = classes.select("rep", F.explode("bands").alias("key"))
    # joins on a bucket meet a written table: then both sides are shuffled for the join, so that a large bucket is split
    pivots = written(members.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("size")).where("size > 1"), "pivots")
    stars = members.join(pivots.select("key", "pivot"), "key").where("rep <> pivot").select("rep", "pivot").distinct()

    def known(c: str, x: str) -> DataFrame:
        return side.select(*(F.col(o).alias(p) for o, p in zip(("rep", "digest", "n", "planes"), (c, f"d{x}", f"n{x}", f"p{x}"), strict=True)))

    similar = estimate(F.col("pa"), F.col("pb"))
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    # which stars are tried first changes no result, so only likely ones are
    best = (
        stars.join(known("pivot", "a"), "pivot").join(known("rep", "b"), "rep").where(sizes & (similar >= (least + 2 * percent / 100) / 3))
        .groupBy("rep", F.col("db")).agg(F.max_by(F.struct("pivot", "da"), F.struct(similar, -F.col("pivot"))).alias("p"))
        .select(F.col("p.pivot").alias("a"), F.col("rep").alias("b"), F.col("p.da").alias("da"), "db")
    )
    first = written(confirmed(written(best, "stars"), docs, k, percent), "links")
    comp = connected_components(first)
    placed = classes.select("rep", "digest", "n", "planes", "bands").join(comp, F.col("rep") == F.col("id"), "left")
    placed = written(placed.select("rep", "digest", "n", "planes", "bands", F.coalesce("component", "rep").alias("comp")), "placed")
    where = members.join(placed.select("rep", "comp"), "rep")
    mixed = written(where.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key"), "mixed")
    open_ = written(members.join(mixed, "key", "left_semi").join(placed, "rep"), "open")
    # of each bucket the members with a likely partner in another component: rows, not pairs
    near = _dealt(open_.select("key", "rep", "comp", "n", "planes"), F.lit(0))
    likely = written(near.select("key", "lo", "hi", "c", "rep", "comp", "n", "planes").mapInArrow(_likely(percent, least), "key long, rep long").distinct(), "likely")
    reps = written(likely.select("rep").distinct().join(placed, "rep"), "members")
    full = docs.join(reps.select(F.col("rep").alias("doc_id"), "digest"), "doc_id").select("doc_id", "digest", "text")
    full = full.mapInArrow(_full_sets(k), "rep long, digest binary, set binary")
    reps = written(reps.join(full, ["rep", "digest"]), "sets")
    dealt = _dealt(likely.join(reps, "rep").select("key", "rep", "comp", "n", "planes", "bands", "set"), F.col("n"))
    dealt = dealt.select("key", "lo", "hi", "c", "rep", "comp", "planes", "bands", "set")
    return first.unionByName(written(dealt.mapInArrow(_compare(percent, least), "a long, b long"), "links")), classes


def _dealt(members: DataFrame, size) -> DataFrame:
    """Members of buckets dealt to chunks (``c``) of CHUNK rows and CHUNK_SHINGLES of ``size``, each row once for every pair ``lo, hi`` of chunks that its own is in; one pair after the other."""
    chunks = members.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum(size) / CHUNK_SHINGLES)).alias("chunks"))
    chunks = written(chunks.where("chunks > 1"), "chunks")
    dealt = members.join(chunks, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("long")))
    dealt = dealt.withColumn("c", F.pmod(F.xxhash64("rep"), F.col("chunks")))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    dealt = dealt.withColumns({"lo": F.least("c", "o"), "hi": F.greatest("c", "o")}).drop("o", "chunks")
    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")


def _most_unequal(least: float) -> float:
    """Unequal low bits of two signatures whose estimate is just ``least``."""
    chance = 1.0 / (1 << BITS)
    return N_HASH * (1 - (least * (1 - chance) + chance))


def _likely(percent: int, least: float):
    """Members with a likely partner of another component in the same pair of chunks."""
    most = _most_unequal(least)

    def run(batches):
        import itertools

        flat = (tuple(x.as_py() for x in r) for b in batches for r in zip(*b.columns, strict=True))
        for (key, lo, hi), rows in itertools.groupby(flat, lambda r: r[:3]):
            rows = list(rows)
            chunk, rep, comp, size = (np.array([r[i] for r in rows], np.int64) for i in (3, 4, 5, 6))
            planes = np.array([r[7] for r in rows], np.int64).view(np.uint64).reshape(len(rows), BITS, N_HASH // 64)
            hit = np.zeros(len(rows), bool)
            for i in range(len(rows)):
                if lo != hi and chunk[i] != lo:
                    continue
                j = np.nonzero((chunk == hi if lo != hi else np.arange(len(rows)) > i) & (comp != comp[i]))[0]
                j = j[100 * np.minimum(size[j], size[i]) >= percent * np.maximum(size[j], size[i])]
                j = j[np.bitwise_count(np.bitwise_or.reduce(planes[j] ^ planes[i], axis=1)).sum(axis=1) <= most + 1e-9]
                hit[j] = True
                hit[i] |= len(j) > 0
            found = rep[hit]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), key, np.int64)), pa.array(found)], ["key", "rep"])

    return run


def _full_sets(k: int):
    """Full sets of the rows whose set has the wanted digest."""

    def run(batches):
        for batch in batches:
            out = []
            for row in zip(*batch.columns, strict=True):
                rep, digest, text = (x.as_py() for x in row)
                s = shingle_set(text, k)
                if xxhash.xxh3_128_digest(s.tobytes()) == digest:
                    out.append((rep, digest, s.astype("<u8").tobytes()))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["rep", "digest", "set"])

    return run


def _at_least(x: np.ndarray, sets: list[np.ndarray], percent: int, table: np.ndarray) -> np.ndarray:
    """Which sets can reach the threshold with ``x``: their intersections counted by hash, so never too low; those left counted exactly."""
    slot = x & np.uint64(len(table) - 1)
    table[slot] = True
    size = np.array([len(y) for y in sets])
    hits = np.add.reduceat(table[np.concatenate(sets) & np.uint64(len(table) - 1)].astype(np.int32), np.cumsum(size) - size)
    table[slot] = False
    hits = np.minimum(hits, np.minimum(size, len(x)))
    ok = 100 * hits >= percent * (len(x) + size - hits)
    for i in np.nonzero(ok)[0]:
        both = np.isin(sets[i], x).sum()
        ok[i] = 100 * both >= percent * (len(x) + size[i] - both)
    return ok


def _compare(percent: int, least: float):
    """Links within one bucket, or between two chunks of it, between different components: a forest of them.

    A pair that shares several buckets is compared in the first.
    """
    most_unequal = _most_unequal(least)

    def group(rows):
        key, lo, hi = rows[0][:3]
        planes = np.array([r[6] for r in rows], np.int64).view(np.uint64).reshape(len(rows), BITS, N_HASH // 64)
        bands = np.array([r[7] for r in rows], np.int64)
        sets = [np.frombuffer(r[8], "<u8") for r in rows]
        size = np.array([len(s) for s in sets])
        chunk = np.array([r[3] for r in rows])
        names: dict[int, int] = {}
        comp = np.array([names.setdefault(r[5], len(names)) for r in rows])
        root, table = list(range(len(names))), np.zeros(1 << 20, bool)

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        for i in range(len(rows)):
            if lo != hi and chunk[i] != lo:
                continue
            tops = np.array([find(c) for c in range(len(root))])[comp]
            j = np.nonzero((chunk == hi if lo != hi else np.arange(len(rows)) > i) & (tops != tops[i]))[0]
            j = j[100 * np.minimum(size[j], size[i]) >= percent * np.maximum(size[j], size[i])]
            j = j[np.bitwise_count(np.bitwise_or.reduce(planes[j] ^ planes[i], axis=1)).sum(axis=1) <= most_unequal + 1e-9]
            if len(j):
                same = bands[j] == bands[i]
                j = j[bands[i][same.argmax(axis=1)] == key]
            if not len(j):
                continue
            for b in j[_at_least(sets[i], [sets[b] for b in j], percent, table)].tolist():
                x, y = find(comp[i]), find(comp[b])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    yield rows[i][4], rows[b][4]

    def run(batches):
        import itertools

        enter("near_dup")
        flat = (tuple(x.as_py() for x in r) for b in batches for r in zip(*b.columns, strict=True))
        for _, rows in itertools.groupby(flat, lambda r: r[:3]):
            found = list(group(list(rows)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    return run
