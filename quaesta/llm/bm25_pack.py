"""Lexical retrieval packing over a sharded BM25 index (operator 6).

Documents are dealt to the shards of the index by content. A 64-bit key holds a document's cell (spherical
k-means over projected idf vectors) and its two winners of an idf-weighted minwise race over its
ids; cells and the race's weights are fitted on a bounded sample. One pass writes the token ids and keys of all rows
to shared storage and counts document frequencies beside; rows are partitioned by ranges of the key,
and each task cuts its sorted rows into shards of some million ids. So documents of one topic and language stand in neighbouring shards, copies in
one, at any size of the corpus, and no row is held by the driver. A shard is an inverted
index with corpus-wide statistics: full windows of long documents go out as they are,
every remainder in turn seeds a sequence, and its best unused neighbours of the shard, by BM25 over all
distinct terms of the seed, fill the window. The neighbour that no longer fits is cut, its rest staying
unused. At the end of a shard the last sequence is cut into lengths that are powers of two, which need no padding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import enter, mix64, put_file, settle, shared_dir, written
from .tokens import END_ID, default_vocabulary, load, token_batches

WINDOW = 2048
#: Ids and documents that close a shard; a shard is what a task holds.
SHARD_TOKENS, SHARD_DOCS = 1_000_000, 1 << 16
#: Ids of a task, and tasks at most: beyond, a task packs more shards, one after the other.
PART_TOKENS, MAX_PARTS = 4_000_000, 1 << 14
#: Documents that cells and race are fitted on at most; every document is dealt by them.
SAMPLE, CELLS, DIM = 4096, 16, 24
#: What is cut off a key for its range: 16 * 4096 ranges at most.
RANGE_SHIFT = 44
K1, B = 1.2, 0.75
#: Seeds whose scores over frequent terms are one matrix product, and numbers of a matrix at most.
BLOCK, MATRIX = 16, 1 << 23


def distinct(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The different ids, each once, unsorted; ``at`` is scratch space of the vocabulary's size."""
    n = np.arange(len(ids), dtype=np.int32)
    at[ids] = n
    return ids[at[ids] == n]


def inverse_frequency(df: np.ndarray, n: int) -> np.ndarray:
    return np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)


class Dealer:
    """Keys of documents: what is near by content is near by key."""

    def __init__(self, idf: np.ndarray):
        rng, size = np.random.default_rng(20240229), len(idf)
        self.axes = (rng.standard_normal((size, DIM)) * idf[:, None]).astype(np.float32)
        # an exponential race with weights: two documents share its winner as often as their weighted sets overlap
        self.race = (rng.exponential(size=size) / np.maximum(idf, 1e-6) ** 2).astype(np.float32)
        self.name = (mix64(np.arange(1, size + 1)) >> np.uint64(36)).astype(np.int64)
        self.centres = np.zeros((1, DIM), np.float32)

    def features(self, terms: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors of documents, given by their different ids, and the names of their races' two winners."""
        n = len(terms)
        size = np.array([len(t) for t in terms], np.int64)
        vectors, winners = np.zeros((n, DIM), np.float32), np.zeros(n, np.int64)
        some = np.nonzero(size)[0]
        if len(some):
            t, size = np.concatenate(terms), size[some]
            start = np.cumsum(size) - size
            v = np.add.reduceat(self.axes[t], start)
            vectors[some] = v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-9)
            race, name = self.race[t], []
            for _ in range(2):
                best = np.repeat(np.minimum.reduceat(race, start), size)
                at = np.maximum.reduceat(np.where(race == best, np.arange(len(t)), -1), start)
                name.append(self.name[t[at]])
                race[at] = np.inf
            winners[some] = name[0] << 28 | name[1]
        return vectors, winners

    def fit(self, vectors: np.ndarray) -> None:
        """Centres by spherical k-means from farthest-first starts."""
        if not len(vectors):
            return
        x, chosen = vectors.astype(np.float32), [0]
        near = x @ x[0]
        while len(chosen) < min(CELLS, len(x)):
            chosen.append(int(near.argmin()))
            near = np.maximum(near, x @ x[chosen[-1]])
        c = x[chosen]
        for _ in range(8):
            cell = (x @ c.T).argmax(axis=1)
            total = np.zeros_like(c)
            np.add.at(total, cell, x)
            length = np.sqrt((total * total).sum(axis=1, keepdims=True))
            c = np.where(length > 1e-9, total / np.maximum(length, 1e-9), c)
        # cells one after the other by likeness, so that a shard of several cells holds similar ones
        order, left = [0], list(range(1, len(c)))
        while left:
            left.sort(key=lambda i: float(c[i] @ c[order[-1]]))
            order.append(left.pop())
        self.centres = c[order]

    def keys(self, vectors: np.ndarray, winners: np.ndarray) -> np.ndarray:
        cell = (vectors @ self.centres.T).argmax(axis=1).astype(np.int64)
        return cell << 56 | winners


class Shard:
    """Inverted index of some documents: per term the documents and their BM25 weights. Terms that many documents hold are rows of a matrix."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        n, size = len(docs), len(idf)
        self.n, at = n, np.empty(size, np.int32)
        lengths = np.array([len(d) for d in docs], np.int64)
        code = np.repeat(np.arange(n, dtype=np.uint32), lengths) << np.uint32(16) | np.concatenate(docs)
        code.sort()
        first = np.nonzero(np.concatenate([[True], code[1:] != code[:-1]]))[0]
        tf = np.diff(np.append(first, len(code))).astype(np.float32)
        doc, term = (code[first] >> np.uint32(16)).astype(np.int32), (code[first] & np.uint32(0xFFFF)).astype(np.int32)
        self.own = np.split(term, np.cumsum(np.bincount(doc, minlength=n))[:-1])
        norm = (K1 * (1 - B + B * lengths / max(mean, 1e-9))).astype(np.float32)
        weight = idf[term] * (tf * np.float32(K1 + 1) / (tf + norm[doc]))
        df = np.bincount(term, minlength=size)
        often = np.argsort(-df, kind="stable")[: max(1, MATRIX // max(1, n))]
        often = often[df[often] > n / 32]
        self.row = np.full(size, -1, np.int32)
        self.row[often] = np.arange(len(often))
        dense = self.row[term] >= 0
        self.dense = np.zeros((len(often), n), np.float32)
        self.dense[self.row[term[dense]], doc[dense]] = weight[dense]
        doc, term, weight = doc[~dense], term[~dense], weight[~dense]
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=size))]).astype(np.int64)

    def frequent(self, seeds: np.ndarray) -> np.ndarray:
        """Scores of all documents for the seeds' frequent terms."""
        q = np.zeros((len(seeds), len(self.dense)), np.float32)
        for i, s in enumerate(seeds):
            r = self.row[self.own[s]]
            q[i, r[r >= 0]] = 1.0
        return q @ self.dense

    def add_rare(self, seed: int, score: np.ndarray) -> np.ndarray:
        """``score`` with what the seed's other terms add."""
        t = self.own[seed]
        start, size = self.first[t], self.first[t + 1] - self.first[t]
        end = np.cumsum(size)
        if len(t) and end[-1]:
            at = np.repeat(start - end + size, size) + np.arange(end[-1])
            score += np.bincount(self.doc[at], self.weight[at], self.n)
        return score

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document over all distinct terms of the seed."""
        return self.add_rare(seed, self.frequent(np.array([seed]))[0])


def pack(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW, filled: list | None = None):
    """Yield ``(sequence, doc, start, length, offset)`` for the documents of one shard; ``filled`` takes the ids placed by retrieval and in all beside seeds."""
    sizes = np.array([len(d) for d in docs], np.int64)
    at = sizes // window * window  # where each document's unused rest starts
    rest, seq = sizes - at, 0
    for d in np.nonzero(at)[0]:
        for start in range(0, int(at[d]), window):
            yield seq, int(d), start, window, 0
            seq += 1
    if not rest.any():
        return
    index, free = Shard(docs, idf, mean), rest > 0
    ready: dict[int, np.ndarray] = {}
    block = max(1, min(BLOCK, MATRIX // len(docs)))
    for seed in range(len(docs)):
        if not free[seed]:
            continue
        chosen, room = [(seed, int(rest[seed]))], window - int(rest[seed])
        free[seed] = False
        score = None
        if room:
            if seed not in ready:
                todo = np.concatenate([[seed], np.nonzero(free[seed + 1 :])[0][: block - 1] + seed + 1])
                ready = dict(zip(todo.tolist(), index.frequent(todo), strict=True))
            score = np.where(free, index.add_rare(seed, ready.pop(seed)), np.float32(0))
        while room and score is not None:
            d = int(score.argmax())
            if score[d] <= 0:
                score = None
                break
            score[d] = 0
            size = min(room, int(rest[d]))
            chosen.append((d, size))
            free[d], room = False, room - size
        found = len(chosen)
        if room:  # nothing unused shares a term with the seed: the next ones by content
            for d in np.nonzero(free)[0]:
                size = min(room, int(rest[d]))
                chosen.append((int(d), size))
                free[d], room = False, room - size
                if not room:
                    break
        if filled is not None:
            filled.append((sum(s for _, s in chosen[1:found]), sum(s for _, s in chosen[1:])))
        if room:
            yield from _tail(seq, [d for d, _ in chosen], at, rest)
            return
        offset = 0
        for d, size in chosen:
            yield seq, d, int(at[d]), size, offset
            at[d], rest[d], offset = at[d] + size, rest[d] - size, offset + size
        last = chosen[-1][0]
        if rest[last]:
            free[last] = True  # the one that was cut stays unused: it comes after its seed, as all unused ones do
        seq += 1


def _tail(seq: int, docs: list[int], at, rest):
    """The last tokens of a shard, fewer than a window, as sequences whose lengths are powers of two."""
    left, room, offset = int(sum(rest[d] for d in docs)), 0, 0
    seq -= 1
    for d in docs:
        while rest[d]:
            if not room:
                room, seq, offset = 1 << (left.bit_length() - 1), seq + 1, 0
            size = min(room, int(rest[d]))
            yield seq, d, int(at[d]), size, offset
            at[d], rest[d], room, offset, left = at[d] + size, rest[d] - size, room - size, offset + size, left - size


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _terms(path: str, end_id: int):
    """Different ids of documents."""

    def run(batches):
        at = np.empty(load(path).size, np.int32)
        for batch in token_batches(path, end_id)(batches):
            yield pa.RecordBatch.from_arrays([pa.array([distinct(np.frombuffer(x.as_py(), "<u2"), at).tobytes() for x in batch.column(1)], pa.binary())], ["terms"])

    return run


def _tokens(path: str, end_id: int, dealer, folder: str):
    """Ids, their number and the key of each row; the task's document frequencies go to a file of its own."""

    def run(batches):
        from pyspark import TaskContext

        size, part = load(path).size, TaskContext.get().partitionId()
        at, df = np.empty(size, np.int32), np.zeros(size + 2, np.int64)  # rows and ids last
        for batch in token_batches(path, end_id)(batches):
            ids = [np.frombuffer(x.as_py(), "<u2") for x in batch.column(1)]
            terms = [distinct(x, at) for x in ids]
            n = np.array([len(x) for x in ids], np.int64)
            for t in terms:
                df[t] += 1
            df[size:] += len(ids), n.sum()
            key = dealer.value.keys(*dealer.value.features(terms))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(key)], ["doc_id", "ids", "n", "key"])
        raw = zstandard.ZstdCompressor().compress(df.tobytes())
        put_file(f"{folder}/df-{part:07d}.bin", lambda out: out.write(raw))

    return run


def _sum_files(batches):
    total = 0
    for batch in batches:
        for x in batch.column(0):
            total = total + np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py()), np.int64)
    if not isinstance(total, int):
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])


def tokenised(rows: DataFrame, path: str, end_id: int) -> tuple[DataFrame, np.ndarray, int, int]:
    """``row, doc_id, ids, n, key`` of all rows, written; document frequency per id, rows, ids."""
    spark, size = rows.sparkSession, load(path).size
    many = rows.count()
    sample = rows if many <= SAMPLE else rows.sample(0.95 * SAMPLE / many, seed=20240229)
    terms = [np.frombuffer(bytes(r["terms"]), "<u2") for r in sample.mapInArrow(_terms(path, end_id), "terms binary").collect()]
    dealer = Dealer(inverse_frequency(np.bincount(np.concatenate([*terms, np.empty(0, "<u2")]), minlength=size), len(terms)))
    dealer.fit(dealer.features(terms)[0])
    folder = shared_dir(spark)
    tokens = rows.mapInArrow(_tokens(path, end_id, spark.sparkContext.broadcast(dealer), folder), "doc_id long, ids binary, n long, key long")
    tokens = written(tokens.withColumn("row", F.monotonically_increasing_id()), "tokens")
    df = np.zeros(size + 2, np.int64)
    if many:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "df-*.bin").load(folder).select("content")
        for r in files.mapInArrow(_sum_files, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
            df[r["term"]] = r["n"]
    return tokens, df[:size], int(df[size]), int(df[size + 1])


def dealt(tokens: DataFrame, total: int) -> DataFrame:
    """``part, doc_id, ids``, partitioned by ranges of the content key and sorted by it. A range too large for one task is dealt to several."""
    ranges = F.shiftright("key", RANGE_SHIFT)
    found = sorted((r["range"], r["n"]) for r in tokens.groupBy(ranges.alias("range")).agg(F.sum("n").alias("n")).collect())  # one row a range
    most, table, part, held = max(PART_TOKENS, -(-total // MAX_PARTS)), [], 0, 0
    for x, n in found:
        splits = max(1, round(n / most))
        if held and (splits > 1 or held + n > most):
            part, held = part + 1, 0
        table.append((x, part, splits))
        if splits > 1:
            part += splits
        else:
            held += n
    parts = part + 1
    shown = tokens.sparkSession.createDataFrame(table, "range long, first int, splits int")
    placed = tokens.withColumn("range", ranges).join(F.broadcast(shown), "range")
    placed = placed.select((F.col("first") + F.pmod(F.xxhash64("doc_id", "row"), F.col("splits"))).cast("int").alias("part"), "key", "doc_id", "row", "ids")
    return placed.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "key", "doc_id", "row").select("part", "doc_id", "ids")


def _pack_shards(stats, window: int):
    def run(batches):
        enter("pack")
        idf, mean = stats.value
        names, docs, held, base, used = [], [], 0, 0, 0

        def flush():
            nonlocal used
            rows, most = [], 0
            for seq, d, start, length, offset in pack(docs, idf, mean, window):
                rows.append((names[d], start, length, docs[d][start : start + length].astype("<u4").tobytes(), len(docs[d]), base + used + seq, offset))
                most = max(most, seq + 1)
            used += most
            for i in range(0, len(rows), 2048):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if j == 3 else pa.int64()) for j, c in enumerate(zip(*rows[i : i + 2048], strict=True))], [x.split()[0] for x in PIECES.split(", ")])

        for batch in batches:
            for p, name, x in zip(*batch.columns, strict=True):
                if not docs:
                    base = p.as_py() << 32
                names.append(name.as_py()), docs.append(np.frombuffer(x.as_py(), "<u2"))
                held += len(docs[-1])
                if held >= SHARD_TOKENS or len(docs) >= SHARD_DOCS:
                    yield from flush()
                    names, docs, held = [], [], 0
        if docs:
            yield from flush()
        settle()

    return run


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, window: int = WINDOW, end_id: int = END_ID
) -> DataFrame:
    """Pieces of all rows: ``doc_id, start, length, ids (little-endian u32), doc_tokens, sequence_id, offset``.

    Every id of a row, the end id included, lies in exactly one piece. A null or empty
    text is its end id. Rows with a null or repeated id are packed each on their own. Neighbours of equal score go
    by their order in the shard. A text of any length is held whole by one task, as its ids; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    path = vocabulary or default_vocabulary()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tokens, df, n, total = tokenised(rows, path, end_id)
    if not n:
        return spark.createDataFrame([], PIECES)
    shared = spark.sparkContext.broadcast((inverse_frequency(df, n), total / n))  # one number for each vocabulary id
    return dealt(tokens, total).mapInArrow(_pack_shards(shared, window), PIECES)
