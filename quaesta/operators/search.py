"""Filtered top-k search by cosine, for batches of queries.

Queries go in blocks of a bounded number, each broadcast; every partition of the index
keeps its best k for each query (matrix products over Arrow batches), and one window
over those candidates ranks. The index is never shuffled, only k rows a query and partition are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import FILTER_FIELDS, MIN_RETRIEVAL_SCORE, TOP_K
from ..schema import HIT_COLUMNS

#: Queries in one block: what a broadcast holds.
BLOCK = 2000
#: Decimals of a score: products of one pair of vectors differ by less, whatever the batch.
DIGITS = 12
#: Hits whose ids are broadcast to the index at most.
BROADCAST_HITS = 1_000_000


def _best(block):
    def run(batches):
        ids, vectors, sizes, filters, tops, least = block.value
        q = vectors / np.maximum(np.sqrt((vectors * vectors).sum(axis=1, keepdims=True)), 1e-300)
        groups: dict[tuple, list[int]] = {}
        for i, f in enumerate(filters):
            groups.setdefault(f, []).append(i)
        best: list[list[tuple[float, str]]] = [[] for _ in ids]
        for batch in batches:
            flat = batch.column(1)
            keep = pc.fill_null(pc.equal(pc.list_value_length(flat), sizes), False)
            held = flat.filter(keep)
            if not len(held):
                continue
            keep = keep.to_numpy(zero_copy_only=False)
            names = np.array(batch.column(0).to_pylist(), object)[keep]
            # a null number becomes NaN, and its vector has no finite norm
            x = held.flatten().to_numpy(zero_copy_only=False).reshape(-1, sizes)
            norm = np.sqrt((x * x).sum(axis=1))
            fields = [np.array(batch.column(2 + j).to_pylist(), object)[keep] for j in range(len(FILTER_FIELDS))]
            for f, members in groups.items():
                ok = (norm > 0) & np.isfinite(norm)
                for value, column in zip(f, fields, strict=True):
                    if value is not None:
                        ok &= column == value
                at = np.nonzero(ok)[0]
                if not len(at):
                    continue
                scores = np.clip(np.round(q[members] @ (x[at] / norm[at, None]).T, DIGITS), -1.0, 1.0)
                for row, i in zip(scores, members, strict=True):
                    k = tops[i]
                    floor = max(least, best[i][-1][0]) if len(best[i]) >= k else least
                    hit = np.nonzero(row >= floor)[0]
                    if len(hit) > k:
                        hit = hit[row[hit] >= np.partition(row[hit], len(hit) - k)[len(hit) - k]]
                    if len(hit):
                        best[i] = sorted([*best[i], *((float(row[h]), names[at[h]]) for h in hit)], key=lambda t: (-t[0], t[1]))[:k]
        rows = [(ids[i], n, s) for i, b in enumerate(best) for s, n in b]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.float64()), strict=True)], ["query_id", "chunk_id", "score"])

    return run


def ranked_ids(queries: DataFrame, index: DataFrame, min_score: float = MIN_RETRIEVAL_SCORE, top_k: int = TOP_K) -> DataFrame:
    """``query_id, chunk_id, score, rank``: the best ``top_k`` (a query's own, where it has the column) from ``min_score`` on.

    ``queries``: ``query_id``, ``embedding``, any of the five filter columns, ``top_k``. A null filter is none. Ties go by chunk id.
    Zero vectors have no score. Queries of another dimension than the first fail.
    """
    spark = queries.sparkSession
    have = queries.columns
    q = queries.select(
        F.col("query_id").cast("string").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"),
        *(F.col(f) if f in have else F.lit(None).cast("string").alias(f) for f in FILTER_FIELDS), (F.col("top_k") if "top_k" in have else F.lit(top_k)).cast("int").alias("top_k"),
    )
    fields = index.columns
    rows = index.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding"), *(F.col(f) if f in fields else F.lit(None).cast("string").alias(f) for f in FILTER_FIELDS))
    out, block = None, []

    def search(part):
        size = len(part[0]["embedding"])
        if any(len(r["embedding"]) != size for r in part):
            raise ValueError("query vectors have several dimensions")
        shared = spark.sparkContext.broadcast(
            ([r["query_id"] for r in part], np.array([r["embedding"] for r in part], np.float64), size, [tuple(r[f] for f in FILTER_FIELDS) for r in part], [r["top_k"] for r in part], min_score)
        )
        found = rows.mapInArrow(_best(shared), "query_id string, chunk_id string, score double")
        limits = q.select("query_id", "top_k")
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
        return found.withColumn("rank", F.row_number().over(w)).join(limits, "query_id").where("rank <= top_k").drop("top_k")

    for r in q.toLocalIterator():
        block.append(r)
        if len(block) == BLOCK:
            out, block = (search(block) if out is None else out.unionByName(search(block))), []
    if block:
        out = search(block) if out is None else out.unionByName(search(block))
    return out if out is not None else spark.createDataFrame([], "query_id string, chunk_id string, score double, rank int")


def search(queries: DataFrame, index: DataFrame, min_score: float = MIN_RETRIEVAL_SCORE, top_k: int = TOP_K) -> DataFrame:
    """Hits with the passages' columns (14 and ``query_id``)."""
    ids = ranked_ids(queries, index, min_score, top_k)
    most = queries.agg(F.sum("top_k").alias("n") if "top_k" in queries.columns else (F.count("*") * top_k).alias("n")).first()["n"] or 0
    # few hits meet the index where it is; many are shuffled with it
    return (F.broadcast(ids) if most <= BROADCAST_HITS else ids).join(index.drop("score", "rank"), "chunk_id").select("query_id", *HIT_COLUMNS)


def results(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """``query_id, results, retrieval_sufficient``: every query, its hits in rank order."""
    fields = [c for c in hits.columns if c != "query_id"]
    order = ["rank", *(c for c in fields if c != "rank")]
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("results"))
    empty = F.array().cast(lists.schema["results"].dataType)
    out = queries.select(F.col("query_id").cast("string").alias("query_id")).join(lists, "query_id", "left")
    return out.select("query_id", F.coalesce("results", empty).alias("results"), F.col("results").isNotNull().alias("retrieval_sufficient"))
