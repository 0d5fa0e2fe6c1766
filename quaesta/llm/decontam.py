"""Benchmark decontamination over a positional inverted index (operator 5).

The index is a table of segments in shared storage, written in one pass and without a
shuffle: each holds the sorted terms of up to two million training tokens and, per
term, the positions where it occurs. Documents follow each other with a gap, so a phrase
never crosses two. A test window is looked up in every segment: windows with a term
that is absent go at once, the others intersect their lists, each shifted by the
term's offset in the window, from the rarest term on. With a slop a window is near
where from some start every term is at most that far off its place; the same
intersection finds these, and among them the exact ones.

Segments have bounded size whatever a term's frequency; test items travel by broadcast
in passes of bounded bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, enter, settle, written

WINDOW = 10
#: Tokens after which a segment ends (at most one document more).
SEGMENT_TOKENS = 2_000_000
#: Positions left free between documents; a window and twice a slop are shorter.
GAP = 64
#: Bytes of test items in one pass: what a broadcast holds.
PASS_BYTES = 32 << 20


class _Ids(dict):
    def __missing__(self, term: bytes) -> int:
        value = self[term] = len(self)
        return value


class _Segment:
    """Terms and positions of the documents added so far."""

    def __init__(self):
        self.ids, self.docs, self.starts, self.words, self.tokens, self.places, self.next = _Ids(), [], [], [], [], [], 0

    def add(self, doc_id, text: str | None) -> None:
        words = alnum_words(text or "")
        self.docs.append(doc_id), self.starts.append(self.next), self.words.append(len(words))
        if words:
            self.tokens.append(np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
            self.places.append(np.arange(self.next, self.next + len(words), dtype=np.uint32))
        self.next += len(words) + GAP

    def row(self):
        terms = sorted(self.ids)
        rank = np.empty(len(terms), np.int32)
        rank[[self.ids[t] for t in terms]] = np.arange(len(terms), dtype=np.int32)
        token = rank[np.concatenate(self.tokens)] if terms else np.empty(0, np.int32)
        place = np.concatenate(self.places) if terms else np.empty(0, np.uint32)
        counts = np.bincount(token, minlength=len(terms)).astype(np.uint32)
        lists = place[np.argsort(token, kind="stable")]
        first = np.cumsum(counts, dtype=np.int64) - counts
        delta = np.diff(lists, prepend=np.uint32(0))
        delta[first] = lists[first]
        return self.docs, self.starts, self.words, b"\n".join(terms), counts.tobytes(), delta.tobytes()


INDEX_SCHEMA = "segment long, docs array<long>, starts array<long>, words array<long>, terms binary, counts binary, postings binary"
_INDEX_TYPES = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]


def _build(batches):
    from pyspark import TaskContext

    enter("decontam")
    part, n, seg = TaskContext.get().partitionId(), 0, _Segment()

    def out():
        row = (part << 32 | n, *seg.row())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _INDEX_TYPES, strict=True)], [x.split()[0] for x in INDEX_SCHEMA.split(", ")])

    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            seg.add(doc.as_py(), text.as_py())
            if seg.next >= SEGMENT_TOKENS + GAP * len(seg.docs):
                yield out()
                n, seg = n + 1, _Segment()
    if seg.docs:
        yield out()
    del seg
    settle()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index of all rows, as a written table of segments."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(_build, INDEX_SCHEMA), "index")


class Queries:
    """Test windows: distinct terms, and per window its terms' numbers and its items."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        ids, rows, self.names = _Ids(), {}, []
        for item, text in items:
            words = [ids[w] for w in alnum_words(text or "")]
            if not words:
                continue
            name = "null" if item is None else str(item)
            for i in range(max(1, len(words) - window + 1)):
                rows.setdefault(tuple(words[i : i + window]), set()).add(name)
        self.terms = list(ids)
        by_len: dict[int, list] = {}
        for key, names in rows.items():
            by_len.setdefault(len(key), []).append((key, tuple(sorted(names))))
        #: per window length: the windows as a matrix of term numbers, and the items of each
        self.blocks = [(np.array([k for k, _ in v], np.int32), [n for _, n in v]) for _, v in sorted(by_len.items())]


def _lists(terms: bytes, counts: bytes, postings: bytes, wanted: list[bytes]):
    """Per wanted term its count in the segment, and a reader of its positions."""
    count, delta = np.frombuffer(counts, np.uint32), np.frombuffer(postings, np.uint32)
    first = np.cumsum(count, dtype=np.int64) - count
    of = {t: i for i, t in enumerate(terms.split(b"\n"))} if len(count) else {}
    at = np.array([of.get(t, -1) for t in wanted], np.int64)
    have = np.where(at >= 0, count[np.maximum(at, 0)], 0) if len(count) else np.zeros(len(wanted), np.int64)
    cache: dict[int, np.ndarray] = {}

    def positions(q: int) -> np.ndarray:
        if q not in cache:
            i = at[q]
            cache[q] = np.cumsum(delta[first[i] : first[i] + count[i]], dtype=np.int64)
        return cache[q]

    return have, positions


def match_segment(terms: bytes, counts: bytes, postings: bytes, queries: Queries, slop: int = 0):
    """``(exact, near)``: lists of ``(items, length, starts)`` with the positions where windows occur."""
    have, positions = _lists(terms, counts, postings, queries.terms)
    exact, near = [], []
    for windows, items in queries.blocks:
        seen = have[windows]
        for w in np.nonzero(seen.min(axis=1) > 0)[0]:
            order = np.argsort(seen[w], kind="stable")
            anchor = positions(windows[w, order[0]]) - order[0]
            if slop:  # every start from which the rarest term is near enough to its place
                anchor = np.unique(anchor[:, None] + np.arange(-slop, slop + 1))
            for o in order[1:]:
                found = positions(windows[w, o])
                want = anchor + o
                i = np.searchsorted(found, want - slop)
                ok = i < len(found)
                ok[ok] = found[i[ok]] <= want[ok] + slop
                anchor = anchor[ok]
                if not len(anchor):
                    break
            if not len(anchor):
                continue
            sure = anchor
            for o in order if slop else ():
                found, want = positions(windows[w, o]), sure + o
                i = np.searchsorted(found, want)
                ok = i < len(found)
                ok[ok] = found[i[ok]] == want[ok]
                sure = sure[ok]
            if len(sure):
                exact.append((items[w], windows.shape[1], sure))
            if slop:
                near.append((items[w], windows.shape[1], anchor))
    return exact, near


def _match(queries, slop: int):
    names = ["segment", "ordinal", "doc_id", "n_words", "n_hit", "hits", "items", "near"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string())]

    def run(batches):
        enter("decontam")
        q = queries.value
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                seg, docs, starts, words, terms, counts, postings = (x.as_py() for x in row)
                exact, near = match_segment(terms, counts, postings, q, slop)
                at = np.array(starts, np.int64)
                # a near match may start a little before its document
                below = at - GAP // 2
                spans: dict[int, list] = {}
                items: dict[int, set] = {}
                close: dict[int, set] = {}
                for found, into in ((exact, items), (near, close)):
                    for of, size, where in found:
                        doc = np.searchsorted(below, where, side="right") - 1
                        for d in np.unique(doc):
                            into.setdefault(int(d), set()).update(of)
                            if into is items:
                                begin = where[doc == d] - at[d]
                                spans.setdefault(int(d), []).append(np.stack([begin, begin + size], 1))
                hits = [_merge(np.concatenate(spans[d])) if d in spans else _NONE for d in range(len(docs))]
                columns = (
                    [seg] * len(docs), range(len(docs)), docs, words, [_covered(h) for h in hits], [h.astype("<u4").tobytes() for h in hits],
                    [sorted(items.get(d, ())) for d in range(len(docs))], [sorted(close.get(d, set()) - items.get(d, set())) for d in range(len(docs))],
                )
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types, strict=True)], names)
        settle()

    return run


def _merge(spans: np.ndarray) -> np.ndarray:
    """The union of half-open spans, sorted."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    end = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > end[:-1]])
    last = np.concatenate([np.nonzero(new)[0][1:] - 1, [len(spans) - 1]])
    return np.stack([spans[new, 0], end[last]], 1)


_NONE = np.empty((0, 2), np.int64)


def _covered(spans: np.ndarray) -> int:
    return int((spans[:, 1] - spans[:, 0]).sum())


def _joined(pdf):
    """Matches of one document from several passes."""
    import pandas as pd

    spans = [np.frombuffer(h, "<u4").reshape(-1, 2).astype(np.int64) for h in pdf["hits"] if len(h)]
    items = {x for v in pdf["items"] for x in v}
    row, hits = pdf.iloc[0], _merge(np.concatenate(spans)) if spans else _NONE
    return pd.DataFrame([{
        "segment": row["segment"], "ordinal": row["ordinal"], "doc_id": row["doc_id"], "n_words": row["n_words"],
        "n_hit": _covered(hits), "hits": hits.astype("<u4").tobytes(), "items": sorted(items),
        "near": sorted({x for v in pdf["near"] for x in v} - items),
    }])


MATCH_SCHEMA = "segment long, ordinal long, doc_id long, n_words long, n_hit long, hits binary, items array<string>, near array<string>"


def find_matches(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, slop: int = 0) -> DataFrame:
    """Per indexed row its spans (pairs of little-endian u32 word positions, merged), the items with exact windows, and those near only."""
    if not 0 <= slop < GAP // 4 or window > GAP // 4:
        raise ValueError(f"slop is below and window at most {GAP // 4}")
    spark = index.sparkSession
    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    passes = 1 + int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PASS_BYTES
    out = None
    for p in range(passes):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == p) if passes > 1 else rows
        q = spark.sparkContext.broadcast(Queries([(r["item"], r["text"]) for r in part.collect()], window))
        found = index.mapInArrow(_match(q, slop), MATCH_SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out if passes == 1 else written(out, "matches").groupBy("segment", "ordinal").applyInPandas(_joined, MATCH_SCHEMA)


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, slop: int = 0,
) -> DataFrame:
    """Per input row ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` and ``n_near``.

    Texts without words have zeroes; items without words occur nowhere; items with one id are one item; a null item id
    is the item ``null``. Repeated rows are each returned; other columns are ignored; an empty table gives no rows, no items no hits.
    ``n_near``: items with a window within the slop and none exact.
    """
    found = find_matches(build_index(docs, id_col, text_col), items, item_col, item_text_col, window, slop)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.octet_length("hits") > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near"),
    )


def items_digest(items: list[str]) -> str:
    """What ``items_sha256`` holds, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
