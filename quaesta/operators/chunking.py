"""Sections of Markdown bodies and chunks of sections: one Arrow function over each document's own text, linear in its lines, and no shuffle."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CHUNK_MAX_CHARACTERS, CHUNK_OVERLAP_CHARACTERS
from ..functions import text as tx
from ..schema import CHUNK_COLUMNS

_HEADING = re.compile(tx.HEADING)
_WS = re.compile(f"[{tx.WS}]+")
_BLANK = "".join(c for c in map(chr, range(0x3001)) if _WS.fullmatch(c))
_SECTION = T.StructType([T.StructField("title", T.StringType()), T.StructField("path", T.ArrayType(T.StringType())), T.StructField("content", T.StringType())])
_CHUNK = T.StructType([T.StructField("title", T.StringType()), T.StructField("path", T.ArrayType(T.StringType())), T.StructField("text", T.StringType())])


def sections(body: str) -> list[tuple[str, list[str], str]]:
    """``(title, path, content)`` of each heading whose body is not blank; what precedes the first heading is left out.

    A heading's path are the headings before it that no later heading of its own or a higher rank has closed, and itself.
    """
    found, open_, lines = [], [], body.splitlines()
    held: list[tuple[int, list[str]]] = []
    for i, line in enumerate(lines):
        h = _HEADING.match(line) if line.startswith("#") else None
        if h:
            level = len(h[1])
            while open_ and open_[-1][0] >= level:
                open_.pop()
            open_.append((level, h[2]))
            held.append((i, [t for _, t in open_]))
    ends = [*(i for i, _ in held[1:]), len(lines)]
    for (i, path), end in zip(held, ends, strict=False):
        content = "\n".join(lines[i + 1 : end]).strip(_BLANK)
        if content:
            found.append((path[-1], path, content))
    return found


@F.pandas_udf(T.ArrayType(_SECTION))
def _sections(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda b: None if b is None else [dict(zip(("title", "path", "content"), s, strict=True)) for s in sections(b)])


def with_sections(docs: DataFrame, body: Column, name: str) -> DataFrame:
    """``docs`` with an array of ``(title, path, content)``: the body under each heading (see ``sections``); null for a null body."""
    return docs.withColumn(name, _sections(body))


def split_words(text: str, most: int = CHUNK_MAX_CHARACTERS, overlap: int = CHUNK_OVERLAP_CHARACTERS) -> list[str]:
    """Chunks of normalised text: as many whole words as fit, each next one starting with the last words that fit the overlap.

    With the words' end positions in a prefix sum, each boundary is one binary search.
    """
    words = text.split(" ")
    at = [0, *accumulate(len(w) + 1 for w in words)]
    n = len(words)
    if at[n] - 1 <= most:
        return [text]
    out, start = [], 0
    while True:
        end = max(start + 1, bisect_right(at, at[start] + most + 1) - 1)
        out.append(" ".join(words[start:end]))
        if end >= n:
            return out
        again = min(bisect_left(at, at[end] - 1 - overlap), end)
        start = end if again <= start else again


def splitter(most: int, overlap: int):
    if most < 1 or overlap < 0:
        raise ValueError("a chunk has characters, an overlap is not negative")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else split_words(t, most, overlap))

    return split


def chunker(most: int, overlap: int):
    """A column function: body to the chunks of all its sections, in order; each starts from its section's path and text, white space normalised."""

    @F.pandas_udf(T.ArrayType(_CHUNK))
    def chunks(bodies: pd.Series) -> pd.Series:
        def one(body):
            out = []
            for title, path, content in sections(body or ""):
                text = _WS.sub(" ", " > ".join(path) + "\n\n" + content).strip(" ")
                out += [{"title": title, "path": path, "text": part} for part in split_words(text, most, overlap)]
            return out

        return bodies.map(one)

    return chunks


def chunk_documents(docs: DataFrame, most: int = CHUNK_MAX_CHARACTERS, overlap: int = CHUNK_OVERLAP_CHARACTERS) -> DataFrame:
    """Chunks (16 columns) of documents with metadata columns and ``raw_text``; a document without a usable section fails.

    The running number counts a document's chunks over all its sections.
    """
    if most < 1 or overlap < 0:
        raise ValueError("a chunk has characters, an overlap is not negative")
    found = docs.withColumn("__c", chunker(most, overlap)("raw_text"))
    none = F.raise_error(F.concat(F.lit("no Markdown section with content in "), F.col("document_id"))).cast("boolean")
    found = found.where(F.when(F.size("__c") > 0, F.lit(True)).otherwise(none))
    found = found.select("*", F.posexplode("__c").alias("__i", "__p"))
    return found.select(
        F.concat_ws(":", "document_id", tx.slugify(F.array_join("__p.path", "-")), F.format_string("%03d", F.col("__i"))).alias("chunk_id"),
        "document_id", F.col("title").alias("document_name"), "document_type", "coverage", "jurisdiction", "language", "version", "effective_date",
        F.col("__p.title").alias("section_title"), F.col("__p.path").alias("section_path"), F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"),
        F.col("__i").alias("chunk_index"), F.col("__p.text").alias("text"), tx.content_hash(F.col("__p.text")).alias("content_hash"),
    ).select(*CHUNK_COLUMNS)
