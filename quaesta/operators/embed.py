"""Embedders: a column function each for passages and queries."""

from __future__ import annotations

import hashlib
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import evaluation_form

PASSAGE, QUERY = "passage: ", "query: "


class Embedder(Protocol):
    dimensions: int

    def passages(self, text: Column) -> Column: ...
    def queries(self, text: Column) -> Column: ...


class HashingEmbedder:
    """Deterministic feature hashing of words and word pairs, L2-normalised; for runs without a model.

    Its ranking quality is not that of a trained model.
    """

    def __init__(self, dimensions: int = 768):
        self.dimensions = dimensions
        size = dimensions

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def embed(texts: pd.Series) -> pd.Series:
            def one(t):
                if t is None:
                    return None
                words = evaluation_form(t.split(": ", 1)[1]).split()
                v = np.zeros(size)
                for f in (*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))):
                    h = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "little")
                    v[h % size] += 1.0 if h >> 63 else -1.0
                n = np.linalg.norm(v)
                return (v / n if n else v).tolist()

            return texts.map(one)

        self._embed = embed

    def passages(self, text: Column) -> Column:
        return self._embed(F.concat(F.lit(PASSAGE), text))

    def queries(self, text: Column) -> Column:
        return self._embed(F.concat(F.lit(QUERY), text))


_MODELS: dict[str, object] = {}


class SentenceEmbedder:
    """A sentence-transformers model, loaded once a worker; needs that library and the model's files."""

    def __init__(self, model: str = "intfloat/multilingual-e5-base", dimensions: int = 768, batch: int = 32):
        import sentence_transformers  # noqa: F401

        self.dimensions = dimensions

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def embed(texts: pd.Series) -> pd.Series:
            from sentence_transformers import SentenceTransformer

            m = _MODELS.setdefault(model, None) or _MODELS.update({model: SentenceTransformer(model)}) or _MODELS[model]
            return pd.Series(m.encode(texts.tolist(), batch_size=batch, normalize_embeddings=True).tolist())

        self._embed = embed

    def passages(self, text: Column) -> Column:
        return self._embed(F.concat(F.lit(PASSAGE), text))

    def queries(self, text: Column) -> Column:
        return self._embed(F.concat(F.lit(QUERY), text))
