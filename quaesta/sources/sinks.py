"""Chunk lines and evaluation reports."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame


def write_chunks(chunks: DataFrame, path: str, single_file: bool = False) -> None:
    """One JSON object a line, nulls written; ``single_file`` for small corpora only."""
    (chunks.coalesce(1) if single_file else chunks).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_report(report: dict, path: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2, ensure_ascii=False, default=str)
