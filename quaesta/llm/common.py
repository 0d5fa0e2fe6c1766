"""What the training-data operators share: table access, shared storage, word rules."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark alone (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; on a local master, and only there, a local one where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not root:
        root = getattr(spark, "_quaesta_shared", None)
        if root is None:
            root = "file://" + tempfile.mkdtemp(prefix="quaesta-")
            spark._quaesta_shared = root
    return f"{root.rstrip('/')}/quaesta-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """The rows of ``df``, written once to shared storage: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def arrow_fs(uri: str):
    """pyarrow file system and path of a shared folder, for writers on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and "://" not in uri else uri)


def put_file(uri: str, write: Callable[[object], None]) -> None:
    """Write under a name of this attempt, then move: a file under its final name is whole.

    Attempts of one task write the same bytes, so whichever moves last changes nothing.
    """
    system, path = arrow_fs(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    part = os.path.join(os.path.dirname(path), f"_{os.path.basename(path)}.{uuid.uuid4().hex}")
    with system.open_output_stream(part) as out:
        write(out)
    system.move(part, path)


#: Caches that a worker keeps between tasks: operator -> what empties them.
CACHES: dict[str, Callable[[], None]] = {}
_OWNER: list[str | None] = [None]


def settle() -> None:
    """Give memory that is free back to the system; a worker lives through many stages."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def enter(name: str) -> None:
    """To be called where an operator's work in a task starts: caches of other operators are emptied."""
    if _OWNER[0] != name:
        _OWNER[0] = name
        for owner, empty in CACHES.items():
            if owner != name:
                empty()
        settle()


def space_words(text: str) -> list[bytes]:
    """A-Z lowered, cut at U+0020 and U+0009-000D; as UTF-8, where both rules are byte rules."""
    return text.encode("utf-8", "surrogatepass").lower().split()


_ALNUM = bytes(
    (c + 32 if 65 <= c <= 90 else c) if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32
    for c in range(256)
)


def alnum_words(text: str) -> list[bytes]:
    """A-Z lowered, runs of ASCII letters, digits and anything from U+0080 on; as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_ALNUM).split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit of a 64-bit value."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
