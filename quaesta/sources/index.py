"""The chunk index: numbered versions of Parquet below one folder; the highest whole one counts.

A version is whole when Spark has committed it (its ``_SUCCESS`` file), so readers see all of a write or nothing, and a
writer that dies leaves the version before. The version before the current one stays for readers that are at it, older ones and remains go.
There is one writer at a time. The folder may be in any Hadoop file system.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EMBEDDING_DIMENSIONS, KNOWLEDGE_BASE_VERSION
from ..functions.vectors import l2_normalize, point_id, require_dimension
from ..schema import CHUNK


class IndexMissing(RuntimeError):
    """No version of the index exists."""


class ChunkIndex:
    def __init__(self, spark: SparkSession, folder: str, name: str = KNOWLEDGE_BASE_VERSION, dimensions: int = EMBEDDING_DIMENSIONS):
        self.spark, self.root, self.name, self.dimensions = spark, f"{folder.rstrip('/')}/{name}", name, dimensions

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _versions(self) -> list[tuple[int, str, bool]]:
        """``(number, name, whole)`` of the versions, in order."""
        fs, path = self._fs()
        if not fs.exists(path(self.root)):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path(self.root)) if f.getPath().getName().startswith("v-")]
        return sorted((int(n.split("-")[1]), n, fs.exists(path(f"{self.root}/{n}/_SUCCESS"))) for n in names)

    def _version(self) -> str | None:
        whole = [n for _, n, ok in self._versions() if ok]
        return whole[-1] if whole else None

    def _write(self, df: DataFrame) -> None:
        before = self._versions()
        number = max((k for k, *_ in before), default=0) + 1
        df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.root}/v-{number:012d}-{uuid.uuid4().hex[:8]}")
        fs, path = self._fs()
        kept = [n for _, n, ok in before if ok][-1:]
        for _, name, _ in before:
            if name not in kept:
                fs.delete(path(f"{self.root}/{name}"), True)

    @property
    def schema(self) -> str:
        return CHUNK + ", point_id string, embedding array<double>"

    def recreate(self) -> None:
        self._write(self.spark.createDataFrame([], self.schema))

    def ensure(self) -> None:
        """Create if absent; an existing index is taken as it is."""
        if self._version() is None:
            self.recreate()

    def exists(self) -> bool:
        return self._version() is not None

    def upsert(self, chunks: DataFrame, replace_documents: bool = False) -> None:
        """Rows with ``embedding`` by point id, the new ones winning; a null or wrong-sized embedding fails.

        Rows not in ``chunks`` stay, also those of an edited document (unless ``replace_documents``).
        Of repeated ids within ``chunks`` one row stays.
        """
        new = chunks.withColumn("embedding", l2_normalize(require_dimension(F.col("embedding"), self.dimensions))).withColumn("point_id", point_id(F.col("chunk_id")))
        new = new.select(*(c.split()[0] for c in self.schema.split(", "))).dropDuplicates(["point_id"])
        key = "document_id" if replace_documents else "point_id"
        old = self.read().join(new.select(key).distinct(), key, "left_anti")
        self._write(old.select(*new.columns).unionByName(new))

    def read(self) -> DataFrame:
        version = self._version()
        if version is None:
            raise IndexMissing(f"index {self.name} does not exist; ingest documents first")
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{version}")

    def count(self) -> int:
        return self.read().count()

    def close(self) -> None:
        """Nothing is held open."""
