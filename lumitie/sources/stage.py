"""Tables written between steps to cut lineage.

Iterative steps write their state as Parquet under the shared folder named by
``spark.checkpoint.dir`` and read it back.  A lost executor then recomputes at most one
step, and Catalyst sees true file sizes, so it broadcasts a side only when it is small.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession

_LOCAL_ROOTS: dict = {}


def shared_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a fresh folder only for local runs without one."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[key] = tempfile.mkdtemp(prefix="lumitie-")
    return _LOCAL_ROOTS[key]


class Stage:
    """A folder of staged tables belonging to one run."""

    def __init__(self, spark: SparkSession, label: str, root: str | None = None):
        self.spark = spark
        self.root = f"{root or shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._count = 0
        self._paths: dict = {}
        self._tables: list = []

    def write(self, df: DataFrame, name: str, metrics: dict | None = None):
        """Materialise ``df``; with ``metrics`` also return those aggregates.

        The aggregates are observed in the writing tasks, whose accumulators Spark
        applies once per partition even when tasks are retried.
        """
        self._count += 1
        path = f"{self.root}/{self._count:05d}-{name}"
        observed = None
        if metrics:
            observed = Observation()
            df = df.observe(observed, *[c.alias(k) for k, c in metrics.items()])
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (path, out)
        return (out, observed.get) if metrics else out

    def bucketed(self, df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
        """Materialise ``df`` in sorted buckets by ``keys``, so that joins on exactly these keys do not move it."""
        self._count += 1
        path, table = f"{self.root}/{self._count:05d}-{name}", f"{name}_{uuid.uuid4().hex}"
        (df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").option("path", path).saveAsTable(table))
        out = self.spark.table(table)
        self._paths[id(out)] = (path, out)
        self._tables.append(table)
        return out

    def clear(self) -> None:
        """Delete all staged tables, at the end of a run."""
        self._paths.clear()
        while self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop()}")
        self._delete(self.root)

    def _delete(self, uri: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a staged table that nothing reads any more."""
        uri, _ = self._paths.pop(id(df), (None, None))
        if uri:
            self._delete(uri)
