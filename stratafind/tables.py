"""Versioned tables in a shared folder, and lineage cuts for driver loops."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def work_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared one (a temporary one only in local mode without setting); it goes when the driver ends."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="stratafind-")
        context.setCheckpointDir(root)
    folder = f"{root}/engine-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def keep(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class VersionedTable:
    """A Parquet table in buckets of record numbers, with a pointer that is replaced as a whole.

    A version names for each bucket the folder that holds it, so a batch rewrites the buckets it
    touches and takes over all others. Readers see the table before or after a batch. The
    pointer holds version, batch and stream offset, so that state and cursor commit together.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root, buckets
        self.path = spark._jvm.org.apache.hadoop.fs.Path(root)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def bucket(self) -> Column:
        return F.pmod("record_no", F.lit(self.buckets)).cast("int")

    def state(self) -> dict:
        """{version, batch, cursor}; the highest complete pointer counts."""
        if not self.fs.exists(self._path("pointers")):
            return {"version": -1, "batch": -1, "cursor": None}
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path("pointers"))]
        best = max((tuple(int(x) for x in n.split("_")) for n in names if not n.startswith(("_", "."))), default=(-1, -1, 0))
        return {"version": best[0], "batch": best[1], "cursor": best[2]}

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """Bucket to the version whose folder holds it; empty buckets are absent."""
        version = self.state()["version"] if version is None else version
        if version < 0:
            return {}
        text = self.spark.read.text(f"{self.root}/manifests/{version}").first()[0]
        return {int(k): v for k, v in json.loads(text).items()}

    def read(self, schema: str, only: list[int] | None = None) -> DataFrame:
        """The current version, or some of its buckets."""
        held = self.manifest()
        paths = [f"{self.root}/v{v}/bucket={b}" for b, v in sorted(held.items()) if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def publish(self, df: DataFrame, batch: int, cursor: int, only: list[int] | None = None) -> int:
        """Writes the next version, whole or some buckets of it, then makes it current by creating its pointer (atomic)."""
        before = self.state()["version"]
        version = before + 1
        df.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/v{version}")
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(f"v{version}"))]
        held = {} if only is None else {b: v for b, v in self.manifest(before).items() if b not in only}
        held |= {int(n.removeprefix("bucket=")): version for n in names if n.startswith("bucket=")}
        self.spark.createDataFrame([(json.dumps(held),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/manifests/{version}")
        self.fs.mkdirs(self._path(f"pointers/{version}_{batch}_{max(cursor, 0)}"))
        return version

    def compact(self, schema: str) -> int:
        """Rewrites the current version with one file a bucket; no row changes."""
        state = self.state()
        return self.publish(self.read(schema), state["batch"], state["cursor"] or 0)

    def vacuum(self, keep_versions: int = 2) -> None:
        """Deletes folders that none of the newest versions reads."""
        newest = self.state()["version"]
        used = {v for n in range(max(0, newest - keep_versions + 1), newest + 1) for v in self.manifest(n).values()}
        for v in range(newest - keep_versions + 1):
            if v not in used:
                self.fs.delete(self._path(f"v{v}"), True)
