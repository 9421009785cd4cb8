"""Shared helpers of the training-data operators: shared folders, guarded joins, word reading.

Executors do not share local disks, so every intermediate table goes to the folder named by
``spark.checkpoint.dir`` and is read back from there; a lost executor then only costs a re-run
of tasks, never of lost local blocks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A word of every operator here: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Most rows and bytes of a table that may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 8 << 20

#: Bytes of a table on disk for which a file of the next one is worth its cost, about.
FILE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set (tests, local mode)."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="stratafind-")
        context.setCheckpointDir(root)
    return root


class Workspace:
    """Tables of one operator run below the shared folder, by name; they go when the driver ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        bounded_batches(spark)
        self.path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)

    def fewer(self, df: DataFrame, source: str) -> DataFrame:
        """df in no more tasks than the kept table source has FILE_BYTES, two a core at least: for steps
        whose rows are about as many as its own, so that a wide shuffle of a small table writes few files."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{source}")
        size = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
        return df.coalesce(max(2 * self.spark.sparkContext.defaultParallelism, -(-size // FILE_BYTES)))

    def keep(self, df: DataFrame, name: str, small: bool = False, dealt: bool = False) -> DataFrame:
        """Writes df as Parquet and returns a reader of it, which cuts its lineage.

        small: rows of a few numbers, which a sixteenth of the tasks write, so that wide shuffles
        do not leave thousands of files of a few rows; dealt: their last step is dear, so it keeps
        its tasks and the rows are dealt out anew.
        """
        if small or dealt:
            files = max(4, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 16)
            df = df.repartition(files) if dealt else df.coalesce(files)
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, longer by underscores where a column has them (in any case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_hash(docs: DataFrame):
    """A 64-bit hash of a whole row; columns that hold maps enter as JSON."""
    def part(field):
        return F.to_json(docs[field.name]) if "map" in field.dataType.simpleString() else docs[field.name]

    return F.xxhash64(*[part(f) for f in docs.schema.fields])


def seeded_rows(rows: DataFrame, key: str, seed: int, most: int) -> DataFrame:
    """At most `most` rows with distinct keys, drawn by a seeded hash of the key.

    Rows are thinned out by their hash before the smallest are taken, so tasks send few.
    """
    drawn = F.xxhash64(F.lit(seed), key)
    total = rows.count()
    if total > 2 * most:
        # of the hashes' 2^63 halves, twice as many rows as are asked for
        rows = rows.filter(F.shiftrightunsigned(drawn, 1) < F.lit(int(2.0**63 * (2 * most / total))))
    return rows.orderBy(drawn, key).limit(most)


def fits_broadcast(df: DataFrame) -> bool:
    """Whether df's rows, and the bytes of its texts, are within the broadcast bounds."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    size = F.coalesce(F.sum(sum(texts, F.lit(0)).cast("long")), F.lit(0))
    rows, size = df.agg(F.count("*"), size).first()
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def broadcast_small(df: DataFrame) -> DataFrame:
    """df marked for a broadcast if it fits."""
    return F.broadcast(df) if fits_broadcast(df) else df


def join_dimension(rows: DataFrame, dim: DataFrame, key: str, how: str = "left", salts: int = 64, small: bool | None = None) -> DataFrame:
    """Joins rows to a table with one row per key (nulls match nulls).

    The table is broadcast behind a check of its size; beyond the bound it is copied once per
    salt and the rows spread over the salts, so a hot key is shared by many tasks.
    """
    dim = dim.withColumnRenamed(key, "_dim_key")
    small = fits_broadcast(dim) if small is None else small
    if small:
        return rows.join(F.broadcast(dim), rows[key].eqNullSafe(dim["_dim_key"]), how).drop("_dim_key")
    left = rows.withColumn("_salt", F.floor(F.rand(17) * salts).cast("int"))
    right = dim.withColumn("_dim_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = left[key].eqNullSafe(right["_dim_key"]) & (left["_salt"] == right["_dim_salt"])
    return left.join(right, on, how).drop("_dim_key", "_dim_salt", "_salt")


def bounded_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> None:
    """Whole texts and sets travel in batches: fewer rows and bytes of them at once bound both sides' memory."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(spark.conf.get(name).rstrip("bB")) <= most:
            spark.conf.set(name, str(most))


def release() -> None:
    """At the end of a task: freed memory goes back to the system, as Python workers outlive tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def chunks(column, limit: int = 2 << 20):
    """Yields (first, last, texts) of a batch's text column, about limit bytes at a time.

    A longer text stands alone. After the last chunk, freed memory goes back to the system, as
    Python workers outlive their tasks.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    n = len(column)
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < n:
        before = int(ends[start - 1]) if start else 0
        end = min(n, max(start, int(np.searchsorted(ends, before + limit, side="left"))) + 1)
        yield start, end, column.slice(start, end - start).to_pylist()
        start = end
    pa.default_memory_pool().release_unused()
