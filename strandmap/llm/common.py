"""What the corpus operators share: tables, the shared folder, sizes and key ranges."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A side of a join is broadcast only if so many rows are counted in it at most.
BROADCAST_ROWS = 200_000
#: And so many bytes of text, as JSON.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a session within one JVM gets one of our own if it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="strandmap-")
        spark.sparkContext.setCheckpointDir(at)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/") if "://" in at or at.startswith("file:") else f"file://{at.rstrip('/')}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/strandmap/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, which cuts its lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop(*frames: DataFrame) -> None:
    """Deletes the files of stored() frames."""
    for df in frames:
        delete(df.sparkSession, df._stored_at)


def delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession, rows: int = 512, most: int = 4 << 20) -> None:
    """Readies a session for Python workers. Arrow batches hold few rows, and few bytes where they hold more than one."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def small_or_as_is(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows, and the bytes of its strings, prove it small, else without one."""
    wide = [F.octet_length(F.to_json(F.struct(c))) for c, kind in df.dtypes if "string" in kind or "array" in kind]
    sizes = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(sum(wide[1:], wide[0])), F.lit(0)) if wide else F.lit(0)).head()
    return F.broadcast(df) if sizes[0] <= rows and sizes[1] <= most else df


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def row_key(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes of a row; never null."""
    return [F.xxhash64(F.lit(salt), *cols) for salt in (1, 2)]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Ranges:
    """Contiguous ranges of a whole-number key of about equal counts.

    Cuts come from a bounded sample of keys (about SAMPLED a range, chosen by their hash); they only balance the work.
    """

    SAMPLED = 64

    def __init__(self, df: DataFrame, key: str, n: int):
        self.key = F.coalesce(F.col(key), F.lit(-(2**63)).cast("long"))
        share = min(1.0, self.SAMPLED * n / max(1, df.count()))
        u = F.shiftrightunsigned(F.xxhash64(self.key), 11) / float(1 << 53)
        some = sorted(r[0] for r in df.filter(u <= share).select(self.key).collect()) if n > 1 else []
        self.cuts = sorted({some[i * len(some) // n] for i in range(1, n)}) if some else []
        self.step = max(1, int(len(self.cuts) ** 0.5))

    def bucket(self) -> Column:
        """Number of cuts below the key, found in two short scans."""
        if not self.cuts:
            return F.lit(0)
        groups = [self.cuts[i : i + self.step] for i in range(0, len(self.cuts), self.step)]
        below = lambda values: F.size(F.filter(values, lambda c: c < self.key))
        g = below(literal([g[0] for g in groups], "array<bigint>"))  # groups whose first cut is below the key
        return F.when(g == 0, F.lit(0)).otherwise((g - 1) * self.step + below(F.element_at(literal(groups, "array<array<bigint>>"), g)))


def literal(value: object, kind: str) -> Column:
    """A constant of any size in one expression, which the optimizer folds."""
    return F.from_json(F.lit(json.dumps(value)), kind)
