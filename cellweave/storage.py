"""Written tables between steps, and the content-addressed array store."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .array import ArrayMeta, CellArray

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, of the session or the context; in a local run where that is unset, a folder of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="cellweave-"))
        path = _own[0]
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write and read back: cuts lineage, and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _content(spark: SparkSession, path: str) -> int:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def bytes_of(df: DataFrame) -> int:
    """Bytes of the files that a written table consists of."""
    return sum(_content(df.sparkSession, f) for f in df.inputFiles())


class ArrayStore:
    """Arrays by content: equal shape, type and cells share a key, and an array is written once."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def key(self, a: CellArray) -> str:
        """Order-free hash of the cells, with the shape and the type."""
        h = F.xxhash64("i", "j", "v")
        r = a.df.agg(F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1_000_003))).alias("s")).first()
        return f"{a.meta.nrows}x{a.meta.ncols}-{a.meta.dtype}-{(r['x'] or 0) & (2**64 - 1):016x}{r['s'] or 0:x}"

    def _there(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def add(self, a: CellArray) -> str:
        key = self.key(a)
        if not self._there(f"{self.root}/{key}"):
            a.df.write.mode("overwrite").parquet(f"{self.root}/{key}")
        return key

    def get(self, key: str) -> CellArray:
        shape, dtype, _ = key.split("-", 2)
        n, m = map(int, shape.split("x"))
        return CellArray(self.spark.read.parquet(f"{self.root}/{key}"), ArrayMeta(n, m, dtype))

    def size(self, key: str) -> int:
        """Bytes on disk."""
        return _content(self.spark, f"{self.root}/{key}")
