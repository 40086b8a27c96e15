"""What several training-data operators need: shared storage, text folding, size-checked joins, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []

#: Rows of one long (or a few) that may be broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset, which only a local run may do."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_dir:
            _own_dir.append("file://" + tempfile.mkdtemp(prefix="cellweave-"))
        path = _own_dir[0]
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, whichever store holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; the quick ``lower`` serves texts that are all ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def release() -> None:
    """Give memory that a finished task's texts took back to the system; workers live on between tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc
        libc.malloc_trim(0)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python a thousand rows at a time unless the session asks for other than Spark's default; both sides hold a batch or two for each core."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def text_map(docs: DataFrame, keep: dict[str, str], text: str, out: str, setup, rows: int = 500) -> DataFrame:
    """Columns ``keep`` (name: new name) as they are, and what a function makes of the texts.

    ``setup()`` runs once in a task and returns ``fn(texts) -> lists, one for
    each field of out``; null texts reach it as "". The kept columns stay in
    Arrow, so nulls and 64-bit integers come through exactly.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(docs.sparkSession)
    made = StructType.fromDDL(out)
    source = docs.select(*[F.col(c).alias(n) for c, n in keep.items()], F.col(text).alias("_text"))
    schema = StructType([f for f in source.schema.fields[:-1]] + made.fields)
    arrow = to_arrow_schema(schema)
    k = len(keep)

    def run(batches):
        import pyarrow as pa

        fn = setup()
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                columns = fn([t or "" for t in b.column(k).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(b.column(i).cast(arrow.field(i).type) for i in range(k)), *(pa.array(c, arrow.field(k + i).type) for i, c in enumerate(columns))], schema=arrow)
        release()

    return source.mapInArrow(run, schema)


def map_slices(df: DataFrame, fn, schema: str, rows: int = 500) -> DataFrame:
    """``fn(iterator of small pandas frames) -> iterator of pandas frames``. Batches stay in Arrow but for the slice at hand, which keeps workers small whatever the texts."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        slices = (b.slice(at, rows).to_pandas() for b in batches for at in range(0, b.num_rows, rows))
        for out in fn(slices):
            if len(out):
                yield pa.RecordBatch.from_pandas(out, schema=arrow, preserve_index=False)
        release()

    return df.mapInArrow(run, schema)


def rewrite_texts(docs: DataFrame, text: str, setup, rows: int = 500) -> DataFrame:
    """``docs`` with texts replaced or rows dropped, all columns as they are otherwise. ``setup()`` returns ``fn(texts) -> (kept flags or None, new texts or None)``."""
    small_batches(docs.sparkSession)
    k = docs.columns.index(text)

    def run(batches):
        import pyarrow as pa

        fn = setup()
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                flags, texts = fn(b.column(k).to_pylist())
                if texts is not None:
                    b = b.set_column(k, b.schema.field(k), pa.array(texts, b.schema.field(k).type))
                yield b if flags is None else b.filter(pa.array(flags, pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)


def semi_join(df: DataFrame, ids: DataFrame, key: str, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids``: broadcast while ``ids`` (counted) is small, shuffled beyond."""
    small = ids.limit(bound + 1).count() <= bound
    return df.join(F.broadcast(ids) if small else ids, key, "left_semi")


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """``edges(a, b)`` -> ``(node, component)``, component = smallest node reachable.

    Minimum labels travel along edges and are then replaced by their own
    labels (pointer jumping), so rounds grow with the logarithm of the
    diameter on the graphs met here. Each round is a written table.
    Nodes without edges aren't returned; an edge from a node to itself is.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), f"{name}-edges")
    label = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), f"{name}-labels")
    while True:
        seen = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = label.join(seen, "node").select("node", "label", F.least("label", "near").alias("low"))
        up = label.select(F.col("node").alias("low"), F.col("label").alias("up"))
        new = materialize(step.join(up, "low").select("node", F.least("low", "up").alias("label"), (F.least("low", "up") != F.col("label")).alias("moved")), f"{name}-labels")
        label = new.select("node", "label")
        if not new.filter("moved").limit(1).count():
            return label.withColumnRenamed("label", "component")
