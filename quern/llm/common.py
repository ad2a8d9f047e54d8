"""Helpers shared by the training-data operators: shared folders, written tables, Arrow row mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch that a worker takes at a time.
SLICE_ROWS, SLICE_BYTES = 1000, 8 << 20
#: Spark's bound on the bytes of a batch, its default, and ours.
BATCH_SETTING, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local session takes a new temporary folder; on a cluster it is an error, as
    each machine would write to a disk of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = current.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            base = tempfile.mkdtemp(prefix="quern-")
        else:
            raise ValueError("spark.checkpoint.dir is unset: name a folder there that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", base)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """name, or the first longer form of it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that whole texts travel in by bytes, as buffers of Spark's default size take memory outside of the heap.

    A session that has a bound of its own keeps it. The setting bounds sizes only: no result depends on it.
    """
    if spark.conf.get(BATCH_SETTING, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most SLICE_ROWS rows and, but for a longer single row, about SLICE_BYTES."""
    rows = min(SLICE_ROWS, max(1, SLICE_BYTES * batch.num_rows // max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply fn to every Arrow batch of df, a bounded part at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(fn, slices(batch))

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def left_join_by_parts(left: DataFrame, right: DataFrame, keys: list[str], counts: str, rows: int, least: int = 100_000, most: int = 50_000) -> DataFrame:
    """left joined with right, whose keys are unique and whose column `counts` says how many rows of left have a key.

    Keys of very many rows are joined by broadcast, so that none of them gathers in one task: those above
    `least` rows and above a `most`-th of all `rows`, of which there can be at most `most`. The rest is shuffled.
    """
    edge = max(least, rows // most)
    hot = right.where(F.col(counts) > edge)
    common = left.join(F.broadcast(hot), keys)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.where(F.col(counts) <= edge), keys, "left")
    return common.unionByName(rest)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]
