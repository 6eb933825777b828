"""Helpers shared by the training-data operators: table access, checkpoints, Arrow mapping."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handed to one vectorised step; larger Arrow batches are cut, so memory doesn't follow the batch.
STEP_BYTES = 4 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once, and bound the bytes of an Arrow batch."""
    import os
    import zipfile

    import weirflow

    if spark.conf.get(BATCH_BYTES) == "67108864b":  # the default; rows here may hold megabytes each
        spark.conf.set(BATCH_BYTES, "8m")
    sc = spark.sparkContext
    if getattr(sc, "_weirflow_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(weirflow.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="weirflow-"), "weirflow.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("weirflow", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._weirflow_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; make one only where none is set and all runs on this machine (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = sc.getConf().get("spark.checkpoint.dir")
        if not at and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="weirflow-"))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it lies."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def saved(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Tables:
    """Tables of one computation in the shared checkpoint folder; all but those kept go at its end."""

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark, self.at, self.n = spark, f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_):
        remove(self.spark, f"{self.at}/steps")

    def table(self, df: DataFrame, place: str = "steps") -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.at}/{place}/{self.n}")
        return self.spark.read.parquet(f"{self.at}/{place}/{self.n}")

    def keep(self, df: DataFrame) -> DataFrame:
        return self.table(df, "kept")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the columns an operator works on, so that other columns can't clash; null texts become empty."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def steps(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows holding about STEP_BYTES of text each."""
    n = batch.num_rows
    if n == 0:
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        total += int(size)
        if total >= STEP_BYTES:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < n:
        yield batch.slice(start)


def map_steps(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str = "text") -> DataFrame:
    """mapInArrow over steps bounded by the bytes of a column: one output batch for each step, no shuffle."""

    def run(batches):
        for batch in batches:
            for step in steps(batch, column):
                out = fn(step)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each value (null: empty) without making str objects."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def crc_mod(column: str, n: int):
    """crc32 of the value as text, modulo n."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))
