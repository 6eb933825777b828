"""Sources and sinks: delimited text, JSON lines, framed binary records, Parquet and other formats.

Paths are Spark's: folders, globs, compressed files and any store it reads.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_lines(spark: SparkSession, path: str | list[str], delimiter: str | None = None, tagged: bool = False) -> DataFrame:
    """(value): records between delimiters (default: lines). tagged: with the file each is from, as `tag`."""
    reader = spark.read if delimiter is None else spark.read.option("lineSep", delimiter)
    df = reader.text(path)
    return df.select("value", F.col("_metadata.file_path").alias("tag")) if tagged else df


def json_lines(lines: DataFrame, schema: T.StructType | str, required: list[str] | None = None, column: str = "value") -> DataFrame:
    """Fields of one JSON object a row; malformed rows and those without a required field (default: all) go.

    Of a repeated key the last value counts; numbers become strings where the schema says so. The tag of
    tagged lines stays, after the fields.
    """
    tag = ["tag"] if "tag" in lines.columns else []
    rows = lines.select(F.from_json(column, schema).alias("_r"), *tag)
    fields = rows.schema["_r"].dataType.names
    rows = rows.select("_r.*", *[F.col(t).alias("_tag") for t in tag])
    for name in fields if required is None else required:
        rows = rows.where(F.col(name).isNotNull())
    return rows.withColumnRenamed("_tag", "tag")


def fixed_records(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(tag, place, record): records of `size` bytes; a shorter rest at the end of a file goes.

    Every file is one row of Spark's binary source, so files are bounded by its 2 GB; more data means more files.
    """
    if size < 1:
        raise ValueError("records have at least one byte")
    files = spark.read.format("binaryFile").load(path)
    whole = F.expr(f"length(content) div {size}")
    at = F.when(whole > 0, F.sequence(F.lit(0).cast("long"), whole - 1)).otherwise(F.array().cast("array<long>"))
    rows = files.select(F.col("path").alias("tag"), "content", F.explode(at).alias("place"))
    return rows.select("tag", "place", F.expr(f"substring(content, cast(place * {size} + 1 as int), {size})").alias("record"))


def prefixed_records(spark: SparkSession, path: str, width: int = 4) -> DataFrame:
    """(tag, place, record): records after their little-endian length of `width` bytes; a truncated last one goes.

    Where a record begins is known only from the one before, so a file is walked in one go; files are
    bounded as in fixed_records.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def walk(batches):
        for batch in batches:
            for tag, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                view, at, place, held, bytes_held = memoryview(content), 0, 0, [], 0
                while at + width <= len(view):
                    n = int.from_bytes(view[at : at + width], "little")
                    if at + width + n > len(view):
                        break
                    held.append((place, bytes(view[at + width : at + width + n])))
                    at, place, bytes_held = at + width + n, place + 1, bytes_held + n
                    if bytes_held > 4 << 20 or len(held) >= 10_000:
                        yield _frames(tag, held)
                        held, bytes_held = [], 0
                if held:
                    yield _frames(tag, held)

    return files.mapInArrow(walk, "tag string, place long, record binary")


def _frames(tag: str, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
    places, records = zip(*held, strict=True)
    return pa.record_batch([pa.array([tag] * len(held)), pa.array(places, pa.int64()), pa.array(records, pa.binary())], ["tag", "place", "record"])


def table(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    """Any of Spark's formats (parquet, orc, csv, json); columns and filters are pushed to the scan."""
    return spark.read.format(kind).options(**options).load(path)


def write_lines(df: DataFrame, path: str, column: str = "line", delimiter: str | None = None, compression: str | None = None, mode: str = "errorifexists") -> None:
    """One text column as delimited records; compression as gzip, lz4, ... A finished folder holds _SUCCESS."""
    writer = df.select(column).write.mode(mode)
    if delimiter is not None:
        writer = writer.option("lineSep", delimiter)
    if compression is not None:
        writer = writer.option("compression", compression)
    writer.text(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None, mode: str = "errorifexists", **options) -> None:
    """Any of Spark's formats, in one folder for each value of the columns `by`."""
    writer = df.write.format(kind).mode(mode).options(**options)
    (writer.partitionBy(*by) if by else writer).save(path)
