"""Sharding along a Hilbert curve, in SQL functions only.

Source and language (by their place in the sorted distribution) and the binary magnitude of the size
are quantised to 32 levels each; rows sort by the index of their cell on the three-dimensional Hilbert
curve and are cut into runs whose counts are at most one apart. A file of one run thus covers few
values of every dimension, which file pruning needs.

Places in the order come from counts: rows of a cell go to up to 1024 buckets by a hash of the id, the
buckets' counts are summed up, and only rows of one bucket are ever sorted together. Null source or
language: levels of their own, last. Null text: no bytes. Repeated rows take a place each, ties in the
id ordered by size and checksum. An empty table gives no rows. Columns of other names play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirflow.llm.common import saved

BITS, DIMS = 5, 3
BUCKETS = 1024


def curve_table() -> list[int]:
    """By state * 8 + the bits of one level: index digit * 32 + next state; a state is entry point * 3 + direction."""
    size = 1 << DIMS

    def rotate(x: int, by: int) -> int:
        by %= DIMS
        return ((x << by) | (x >> (DIMS - by))) & (size - 1)

    gray = [i ^ (i >> 1) for i in range(size)]
    ones = [(~i & (i + 1)).bit_length() - 1 for i in range(size)]  # trailing ones

    def entry(w: int) -> int:
        return 0 if w == 0 else gray[2 * ((w - 1) // 2)]

    def turn(w: int) -> int:
        return 0 if w == 0 else (ones[w - 1] if w % 2 == 0 else ones[w]) % DIMS

    out = []
    for state in range(size * DIMS):
        e, d = divmod(state, DIMS)
        for bits in range(size):
            w = gray.index(rotate(bits ^ e, -(d + 1)))
            out.append(w * 32 + (e ^ rotate(entry(w), d + 1)) * DIMS + (d + turn(w) + 1) % DIMS)
    return out


def curve_index(*levels: str) -> Column:
    """The Hilbert index of a cell, from its three levels (int columns, BITS bits each)."""
    x, y, z = levels
    lookup = "array(" + ",".join(f"{v}L" for v in curve_table()) + ")"
    bits = f"shiftright({x}, i) % 2 * 4 + shiftright({y}, i) % 2 * 2 + shiftright({z}, i) % 2"
    step = f"(acc, i) -> shiftleft(shiftright(acc, 5), 8) + element_at({lookup}, cast(acc % 32 * 8 + {bits} + 1 as int))"
    return F.expr(f"aggregate(sequence({BITS - 1}, 0, -1), 0L, {step}, acc -> cast(shiftright(acc, 5) as int))")


def levels_of(df: DataFrame, column: str, out: str) -> DataFrame:
    """(column, out): each value's level by the share of rows that sort before it. One row for each value."""
    order = Window.partitionBy(F.lit(1)).orderBy(F.col(column).asc_nulls_last())
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = F.floor(before * (1 << BITS) / F.sum("n").over(Window.partitionBy(F.lit(1))))
    return counts.select(F.col(column).alias(f"_{column}"), level.cast("int").alias(out))


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, curve (index on it), shard, slot (place in the shard)."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    bucket = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % BUCKETS
    rows = saved(docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), bucket.cast("int").alias("bucket")))
    rows = rows.withColumn("_m", F.least(F.length(F.bin("size")), F.lit((1 << BITS) - 1)))
    kinds = rows.groupBy("source", "lang", "_m").agg(F.count("*").alias("n"))
    for column in ("source", "lang"):
        levels = levels_of(rows, column, f"_{column}_level")
        kinds = kinds.join(levels, F.col(column).eqNullSafe(F.col(f"_{column}"))).drop(f"_{column}")
    kinds = kinds.select(F.col("source").alias("_source"), F.col("lang").alias("_lang"), F.col("_m").alias("_k"), curve_index("_source_level", "_lang_level", "_m").alias("curve"))
    on = [F.col("source").eqNullSafe(F.col("_source")), F.col("lang").eqNullSafe(F.col("_lang")), F.col("_m") == F.col("_k")]
    rows = saved(rows.join(kinds, on).select("doc_id", "size", "text_crc32", "curve", "bucket"))
    counts = rows.groupBy("curve", "bucket").agg(F.count("*").alias("n"))
    cells = counts.groupBy("curve").agg(F.sum("n").alias("m"))
    every = Window.partitionBy(F.lit(1))
    upto = lambda c: F.sum(c).over
    cells = cells.select(F.col("curve").alias("c"), (upto("m")(every.orderBy("curve")) - F.col("m")).alias("cell_first"), F.sum("m").over(every).alias("total"))
    inside = upto("n")(Window.partitionBy("curve").orderBy("bucket")) - F.col("n")
    firsts = counts.withColumn("inside", inside).join(cells, F.col("curve") == F.col("c")).select(F.col("curve").alias("c"), F.col("bucket").alias("b"), (F.col("cell_first") + F.col("inside")).alias("first"), "total")
    order = Window.partitionBy("curve", "bucket").orderBy("doc_id", "size", "text_crc32")
    rows = rows.withColumn("r", F.row_number().over(order) - 1).join(firsts, (F.col("curve") == F.col("c")) & (F.col("bucket") == F.col("b")))
    rows = rows.withColumn("rank", F.col("first") + F.col("r"))
    rows = rows.withColumn("shard", F.expr(f"((rank + 1) * {shards} - 1) div total").cast("int"))
    return rows.select("doc_id", "size", "text_crc32", "curve", "shard", F.expr(f"rank - (total * shard) div {shards}").cast("long").alias("slot"))
