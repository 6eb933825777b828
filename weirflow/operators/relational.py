"""Relational building blocks: reduction, deduplication, ranking, exchange and joins.

Everything is a DataFrame expression. Logical partitions are columns; where a result depends on a
partition number, that number is a function of the row, never of physical placement.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window


def reduce_sum(df: DataFrame, keys: list[str], weight: str = "w") -> DataFrame:
    """One row for each key with the sum of weights; combined before the exchange."""
    return df.groupBy(*keys).agg(F.sum(weight).alias(weight))


#: Rows that a task of `spread` takes, on average; they decide its memory, never results.
TASK_ROWS = 1_000_000


def spread(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """Rows (`rows` of them, or a bound) dealt by `by` to tasks of about TASK_ROWS rows, however many that takes.

    Left to itself, the planner merges tasks by the bytes they move, up to 64 MiB: many millions of rows of a few integers.
    """
    if rows <= TASK_ROWS:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-int(rows) // TASK_ROWS)), *by)


def two_phase(df: DataFrame, keys: list[str], within: Column, first: dict[str, Column], second: dict[str, Column]) -> DataFrame:
    """A combiner for parts (`first`, by keys and `within`), then another for what the parts gave (`second`)."""
    part = df.groupBy(*keys, within.alias("_part")).agg(*[c.alias(n) for n, c in first.items()])
    return part.groupBy(*keys).agg(*[c.alias(n) for n, c in second.items()])


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by `order`: an aggregate, so hot keys combine before the exchange."""
    rest = [c for c in df.columns if c not in keys]
    least = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_least")
    return df.groupBy(*keys).agg(least).select(*keys, *[F.col(f"_least.{c}").alias(c) for c in rest])


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; Spark cuts each task's groups to k before it moves them."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def limit_per_partition(df: DataFrame, part: Column, order: list[Column], n: int) -> DataFrame:
    """At most n rows of every logical partition, so up to partitions times n in all."""
    return top_k(df.withColumn("p", part), ["p"], order, n).drop("rank")


#: Rows of a range of `by_ranges`, on average; they decide balance, never results.
RANGE_ROWS = 1_000_000


def by_ranges(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """Rows sorted through all tasks, each of which holds a range; `most`, a bound of the rows, gives their number."""
    return df.repartitionByRange(most // RANGE_ROWS + 1, *order).sortWithinPartitions(*order)


def _beyond(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Where a is greater than b, and where they are equal; nulls are least and NaN is greatest, as in Spark."""
    flags = lambda x: np.asarray(pc.fill_null(x, False))
    greater, equal = flags(pc.greater(a, b)), flags(pc.equal(a, b))
    if pa.types.is_floating(a.type):
        x, y = flags(pc.is_nan(a)), flags(pc.is_nan(b))
        greater, equal = greater | (x & ~y & np.asarray(b.is_valid())), equal | (x & y)
    x, y = np.asarray(a.is_null()), np.asarray(b.is_null())
    return greater | (~x & y), equal | (x & y)


def sorted_violations(df: DataFrame, part: str, order: list[str]) -> DataFrame:
    """One row (violations): rows that come before their predecessor in their partition by physical order.

    Each task reads its rows once and keeps the last one of each partition; the first and last rows of tasks are compared then.
    """
    columns = list(dict.fromkeys([part, *order]))
    kinds = {c: df.schema[c].dataType.simpleString() for c in columns}
    held = ", ".join(f"`{c}`: {kinds[c]}" for c in order)
    schema = f"`{part}` {kinds[part]}, _task int, _bad long, _first struct<{held}>, _last struct<{held}>"

    shape = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def count(batches):
        first, last, bad, task = {}, None, {}, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            task = batch.column("_task")[0].as_py()
            rows = pa.Table.from_batches([batch]).select(columns)
            rows = pa.concat_tables([last, rows]) if last is not None else rows
            codes = rows.column(part).combine_chunks().dictionary_encode("encode")
            by = np.asarray(codes.indices)
            at = np.argsort(by, kind="stable")
            rows, by = rows.take(pa.array(at)), by[at]
            greater, tied = np.zeros(len(by) - 1, bool), by[1:] == by[:-1]
            for c in order:
                more, equal = _beyond(rows.column(c)[:-1], rows.column(c)[1:])
                greater, tied = greater | (tied & more), tied & equal
            ends = np.flatnonzero(np.append(by[1:] != by[:-1], True))
            wrong = np.bincount(by[1:][greater], minlength=len(ends))
            for i, start in enumerate(np.append(0, ends[:-1] + 1)):
                key = codes.dictionary[i].as_py()
                first.setdefault(key, {c: rows.column(c)[int(start)].as_py() for c in order})
                bad[key] = bad.get(key, 0) + int(wrong[i])
            last = rows.take(pa.array(ends))
        if last is not None:
            out = [{part: r[part], "_task": task, "_bad": bad[r[part]], "_first": first[r[part]], "_last": {c: r[c] for c in order}} for r in last.to_pylist()]
            yield from pa.Table.from_pylist(out, schema=shape).to_batches()

    edges = df.select(*columns, F.spark_partition_id().alias("_task")).mapInArrow(count, schema)
    before = F.lag("_last").over(Window.partitionBy(part).orderBy("_task"))  # a row for each task and partition
    crossed = F.when(F.col("_before") > F.col("_first"), 1).otherwise(0)
    return edges.withColumn("_before", before).agg(F.coalesce(F.sum(F.col("_bad") + crossed), F.lit(0)).cast("long").alias("violations"))


#: Rows of the sample that range bounds are taken from, for each range; they decide balance, never results.
PER_RANGE = 60


def numbered(df: DataFrame, by: list[str], order: list[str], out: str = "place") -> DataFrame:
    """Every row's place (long, from 0) in its group `by` in the given order, however large the group.

    Rows go to ranges of the first order column, ranges are counted, and a place is the rows of the ranges
    before plus the place within the range. Nulls come first. Bounds come from a bounded sample by hash.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = F.col(order[0])
    total = df.count()
    share = int(min(1.0, PER_RANGE * ranges / max(total, 1)) * (1 << 30))
    some = df.where(first.isNotNull() & (F.pmod(F.xxhash64(*order), F.lit(1 << 30)) <= share)).select(first.alias("x"))
    held = sorted(r.x for r in some.collect())
    bounds = sorted(set(held[:: max(1, len(held) // ranges)]))
    bucket = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= first)) if bounds else F.lit(0)
    rows = df.withColumn("_range", bucket)
    counts = rows.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_n")  # a row for each range
    counts = counts.withColumn("_before", before).drop("_n")
    same = counts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_r"), "_before")
    place = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)) - 1
    on = [F.col("_range") == F.col("_r"), *[F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]]
    rows = rows.withColumn("_place", place).join(same, on)
    return rows.select(*df.columns, (F.col("_before") + F.col("_place")).alias(out))


def dealt(df: DataFrame, parts: int) -> DataFrame:
    """Rows dealt round to `parts` partitions (column p), by their order over all columns: counts are at most one apart."""
    one = df.withColumn("_one", F.lit(0))
    return numbered(one, ["_one"], df.columns, "_at").withColumn("p", F.pmod("_at", F.lit(parts)).cast("int")).drop("_one", "_at")


def dense_ids(df: DataFrame, key: str, part: Column, parts: int, out: str = "id") -> DataFrame:
    """Distinct keys with dense ids: place in the partition times partitions, plus the partition."""
    keys = df.select(key).distinct().withColumn("p", part)
    placed = numbered(keys, ["p"], [key], "_at")
    return placed.select(key, "p", (F.col("_at") * parts + F.col("p")).alias(out))


def group_transform(df: DataFrame, keys: list[str], order: list[str], body: Callable, schema: str) -> DataFrame:
    """A callback for each group: body(key values, Arrow table of its rows in order) -> Arrow table of `schema`.

    For bodies that expressions can't say. A group is in one task's memory, so it must fit there.
    """

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        by = [(c.rstrip("-"), "descending" if c.endswith("-") else "ascending") for c in order]
        return body(tuple(k.as_py() for k in key), rows.sort_by(by) if by else rows)

    return df.groupBy(*keys).applyInArrow(run, schema)


def enrich(facts: DataFrame, names: DataFrame, key: str, name_key: str, name: str, out: str, default: Column | None = None, rows: int = 0) -> DataFrame:
    """Left join to a dictionary with one row for each key; what isn't there gets `default`, else its own key.

    The planner broadcasts the dictionary only where its size allows. With `rows` (of `spread`) one that is counted small is
    broadcast, and else both sides are dealt by key.
    """
    right = names.select(F.col(name_key).alias("_key"), F.col(name).alias("_name"))
    if rows > TASK_ROWS:
        if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            right = F.broadcast(right)
        else:
            facts, right = spread(facts, rows, key), spread(right, rows, "_key")
    joined = facts.join(right, F.col(key) == F.col("_key"), "left")
    return joined.withColumn(out, F.coalesce("_name", default if default is not None else F.col(key).cast("string"))).drop("_key", "_name")


#: Rows up to which a side that every task reads whole may be broadcast.
BROADCAST_ROWS = 100_000


def broadcast_checked(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The broadcast hint if the side is counted small; beyond that the planner chooses another join."""
    small = df.limit(most + 1).count() <= most
    return F.broadcast(df) if small else df


def lookup(facts: DataFrame, dim: DataFrame, key: str, dim_key: str, columns: list[str]) -> DataFrame:
    """Map-side lookup of a loaded dictionary (inner)."""
    right = broadcast_checked(dim.select(F.col(dim_key).alias("_key"), *columns))
    return facts.join(right, F.col(key) == F.col("_key")).drop("_key")


def every_pair(left: DataFrame, right: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """All-to-all edge: every row meets every row of a side that is counted small, or the call fails."""
    if right.limit(most + 1).count() > most:
        raise ValueError(f"an all-to-all edge needs a side of at most {most} rows")
    return left.crossJoin(F.broadcast(right))


def merge_groups(sides: list[DataFrame], keys: list[str], aggregates: dict[str, Column]) -> DataFrame:
    """Several inputs merged and grouped by key; the side a row came from isn't told apart."""
    df = sides[0]
    for other in sides[1:]:
        df = df.unionByName(other)
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def health(df: DataFrame, part: Column, parts: int) -> DataFrame:
    """Rows of each logical partition, empty ones too."""
    counts = df.groupBy(part.alias("p")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(parts).select(F.col("id").cast("int").alias("p"))
    return every.join(counts, "p", "left").select("p", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.col("n").isNull().alias("empty"))
