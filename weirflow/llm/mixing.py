"""Mixing sources to target weights by Sainte-Laguë apportionment, in SQL functions only.

Targets: every source gets its weight's part of `share` times all sizes, but at most `repeat` times
its own size; what is above goes to the others by weight. The targets are turned into equal blocks of
words by highest quotients target/(2s+1), first among sources, then among the shards of each source.
In a shard, documents stand in a seeded order that is cut into blocks; the quota's first blocks are
taken, running round again (up to `repeat` passes) where the quota exceeds the shard.

Sources rank by code point and null comes last as a source of its own. Null, empty and blank texts
have size 0 and nothing taken. Repeated rows count each for itself; rows that tie in the seeded order
(equal id and size) are interchangeable. An empty table gives no rows. Any other columns may come
along (`keep`); the operator's own columns replace those of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirflow.llm.common import saved

WORD = r"[^\x20\x09-\x0D]+"
#: Words in a shard, about.
SHARD_WORDS = 1 << 22
#: Bits of the seeded hash, and those of its first that cut a shard into ranges of about SHARD_WORDS / 2^RANGE_BITS words.
HASH_BITS, RANGE_BITS = 60, 6
#: Sources, and bytes of their names, up to which every task gets the table of sources.
BROADCAST_SOURCES, BROADCAST_BYTES = 100_000, 8 << 20
MOST_BLOCK, BLOCKS = 1024, 1000
WEIGHTS, SHARE, REPEAT, SEED = (3, 1, 2), 1.5, 2, "mix-1"


def seeded(id_col: str, seed: str) -> Column:
    """60 bits of md5 over the seed and the id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def word_count(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeat: float = REPEAT) -> DataFrame:
    """(source, source_size) -> with weight and target. One row for each source, so its windows are small."""
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.partitionBy(F.lit(1)).orderBy("ratio", F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int"))
    df = sizes.withColumn("weight", w.cast("double")).withColumn("cap", repeat * F.col("source_size").cast("double"))
    df = df.withColumn("ratio", F.col("cap") / F.col("weight"))
    # The level if all sources of smaller ratio stop at their caps; it holds at the first source that it doesn't fill.
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("level", (F.sum("source_size").over(every) * F.lit(share) - before) / rest)
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every)
    return df.withColumn("target", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap")))).select("source", "source_size", "weight", "target")


def apportion(df: DataFrame, within: list[str], names: list[str], votes: str, seats: str, out: str) -> DataFrame:
    """Sainte-Laguë: `seats` (equal within a group) go by highest quotients votes/(2s+1); ties to smaller names.

    Seats that any divisor near votes/seats gives are certain; only the quotients between two such
    divisors, about two for each row, are made and ranked.
    """
    every = Window.partitionBy(*within)
    n, total, all_seats = F.count("*").over(every), F.sum("_v").over(every), F.col(seats).cast("double")
    part = F.when(F.col("_total") > 0, F.col("_v") / F.col("_total")).otherwise(0.0)
    df = df.withColumn("_v", F.col(votes).cast("double"))
    df = df.withColumn("_n", n).withColumn("_total", total)
    df = df.withColumn("_lo", F.floor(F.greatest(F.lit(0.0), part * (all_seats - F.col("_n") / 2 - 1) + 0.5)))
    df = df.withColumn("_hi", F.floor(part * (all_seats + F.col("_n") / 2 + 1) + 0.5))
    df = df.withColumn("_open", F.col(seats) - F.sum("_lo").over(every))
    more = df.where("_hi > _lo").select(*within, *names, "_v", "_open", F.explode(F.expr("sequence(_lo, _hi - 1)")).alias("_s"))
    ranked = Window.partitionBy(*within).orderBy((F.col("_v") / (2 * F.col("_s") + 1)).desc(), *[F.col(x).asc_nulls_last() for x in names])
    won = more.withColumn("_r", F.row_number().over(ranked)).where("_r <= _open").groupBy(*within, *names).agg(F.count("*").alias("_won"))
    keys = [*within, *names]
    won = won.select(*[F.col(k).alias(f"_{k}") for k in keys], "_won")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    df = df.join(won, on, "left").withColumn(out, (F.col("_lo") + F.coalesce("_won", F.lit(0))).cast("long"))
    return df.drop(*[f"_{k}" for k in keys], "_v", "_n", "_total", "_lo", "_hi", "_open", "_won")


def broadcastable(by_source: DataFrame) -> bool:
    """Whether a saved table of sources is counted small; beyond that it is joined by a shuffle."""
    sizes = by_source.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col("source").cast("string"))).alias("b")).first()
    return sizes.n <= BROADCAST_SOURCES and (sizes.b or 0) <= BROADCAST_BYTES


def mix(docs: DataFrame, keep: tuple = (), weights: tuple = WEIGHTS, share: float = SHARE, repeat: int = REPEAT, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows of docs as (doc_id, source, *keep, size, source_size, target, taken)."""
    kept = [c for c in keep if c not in ("doc_id", "source", "size", "source_size", "target", "taken")]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), *kept, word_count(text_col).alias("size"), seeded(id_col, seed).alias("_h"))
    narrow = saved(rows.select("doc_id", "source", "size", "_h"))
    rows = rows if kept else narrow
    by_source = targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeat)
    every = Window.partitionBy(F.lit(1))
    log2 = lambda x: F.length(F.bin(F.floor(x).cast("long"))) - 1
    least = F.coalesce(F.min(F.when(F.col("target") > 0, F.col("target"))).over(every), F.lit(0.0))
    by_source = (
        by_source.withColumn("_one", F.lit(1))
        .withColumn("_rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())))
        .withColumn("_block", F.least(F.lit(MOST_BLOCK), F.pow(F.lit(2), log2(least / BLOCKS)).cast("int")).cast("long"))
        .withColumn("_shards", F.greatest(F.lit(1), F.ceil(F.sum("source_size").over(every) / SHARD_WORDS)).cast("long"))
        .withColumn("_seats", F.floor(F.sum("target").over(every) / F.col("_block")).cast("long"))
    )
    by_source = saved(apportion(by_source, ["_one"], ["source"], "target", "_seats", "_quota"))
    plan = by_source.select(F.col("source").alias("_src"), "_rank", "_shards")
    if broadcastable(by_source):
        plan = F.broadcast(plan)

    def placed(df: DataFrame) -> DataFrame:
        """Rows with their cell: the source's rank, the shard, and the range of the seeded order within it.

        A shard is a run of the hash's last 20 bits, or of all its bits where there are more shards than those tell
        apart; a range is a run of its first bits, so ranges follow each other in the seeded order. Texts without words
        take nothing wherever they stand: kept apart in ranges below 0, they don't fill those that one task orders.
        """
        shard = F.pmod("_h", F.greatest(F.lit(1 << 20).cast("long"), F.col("_shards"))) % F.col("_shards")
        worded = F.shiftright("_h", HASH_BITS - RANGE_BITS)
        part = F.when(F.col("size") > 0, worded).otherwise(-1 - F.pmod("_h", F.lit(1 << 16))).cast("int")
        return df.join(plan, F.col("source").eqNullSafe(F.col("_src"))).withColumn("_shard", shard).withColumn("_part", part).drop("_src", "_shards")

    ranges = placed(narrow).groupBy("_rank", "_shard", "_part").agg(F.sum("size").alias("_in"))
    shards = ranges.groupBy("_rank", "_shard").agg(F.sum("_in").alias("_words"))
    shards = shards.join(by_source.select("_rank", "source_size", "target", "_block", "_quota"), "_rank")
    shards = apportion(shards, ["_rank"], ["_shard"], "_words", "_quota", "_blocks")
    quotas = shards.select("_rank", "_shard", "source_size", "target", "_words", F.least(F.col("_blocks") * F.col("_block"), repeat * F.col("_words")).alias("_take"))
    before = F.sum("_in").over(Window.partitionBy("_rank", "_shard").orderBy("_part")) - F.col("_in")
    cells = ranges.withColumn("_before", before).drop("_in").join(quotas, ["_rank", "_shard"])
    cells = cells.withColumnsRenamed({"_rank": "_r", "_shard": "_s", "_part": "_p"})
    # The join deals rows by cell and the window keeps that dealing, so texts that come along move once.
    rows = placed(rows).join(cells, (F.col("_rank") == F.col("_r")) & (F.col("_shard") == F.col("_s")) & (F.col("_part") == F.col("_p")))
    order = Window.partitionBy("_rank", "_shard", "_part").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_upto", F.col("_before") + F.sum("size").over(order))
    passes = F.when(F.col("_words") > 0, F.expr("_take div _words")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("_passes", passes)
    left = F.col("_take") - F.col("_passes") * F.col("_words") - (F.col("_upto") - F.col("size"))
    taken = F.col("_passes") * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(left, F.col("size")))
    return rows.select("doc_id", "source", *kept, "size", "source_size", "target", taken.alias("taken"))
