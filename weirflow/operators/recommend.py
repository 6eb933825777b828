"""Co-occurrence, complements, substitutes and reciprocal neighbours over (user, item) sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirflow.operators.relational import TASK_ROWS, spread


def item_counts(sessions: DataFrame) -> DataFrame:
    """(b, n): users of each item, of distinct (a: user, b: item) rows."""
    return sessions.groupBy("b").agg(F.count("*").alias("n"))


#: Rows of a key that a cell of a self-join takes from either side, so that no row holds a longer list of partners.
CELL = 2048
#: Pairs that meet in one task of the aggregation, on average; their number decides the tasks', so a task's memory doesn't grow with the tables.
TASK_PAIRS = 1_000_000
#: Tasks of the aggregation for which one task makes lists, on average; it holds all it makes until it has written it.
TASKS_FED = 10


def counted_pairs(rows: DataFrame, key: str, item: str) -> Row:
    """(pairs, rows, most, widest): pairs of rows under one key, rows, and rows of the largest key and of the commonest item; nulls don't count."""
    rows = rows.where(F.col(key).isNotNull() & F.col(item).isNotNull()).select(F.col(key).alias("_u"), F.col(item).alias("x"))
    sizes = rows.groupingSets([["_u"], ["x"]], "_u", "x").agg(F.grouping("_u").alias("_of"), F.count("*").alias("n"))
    of_key = lambda c: F.when(F.col("_of") == 0, c)
    return sizes.agg(F.sum(of_key(F.col("n") * (F.col("n") - 1.0) / 2)).alias("pairs"), F.sum(of_key(F.col("n"))).alias("rows"), F.max(of_key(F.col("n"))).alias("most"), F.max(F.when(F.col("_of") == 1, F.col("n"))).alias("widest")).first()


def rows_left(counted: Row) -> int:
    """Rows for `spread` of what is made of counted pairs: a task takes what TASKS_FED tasks of the aggregation leave of theirs."""
    return int((counted.pairs or 0.0) / TASKS_FED)


def fed(df: DataFrame, counted: Row, *by: str) -> DataFrame:
    """Rows made of counted pairs, dealt by `by` to tasks whose number follows the pairs.

    The planner would merge tasks by the bytes they read, so that a sort or window holds more rows as the tables grow.
    """
    return spread(df, rows_left(counted), *by)


def partners(rows: DataFrame, key: str, item: str, weight: str | None = None, cell: int = CELL, task_pairs: int = TASK_PAIRS, counted: Row | None = None) -> tuple[DataFrame, list[str]]:
    """(x, ys: items beyond x under one key, and wx, wys where a weight is named) and the columns by which they are dealt.

    Pairs move as lists, not as rows. The rows of a key that has more than `cell` are dealt by item to n lists and n parts,
    and each part meets each list in a place of its own. Items of more than `task_pairs` pairs (expected from their rows)
    have their partners dealt by hash (column k). Pairs are counted first, unless they are: their number gives the tasks', both of those that
    make lists and of those that take them. Tasks take ranges of items, so that what they write compresses well. None of it
    decides results.
    """
    rows = rows.where(F.col(key).isNotNull() & F.col(item).isNotNull()).select(F.col(key).alias("_u"), F.col(item).alias("x"), *([F.col(weight).alias("wx")] if weight else []))
    counted = counted or counted_pairs(rows, "_u", "x")
    pairs, most = counted.pairs or 0.0, counted.most or 0
    least = rows.sparkSession.sparkContext.defaultParallelism
    makers = max(least, int(pairs / task_pairs / TASKS_FED) + 1, (counted.rows or 0) // TASK_ROWS + 1)
    each = F.struct("x", "wx") if weight else F.col("x")
    if most > cell:
        hot = rows.groupBy(F.col("_u").alias("_k")).agg(F.ceil(F.count("*") / cell).cast("int").alias("_n")).where("_n > 1")
        df = rows.join(F.broadcast(hot), F.col("_u") == F.col("_k"), "left")  # of at most rows / cell rows
        df = df.withColumn("_n", F.coalesce("_n", F.lit(1))).withColumn("_i", F.pmod(F.xxhash64("x"), F.col("_n")).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
        lists = df.repartition(makers, "_u", "_i").groupBy("_u", "_i", "_n").agg(F.collect_list(each).alias("_l"))
        lists = lists.select(F.col("_u").alias("_v"), F.col("_i").alias("_m"), every.alias("_p"), "_l").repartition(makers, "_v", "_p", "_m")
        left = df.select("_u", "x", *(["wx"] if weight else []), "_i", every.alias("_j")).repartition(makers, "_u", "_i", "_j")
        met = left.join(lists, (F.col("_u") == F.col("_v")) & (F.col("_i") == F.col("_p")) & (F.col("_j") == F.col("_m")))
    else:
        lists = rows.repartition(makers, "_u").groupBy("_u").agg(F.collect_list(each).alias("_l"))
        met = lists.select(F.explode("_l").alias("_x"), "_l").select(*(["_x.x", "_x.wx"] if weight else [F.col("_x").alias("x")]), "_l")
    value = (lambda y: y["x"]) if weight else (lambda y: y)
    kept, by = lambda y: value(y) > F.col("x"), ["x"]
    per_row = pairs / max(counted.rows or 0, 1)  # partners of a row, on average
    if (counted.widest or 0) * per_row > task_pairs:
        wide = rows.groupBy(F.col("x").alias("_w")).agg(F.ceil(F.count("*") * F.lit(per_row / task_pairs)).cast("int").alias("_s")).where("_s > 1")
        met = met.join(F.broadcast(wide), F.col("x") == F.col("_w"), "left")  # of at most pairs / task_pairs rows
        met = met.withColumn("k", F.explode(F.sequence(F.lit(0), F.coalesce("_s", F.lit(1)) - 1)))
        near, by = kept, ["x", "k"]
        kept = lambda y: near(y) & (F.pmod(F.xxhash64(value(y)), F.coalesce("_s", F.lit(1)).cast("long")) == F.col("k"))
    lists = met.select(*by, *(["wx"] if weight else []), F.filter("_l", kept).alias("_l"))
    sides = [F.col("wx"), F.col("_l.x").alias("ys"), F.col("_l.wx").alias("wys")] if weight else [F.col("_l").alias("ys")]
    tasks = max(least, int(pairs / task_pairs) + 1)
    return lists.select(*by, *sides).repartitionByRange(tasks, *by), by


def meeting(rows: DataFrame, key: str, item: str, weight: str | None = None, cell: int = CELL, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """(x, y and wx, wy where a weight is named): every two rows of a key, x < y."""
    return _met(*partners(rows, key, item, weight, cell, task_pairs), weight).select("x", "y", *(["wx", "wy"] if weight else []))


def _met(lists: DataFrame, by: list[str], weight: str | None) -> DataFrame:
    """Lists of partners as rows, in the tasks to which the lists were dealt.

    Outer, as from the other kind Spark infers a filter on the lists that it pushes below the columns it needs.
    """
    if weight:
        df = lists.select(*by, "wx", "wys", F.posexplode_outer("ys").alias("_at", "y")).select(*by, "y", "wx", F.get("wys", F.col("_at")).alias("wy"))
    else:
        df = lists.select(*by, F.explode_outer("ys").alias("y"))
    return df.where(F.col("y").isNotNull())


def summed(rows: DataFrame, key: str, item: str, of: Column, weight: str | None = None, cell: int = CELL, task_pairs: int = TASK_PAIRS, counted: Row | None = None) -> DataFrame:
    """(x, y, w): an aggregate of every two rows of a key, for each two items, x < y; it needs no exchange beyond that of `partners`."""
    lists, by = partners(rows, key, item, weight, cell, task_pairs, counted)
    return _met(lists, by, weight).groupBy(*by, "y").agg(of.alias("w")).select("x", "y", "w")


def mirrored(half: DataFrame) -> DataFrame:
    """(a, b, w): pairs (x, y, w) in both directions."""
    both = F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("y").alias("a"), F.col("x").alias("b"))))
    return half.select(both.alias("p"), "w").select("p.a", "p.b", "w")


def cofrequency(sessions: DataFrame, least: int = 1, counted: Row | None = None) -> DataFrame:
    """(a, b, w): ordered pairs of different items with the number of users that have both.

    Half of the pairs are joined and counted; the other half mirrors them after the aggregation.
    """
    half = summed(sessions, "a", "b", F.count("*").cast("double"), counted=counted)
    if least > 1:
        half = half.where(F.col("w") >= least)
    return mirrored(half)


def adjacency(sessions: DataFrame, key: str, element: str) -> DataFrame:
    """Sorted list of elements of each key."""
    return sessions.groupBy(F.col(key).alias("id")).agg(F.sort_array(F.collect_list(element)).alias("elements"))


def places(sessions: DataFrame, key: str, element: str) -> DataFrame:
    """(id, n, pos, element): the adjacency as rows, so that no list of a hot key is ever made."""
    counts = sessions.groupBy(F.col(key).alias("_key")).agg(F.count("*").cast("int").alias("n"))
    pos = (F.row_number().over(Window.partitionBy(key).orderBy(element)) - 1).alias("pos")
    rows = sessions.select(F.col(key).alias("id"), pos, F.col(element).alias("element"))
    return rows.join(counts, F.col("id") == F.col("_key")).select("id", "n", "pos", "element")


def complements(sessions: DataFrame, least: int = 3, cosine: float = 0.01) -> DataFrame:
    """(a, b, w, aw, bw): pairs with an overlap of at least `least` and the cosine of their user sets."""
    counts, counted = item_counts(sessions), counted_pairs(sessions, "a", "b")
    df = with_counts(cofrequency(sessions, least, counted), counts, counted)
    return df.withColumn("w", F.col("w") / (F.sqrt("aw") * F.sqrt("bw"))).where(F.col("w") >= cosine).select("a", "b", "w", "aw", "bw")


def tfidf(pairs: DataFrame, counts: DataFrame, top: int = 50, least: int = 3, counted: Row | None = None) -> DataFrame:
    """(a, b, w): each item's `top` features by w*idf (ties to smaller b), of unit length.

    idf is ln((N+1)/df)+1 with N the largest item id; items of fewer than `least` features go. `counted`: of what the pairs are made.
    """
    n = counts.agg(F.max("b").cast("double").alias("N"))
    deal = lambda df, by: fed(df, counted, by) if counted else df
    df = deal(pairs, "b").join(deal(counts.select("b", F.greatest(F.col("n").cast("double"), F.lit(1.0)).alias("df")), "b"), "b")
    df = df.join(F.broadcast(n))  # one row
    df = deal(df.select("a", "b", (F.col("w") * (F.log((F.col("N") + 1) / F.col("df")) + 1)).alias("w")), "a")
    group = Window.partitionBy("a")
    df = df.withColumn("r", F.row_number().over(group.orderBy(F.col("w").desc(), "b"))).withColumn("n", F.count("*").over(group))
    df = df.where((F.col("n") >= least) & (F.col("r") <= top))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(group))
    return df.withColumn("l", length).where("l > 0").select("a", "b", (F.col("w") / F.col("l")).alias("w"))


def substitutes(vectors: DataFrame, least: float = 0.05) -> DataFrame:
    """(a, b, w): ordered pairs whose vectors (as floats) have a dot product of at least `least`."""
    half = summed(vectors.withColumn("w", F.col("w").cast("float")), "b", "a", F.sum(F.col("wx") * F.col("wy")), "w")
    return mirrored(half.where(F.col("w") >= least))


def with_counts(pairs: DataFrame, counts: DataFrame, counted: Row | None = None) -> DataFrame:
    """Adds aw and bw, the users of both items. `counted`: of what the pairs are made; a is joined last, so rows lie dealt by it."""
    deal = lambda df, by: fed(df, counted, by) if counted else df
    df = deal(pairs, "b").join(deal(counts.select("b", F.col("n").cast("double").alias("bw")), "b"), "b")
    df = deal(df, "a").join(deal(counts.select(F.col("b").alias("a"), F.col("n").cast("double").alias("aw")), "a"), "a")
    return df.select("a", "b", "w", "aw", "bw")


def best_neighbour(pairs: DataFrame, counts: DataFrame, min_users: float, min_sim: float) -> DataFrame:
    """(a, b, w, aw, bw) with a < b: each item's best neighbour (ties to smaller b) if it passes both thresholds.

    The best is found first and tested then, so a better neighbour with few users leaves none. It is an aggregate
    that combines before the exchange, and only the best meet their counts, so pairs don't move.
    """
    best = pairs.groupBy("a").agg(F.min(F.struct((-F.col("w")).alias("less"), "b")).alias("_best"))
    df = with_counts(best.select("a", "_best.b", (-F.col("_best.less")).alias("w")), counts)
    df = df.where((F.col("aw") >= min_users) & (F.col("bw") >= min_users) & (F.col("w") >= min_sim))
    swap = F.col("a") > F.col("b")
    side = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w", side("aw", "bw").alias("aw"), side("bw", "aw").alias("bw"))


def reciprocal(best: DataFrame) -> DataFrame:
    """Pairs that both sides chose, with the mean of their scores."""
    df = best.groupBy("a", "b").agg(F.count("*").alias("n"), F.avg("w").alias("w"), F.min("aw").alias("aw"), F.min("bw").alias("bw"))
    return df.where("n = 2").drop("n")
