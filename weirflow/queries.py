"""The registered queries of the dataflow engine, over the driver's tables.

Sessions are the distinct (customer, part) pairs of all orders; parts are the dictionary.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirflow.functions.records import registry
from weirflow.functions.text import id_bucket, poly_bucket, tokens
from weirflow.operators import recommend as rec
from weirflow.operators import relational as rel
from weirflow.plans.graph import Edge, Engine, Graph
from weirflow.plans.runs import Runner, Workspace

PARTS = 4
#: Thresholds of reciprocal neighbours that these tables' baskets can meet.
MIN_USERS, MIN_SIM = 20, 0.10
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a: customer, b: part) of every line item, repeats included."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    rows = max(orders.count(), items.count())
    orders, items = rel.spread(orders, rows, "o_orderkey"), rel.spread(items, rows, "l_orderkey")
    return orders.join(items, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("a"), F.col("l_partkey").alias("b"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.spread(baskets(spark, sf_dir), table(spark, sf_dir, "lineitem").count(), "a", "b").distinct()


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name")


def popular(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Row]:
    """Pairs of at least two users, and the counts of the pairs they are made of."""
    rows = sessions(spark, sf_dir)
    counted = rec.counted_pairs(rows, "a", "b")
    return rec.cofrequency(rows, 2, counted), counted


def popular_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return popular(spark, sf_dir)[0]


def titled(spark: SparkSession, sf_dir: str, names: DataFrame) -> DataFrame:
    """Popular pairs with the titles of both items."""
    df, counted = popular(spark, sf_dir)
    for side in ("b", "a"):
        df = rel.enrich(df, names, side, "p_partkey", "p_name", f"{side}_title", rows=rec.rows_left(counted))
    return df


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(tokens(F.col("text"))).alias("str"), F.lit(1.0).alias("w"))


# Sources, sinks and maps


@query
def scan_parquet(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("total"))


@query
def identity_copy(spark, sf_dir):
    return table(spark, sf_dir, "nation")


@query
def tokenize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "word"))


@query
def word_count(spark, sf_dir):
    return registry()["StringWeight"].reduce(words(spark, sf_dir), "Sort_Str", "Sum_W").orderBy(F.col("w").desc(), "str").select(F.col("str").alias("word"), "w")


@query
def format_text(spark, sf_dir):
    return word_count(spark, sf_dir).select(F.format_string("%s\t%.0f", "word", "w").alias("line"))


@query
def json_extract(spark, sf_dir):
    props = F.from_json("props", "k int")
    return table(spark, sf_dir, "events").select("event_id", "event_type", props["k"].alias("k")).where("event_type is not null and k is not null")


@query
def generator_clicks(spark, sf_dir):
    from weirflow.plans.examples import clicks

    return clicks(spark)


@query
def filter_route(spark, sf_dir):
    """Pairs of at least two users, keyed anew by their second item."""
    return popular_pairs(spark, sf_dir).where("w >= 2").select(F.col("b").alias("key"), "a", "b", "w")


@query
def local_id_roundtrip(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", id_bucket(F.col("p_partkey"), PARTS).alias("p"), F.expr(f"p_partkey div {PARTS}").alias("local"))
    return df.withColumn("back", F.col("local") * PARTS + F.col("p"))


# Exchange


@query
def shuffle_bucket_counts(spark, sf_dir):
    return rel.health(sessions(spark, sf_dir), id_bucket(F.col("a"), PARTS), PARTS).select("p", "n")


@query
def hash131_bucket(spark, sf_dir):
    return titles(spark, sf_dir).select("p_partkey", poly_bucket(F.col("p_name"), PARTS).alias("p"))


@query
def round_robin_scatter(spark, sf_dir):
    """Scattered evenly over the partitions; which row goes where is not part of the result."""
    df = table(spark, sf_dir, "events").select("event_id", "user_id").repartition(PARTS).withColumn("p", F.spark_partition_id())
    return df.select("event_id", "user_id")


@query
def read_first_broadcast(spark, sf_dir):
    """Every order meets partition 0 of the customers."""
    first = table(spark, sf_dir, "customer").where(F.pmod("c_custkey", F.lit(PARTS)) == 0)
    return rel.lookup(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), first, "o_custkey", "c_custkey", ["c_name"])


@query
def all_to_all_cross(spark, sf_dir):
    return rel.every_pair(table(spark, sf_dir, "nation").select("n_nationkey"), table(spark, sf_dir, "region").select("r_regionkey"))


@query
def global_gather(spark, sf_dir):
    """Partition counts gathered into one row; combined before they meet."""
    counts = table(spark, sf_dir, "lineitem").groupBy(id_bucket(F.col("l_orderkey"), PARTS).alias("p")).agg(F.count("*").alias("n"))
    return counts.agg(F.sum("n").alias("n"), F.count("*").alias("parts"))


@query
def partition_health(spark, sf_dir):
    """Nations over 32 partitions by key: some are empty."""
    return rel.health(table(spark, sf_dir, "nation"), id_bucket(F.col("n_nationkey"), 32), 32)


# Sort, limit, top-k


@query
def sort_desc(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_size").orderBy(F.col("p_size").desc(), "p_partkey")


@query
def sort_within_partition(spark, sf_dir):
    """Each session's place in its partition by (a, b)."""
    df = sessions(spark, sf_dir).withColumn("p", id_bucket(F.col("a"), PARTS))
    return rel.numbered(df, ["p"], ["a", "b"]).withColumn("place", F.col("place").cast("int"))


@query
def sortedness_check(spark, sf_dir):
    """Violations by partition after a sort within partitions: none."""
    df = sessions(spark, sf_dir).withColumn("p", id_bucket(F.col("a"), PARTS))
    return rel.sorted_violations(rel.by_ranges(df, ["p", "a", "b"], table(spark, sf_dir, "lineitem").count()), "p", ["a", "b"])


@query
def limit_per_partition(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return rel.limit_per_partition(df, id_bucket(F.col("o_custkey"), PARTS), [F.col("o_orderkey")], 10)


@query
def topk_per_group(spark, sf_dir):
    return rel.top_k(popular_pairs(spark, sf_dir), ["a"], [F.col("w").desc(), F.col("b")], 20)


# Aggregation and grouping


@query
def reduce_sum(spark, sf_dir):
    return rel.reduce_sum(table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_quantity").alias("w")), ["l_partkey"])


@query
def two_phase_agg(spark, sf_dir):
    """Per part: the largest quantity a supplier ships in all, by a sum combiner and a max combiner."""
    df = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    return rel.two_phase(df, ["l_partkey"], F.col("l_suppkey"), {"s": F.sum("l_quantity")}, {"most": F.max("s"), "suppliers": F.count("*")})


@query
def dedup_sessions(spark, sf_dir):
    return sessions(spark, sf_dir)


@query
def keep_first_dict(spark, sf_dir):
    """One item for each title."""
    return rel.keep_first(table(spark, sf_dir, "part").select("p_type", "p_name", "p_partkey"), ["p_type"], ["p_name", "p_partkey"])


@query
def item_counts(spark, sf_dir):
    return rec.item_counts(sessions(spark, sf_dir))


@query
def chained_grouping(spark, sf_dir):
    from weirflow.plans.examples import click_report, clicks

    return click_report(clicks(spark))


@query
def group_merge_union(spark, sf_dir):
    """Customers and suppliers merged by nation."""
    sides = [table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.lit(1).alias("x")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.lit(1).alias("x"))]
    return rel.merge_groups(sides, ["k"], {"n": F.count("*")})


@query
def union_distinct(spark, sf_dir):
    customers, suppliers = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return customers.select(F.col("c_nationkey").alias("k")).unionByName(suppliers.select(F.col("s_nationkey").alias("k"))).distinct()


@query
def encode_users(spark, sf_dir):
    return rel.dense_ids(table(spark, sf_dir, "orders"), "o_custkey", id_bucket(F.col("o_custkey"), PARTS), PARTS)


@query
def encode_items(spark, sf_dir):
    """Dense ids of titles, dealt to partitions by their string hash."""
    return rel.dense_ids(titles(spark, sf_dir), "p_name", poly_bucket(F.col("p_name"), PARTS), PARTS)


@query
def item_to_users(spark, sf_dir):
    return rec.places(sessions(spark, sf_dir), "b", "a")


@query
def user_to_items(spark, sf_dir):
    return rec.places(sessions(spark, sf_dir), "a", "b")


# Joins


@query
def enrich_left_join(spark, sf_dir):
    """Titles for both items of a pair; parts of odd key have none and stand under their key."""
    return titled(spark, sf_dir, titles(spark, sf_dir).where("p_partkey % 2 = 0"))


@query
def enrich_unknown(spark, sf_dir):
    names = titles(spark, sf_dir).where("p_partkey % 2 = 0")
    return rel.enrich(rec.item_counts(sessions(spark, sf_dir)), names, "b", "p_partkey", "p_name", "title", F.lit("UNKNOWN"))


@query
def enrich_titles(spark, sf_dir):
    """Titles for both items of a pair, from the whole dictionary."""
    return titled(spark, sf_dir, titles(spark, sf_dir))


@query
def enrich_unlabelled(spark, sf_dir):
    """The quality of every document from the whole table of labels, which doesn't name them all."""
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min(F.col("quality").cast("string")).alias("mark"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return rel.enrich(docs, marks, "doc_id", "doc_id", "mark", "quality", F.lit("UNKNOWN"))


@query
def loaded_partitions(spark, sf_dir):
    """A table that every partition loads: its rows tell which partition they are from."""
    graph = Graph()
    rows = table(spark, sf_dir, "supplier").select(id_bucket(F.col("s_suppkey"), PARTS).alias("p"), F.col("s_suppkey").cast("long").alias("val"))
    graph.task("load", lambda ctx: {"s": rows}).output("s", "UInt32")
    body = lambda ctx: {"out": ctx.loaded("s").groupBy("source_p").agg(F.count("*").alias("n"), F.sum("val").alias("total"))}
    graph.task("read", body).input("s", "load", tagged=True).output("out")
    return Engine(spark, graph, PARTS).plan()["read", "out"]


@query
def master_dict(spark, sf_dir):
    """Item ids with their titles, from the id dictionary and the title dictionary."""
    ids = rel.dense_ids(table(spark, sf_dir, "lineitem"), "l_partkey", id_bucket(F.col("l_partkey"), PARTS), PARTS)
    return rel.enrich(ids, titles(spark, sf_dir), "l_partkey", "p_partkey", "p_name", "title", F.lit("UNKNOWN")).select("id", "l_partkey", "title")


@query
def broadcast_lookup(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    return rel.lookup(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), nation, "c_nationkey", "n_nationkey", ["n_name"])


@query
def semi_join_ref(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query
def anti_join_ref(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


# Recommenders


@query
def cofreq_pairs(spark, sf_dir):
    return rec.cofrequency(sessions(spark, sf_dir))


@query
def cofreq_inverted(spark, sf_dir):
    return popular_pairs(spark, sf_dir)


@query
def complements(spark, sf_dir):
    return rec.complements(sessions(spark, sf_dir)).withColumn("w", F.round("w", 4))


@query
def complements_topk(spark, sf_dir):
    return rel.top_k(rec.complements(sessions(spark, sf_dir)), ["a"], [F.col("w").desc(), F.col("b")], 20).select("a", "b", F.round("w", 4).alias("w"), "rank")


def weighed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Row]:
    """Feature vectors, and the counts of the pairs they are made of."""
    pairs, counted = popular(spark, sf_dir)
    return rec.tfidf(pairs, rec.item_counts(sessions(spark, sf_dir)), counted=counted), counted


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighed(spark, sf_dir)[0]


@query
def tfidf_norm(spark, sf_dir):
    return vectors(spark, sf_dir).withColumn("w", F.round("w", 6))


@query
def feature_lists(spark, sf_dir):
    """Items under each feature, exploded in order, with their float weights."""
    rows, counted = weighed(spark, sf_dir)
    rows = rec.fed(rows.select(F.col("b").alias("feature"), F.col("a").alias("id"), F.col("w").cast("float").alias("w")), counted, "feature")
    pos = (F.row_number().over(Window.partitionBy("feature").orderBy("id")) - 1).alias("pos")
    return rows.select("feature", pos, "id", F.round(F.col("w").cast("double"), 5).alias("w"))


@query
def substitutes(spark, sf_dir):
    return rec.substitutes(vectors(spark, sf_dir)).withColumn("w", F.round("w", 4))


@query
def substitutes_topk(spark, sf_dir):
    df = rec.substitutes(vectors(spark, sf_dir))
    return rel.top_k(df, ["a"], [F.col("w").desc(), F.col("b")], 20).select("a", "b", F.round("w", 4).alias("w"), "rank")


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = rec.item_counts(sessions(spark, sf_dir))
    return rec.best_neighbour(rec.substitutes(vectors(spark, sf_dir)), counts, MIN_USERS, MIN_SIM)


@query
def rnn_top1(spark, sf_dir):
    return best(spark, sf_dir).withColumn("w", F.round("w", 4))


@query
def rnn_pairs(spark, sf_dir):
    return rec.reciprocal(best(spark, sf_dir)).withColumn("w", F.round("w", 4))


@query
def topk_json(spark, sf_dir):
    """For each item one JSON object with its 20 best complements in order."""
    df = rel.top_k(rec.complements(sessions(spark, sf_dir)), ["a"], [F.col("w").desc(), F.col("b")], 20)
    df = rel.enrich(rel.enrich(df, titles(spark, sf_dir), "b", "p_partkey", "p_name", "bt"), titles(spark, sf_dir), "a", "p_partkey", "p_name", "at")
    each = F.struct("rank", F.struct(F.col("b").alias("id"), F.col("bt").alias("title"), F.format_string("%.4f", "w").alias("score")).alias("r"))
    df = df.groupBy("a", "at").agg(F.sort_array(F.collect_list(each)).alias("l"))
    return df.select("a", F.to_json(F.struct(F.col("a").alias("id"), F.col("at").alias("title"), F.transform("l", lambda x: x["r"]).alias("recommendations"))).alias("line"))


@query
def buddies_json(spark, sf_dir):
    df = rec.reciprocal(best(spark, sf_dir))
    df = rel.enrich(rel.enrich(df, titles(spark, sf_dir), "a", "p_partkey", "p_name", "at"), titles(spark, sf_dir), "b", "p_partkey", "p_name", "bt")
    fields = [F.col("a").alias("id_a"), F.col("at").alias("title_a"), F.format_string("%.0f", "aw").alias("users_a"), F.col("b").alias("id_b"), F.col("bt").alias("title_b"), F.format_string("%.0f", "bw").alias("users_b"), F.format_string("%.4f", "w").alias("score")]
    return df.select("a", "b", F.to_json(F.struct(*fields)).alias("line"))


# Control flow


@query
def branch_union(spark, sf_dir):
    from weirflow.plans.examples import branching

    return branching(spark)


@query
def branch_starved(spark, sf_dir):
    """Partitions of the converging task that all their sources skipped."""
    from weirflow.plans.examples import starved

    return starved(spark)


@query
def prev_run_delta(spark, sf_dir):
    """Sessions of this run that the previous run (orders before 1997) didn't have."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    both = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    before = both.where("o_orderdate < timestamp '1997-01-01 00:00:00'").select(F.col("o_custkey").alias("a"), F.col("l_partkey").alias("b"))
    return sessions(spark, sf_dir).join(before, ["a", "b"], "left_anti")


# The engine itself, over several partitions


@query
def hash131_five(spark, sf_dir):
    """String hash over five buckets: the 64-bit value wraps before the modulus."""
    return titles(spark, sf_dir).select("p_partkey", poly_bucket(F.col("p_name"), 5).alias("p"))


@query
def round_robin_balance(spark, sf_dir):
    """Rows of each partition of a round-robin port: at most one apart."""
    graph = Graph()
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("val"))
    graph.task("make", lambda ctx: {"n": rows}).output("n", "UInt32", shuffle="round_robin")
    graph.task("read").input("n", "make", Edge.SHUFFLE).output("out")
    made = Engine(spark, graph, PARTS).plan()["read", "out"]
    return made.groupBy("p").agg(F.count("*").alias("n"))


def _spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows over producer partitions that have nothing to do with their keys."""
    return df.withColumn("p", F.pmod(F.xxhash64(*by), F.lit(PARTS)).cast("int"))


@query
def word_count_graph(spark, sf_dir):
    """Words made in every partition, dealt by hash and summed over all producers at the reader."""
    graph = Graph()
    split = F.explode(tokens(F.col("text"))).alias("str")
    rows = _spread(table(spark, sf_dir, "documents"), "doc_id").select("p", F.lit(1.0).alias("w"), split)
    graph.task("split", lambda ctx: {"w": rows}).output("w", "StringWeight", shuffle="Hash_Str", order="Sort_Str", reducer="Sum_W")
    graph.task("count").input("w", "split", Edge.SHUFFLE).output("out", "StringWeight", order="Sort_W_Desc")
    return Engine(spark, graph, PARTS).plan()["count", "out"].select(F.col("str").alias("word"), "w", "p")


@query
def dedup_graph(spark, sf_dir):
    """Sessions of every line item, of which each producer and then each reader keeps the first."""
    graph = Graph()
    rows = _spread(baskets(spark, sf_dir).withColumn("x", F.rand(7)), "x").drop("x")
    graph.task("load", lambda ctx: {"s": rows}).output("s", "UInt32Pair", shuffle="Hash_A", order="Sort_A_B", first=True)
    graph.task("read").input("s", "load", Edge.SHUFFLE).output("out", "UInt32Pair")
    return Engine(spark, graph, PARTS).plan()["read", "out"].select("a", "b", "p")


@query
def union_reduce_graph(spark, sf_dir):
    """Two tasks' weighted words, united at a shuffled input and summed over both."""
    graph = Graph()
    for name in ("customer", "supplier"):
        key = F.concat(F.lit("nation "), F.col(f"{name[0]}_nationkey"))
        rows = _spread(table(spark, sf_dir, name), f"{name[0]}_{name[:4]}key").select("p", F.lit(1.0).alias("w"), key.alias("str"))
        graph.task(name, lambda ctx, rows=rows: {"w": rows}).output("w", "StringWeight", shuffle="Hash_Str", order="Sort_Str", reducer="Sum_W")
    graph.task("sum").input("w", "customer|supplier", Edge.SHUFFLE).output("out", "StringWeight")
    return Engine(spark, graph, PARTS).plan()["sum", "out"].select("str", "w", "p")


@query
def sort_violations_planted(spark, sf_dir):
    """Customers whose latest order isn't their dearest: rows out of order, counted in a table that holds some."""
    df = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("double").alias("price"))
    before = F.lag("price").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    df = df.withColumn("before", before).where(F.col("before") > F.col("price"))
    return df.groupBy(id_bucket(F.col("o_custkey"), PARTS).alias("p")).agg(F.count("*").alias("violations"))


@query
def branch_by_table(spark, sf_dir):
    """Branches over data: orders go to one of two tasks by partition, the third partition to both, the fourth to none."""
    graph = Graph()
    rows = table(spark, sf_dir, "orders").select(id_bucket(F.col("o_orderkey"), PARTS).alias("p"), F.col("o_orderkey").cast("long").alias("val"))
    route = graph.task("route", lambda ctx: {"even": rows, "odd": rows}).output("even", "UInt32").output("odd", "UInt32")
    route.skip("even", lambda p, _: p in (1, 3)).skip("odd", lambda p, _: p in (0, 3))
    for way in ("even", "odd"):
        body = lambda ctx, way=way: {"done": ctx.inputs[way].withColumn("way", F.lit(way))}
        graph.task(way, body).input(way, "route", Edge.PARTITION).output("done")
    graph.task("end").input("done", "even|odd", Edge.PARTITION).output("out")
    made = Engine(spark, graph, PARTS).plan()["end", "out"]
    return made.groupBy("p", "way").agg(F.count("*").alias("n"), F.sum("val").alias("total"))


@query
def prev_run_sessions(spark, sf_dir):
    """Two runs of a workspace: the second reads the sessions that the first left and keeps what is new."""
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = both.select(F.col("o_custkey").cast("long").alias("a"), F.col("l_partkey").cast("long").alias("b"), "o_orderdate").withColumn("p", id_bucket(F.col("a"), PARTS))
    until = {"0": "1997-01-01", "1": "2100-01-01"}

    def load(ctx):
        run = ctx.engine.store.run
        new = rows.where(F.col("o_orderdate") < F.lit(until[str(run)]).cast("timestamp")).select("p", "a", "b")
        return {"all": new, "fresh": new.join(ctx.inputs["before"].select("a", "b"), ["a", "b"], "left_anti")}

    graph = Graph()
    task = graph.task("load", load).input_previous("before", "load", "all")
    for name in ("all", "fresh"):
        task.output(name, "UInt32Pair", order="Sort_A_B", first=True, keep=True)
    root = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    for _ in until:
        ws = Workspace.next_run(spark, root)
        Runner(Engine(spark, graph, PARTS), ws).run()
    return ws.load("load", "fresh").select("a", "b")


def shared_folder(spark: SparkSession) -> str:
    """Where workspaces of queries lie: the cluster's checkpoint folder, or in local mode a temporary one."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not at and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return at or tempfile.mkdtemp(prefix="weirflow-")
