"""Small graphs: conditional branching with starvation, and chained grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.plans.graph import Edge, Engine, Graph

CLICKS = [("Search", "north"), ("Search", "south"), ("Tools", "anvil"), ("Tools", "chisel"), ("Tools", "anvil"), ("Search", "north")]


def clicks(spark: SparkSession, events: list[tuple[str, str]] | None = None, times: int = 10) -> DataFrame:
    """A generator: every event `times` times with weight 1."""
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in events or CLICKS])).alias("e")
    return spark.range(times).select(each).select(F.lit(1.0).alias("w"), "e.a", "e.b")


def click_report(df: DataFrame) -> DataFrame:
    """Combined by category and page, then grouped by category within the same task."""
    graph = Graph()
    graph.task("generator", lambda ctx: {"raw": df}, partitioned=False).output("raw", "StringPairWeight", order="Sort_A_B", reducer="Sum_W")

    def report(ctx):
        page = F.struct("b", "w")
        text = lambda x: F.format_string("%s (%.0f)", x["b"], x["w"])
        rows = ctx.inputs["raw"].groupBy("a").agg(F.sort_array(F.collect_list(page)).alias("l"), F.sum("w").alias("total"))
        return {"report": rows.select("a", F.array_join(F.transform("l", text), ", ").alias("urls"), "total")}

    graph.task("analyzer", report, partitioned=False).input("raw", "generator", Edge.PARTITION).output("report")
    return Engine(df.sparkSession, graph, 1).plan()["analyzer", "report"]


def branching_graph() -> Graph:
    """Partition 0 goes even, 1 odd, 2 both ways, 3 neither; both branches converge in a union."""
    graph = Graph()

    def router(ctx):
        text = lambda way: F.format_string(f"partition %d goes {way}", "p").alias("str")
        return {way: ctx.generate(text(way)) for way in ("even", "odd")}

    route = graph.task("router", router).output("even", "StringSingleton").output("odd", "StringSingleton")
    route.skip("even", lambda p, _: p % 4 in (1, 3)).skip("odd", lambda p, _: p % 4 in (0, 3))
    for way, mark in (("even", "[EVEN] "), ("odd", "[ODD]  ")):
        body = lambda ctx, way=way, mark=mark: {"done": ctx.inputs[way].select("p", F.concat(F.lit(mark), "str").alias("str"))}
        graph.task(f"process_{way}", body).input(way, "router", Edge.PARTITION, expect="StringSingleton").output("done", "StringSingleton")
    end = graph.task("converge", lambda ctx: {"text": ctx.inputs["done"].select("p", F.concat(F.lit("Convergence Reached: "), "str").alias("str"))})
    end.input("done", "process_even|process_odd", Edge.PARTITION).output("text", "StringSingleton")
    return graph


def branching(spark: SparkSession, partitions: int = 4) -> DataFrame:
    return Engine(spark, branching_graph(), partitions).plan()["converge", "text"]


def starved(spark: SparkSession, partitions: int = 4) -> DataFrame:
    """Partitions in which nothing reaches the converging task."""
    alive = Engine(spark, branching_graph(), partitions).alive()["converge"]
    return spark.range(partitions).select(F.col("id").cast("int").alias("p")).where(~F.col("p").isin(sorted(alive)))
