"""Graphs: goldens of the small examples, edges, skips, validation, sub-graphs."""

import pytest
from pyspark.sql import functions as F

from weirflow.functions.records import registry
from weirflow.plans.examples import branching, branching_graph, click_report, clicks, starved
from weirflow.plans.graph import Edge, Engine, Graph, GraphError


def pairs(spark):
    return lambda ctx: {"out": spark.createDataFrame([(0, "x", "1"), (1, "y", "2"), (1, "x", "1"), (3, "z", "3")], "p int, a string, b string")}


def test_branching(spark):
    rows = {(r.p, r.str) for r in branching(spark).collect()}
    assert rows == {
        (0, "Convergence Reached: [EVEN] partition 0 goes even"),
        (1, "Convergence Reached: [ODD]  partition 1 goes odd"),
        (2, "Convergence Reached: [EVEN] partition 2 goes even"),
        (2, "Convergence Reached: [ODD]  partition 2 goes odd"),
    }
    assert [r.p for r in starved(spark).collect()] == [3]
    assert [r.p for r in starved(spark, 8).orderBy("p").collect()] == [3, 7]


def test_full_dependency_on_a_skipped_task_starves():
    graph = branching_graph()
    graph.task("report", lambda ctx: {}).depends("converge")
    graph.task("same", lambda ctx: {}).depends("converge", partial=True)
    alive = Engine(None, graph, 4).alive()
    assert alive["report"] == frozenset() and alive["same"] == {0, 1, 2}


def test_chaining(spark):
    df = clicks(spark)
    assert df.count() == 60
    rows = {r.a: (r.urls, r.total) for r in click_report(df).collect()}
    assert rows == {"Search": ("north (20), south (10)", 30.0), "Tools": ("anvil (20), chisel (10)", 30.0)}


@pytest.mark.parametrize("partitions", [1, 3, 4])
def test_edges(spark, partitions):
    graph = Graph()
    graph.task("make", pairs(spark)).output("out", "StringPair")
    graph.task("deal", lambda ctx: {"out": ctx.inputs["out"]}).input("out", "make", Edge.PARTITION).output("out", "StringPair", shuffle="Hash_A", order="Sort_A_B", first=True)
    graph.task("all", lambda ctx: {"out": ctx.inputs["x"]}).input("x", "make", Edge.ALL_TO_ALL, "out").output("out")
    graph.task("zero", lambda ctx: {"out": ctx.inputs["x"]}).input("x", "make", Edge.FIRST, "out").output("out")
    graph.task("read", lambda ctx: {"out": ctx.inputs["x"]}).input("x", "deal", Edge.SHUFFLE, "out").output("out")
    graph.task("copy").input("x", "make", Edge.ALL_TO_ALL, "out").output("one").output("two")
    made = Engine(spark, graph, 4).plan()
    assert sorted(r.a for r in made["all", "out"].collect()) == ["x", "x", "y", "z"]
    assert [r.a for r in made["zero", "out"].collect()] == ["x"]
    rows = made["read", "out"].collect()
    assert sorted((r.a, r.b) for r in rows) == [("x", "1"), ("y", "2"), ("z", "3")]  # the reader keeps the first of all producers
    assert {r.p for r in rows if r.a == "x"} == {ord("x") % 4}
    assert made["copy", "one"].count() == made["copy", "two"].count() == 4


def test_input_limit_is_per_partition(spark):
    graph = Graph()
    graph.task("make", pairs(spark)).output("out", "StringPair")
    graph.task("few", lambda ctx: {"out": ctx.inputs["x"]}).input("x", "make", Edge.PARTITION, "out", limit=1).output("out")
    rows = Engine(spark, graph, 4).plan()["few", "out"].collect()
    assert sorted((r.p, r.a) for r in rows) == [(0, "x"), (1, "x"), (3, "z")]


def wired(**more):
    graph = Graph()
    graph.task("a", lambda ctx: {}).output("plain").output("typed", "StringPair").output("dealt", "StringPair", shuffle="Hash_A").output("own", internal=True)
    graph.task("one", lambda ctx: {}, partitioned=False).output("out")
    task = graph.task("b", lambda ctx: {})
    return graph, task


@pytest.mark.parametrize(
    ("source", "edge", "port", "more"),
    [
        ("nobody", Edge.PARTITION, "x", {}),
        ("a", Edge.PARTITION, "nothing", {}),
        ("a", Edge.PARTITION, "dealt", {}),
        ("a", Edge.ALL_TO_ALL, "dealt", {}),
        ("a", Edge.SHUFFLE, "typed", {}),
        ("a", Edge.PARTITION, "typed", {"expect": "UInt32"}),
        ("a", Edge.PARTITION, "plain", {"expect": "StringPair"}),
        ("a", Edge.PARTITION, "own", {}),
        ("one", Edge.PARTITION, "out", {}),
    ],
)
def test_bad_edges(source, edge, port, more):
    graph, task = wired()
    task.input("x", source, edge, port, **more)
    with pytest.raises(GraphError):
        graph.validate()


@pytest.mark.parametrize(
    "more",
    [
        {"kind": "NoSuchType"},
        {"shuffle": "Hash_A"},
        {"order": "Sort_A"},
        {"reducer": "Sum_W"},
        {"kind": "StringPair", "shuffle": "Hash_Z"},
        {"kind": "StringPair", "order": "Sort_Z"},
        {"kind": "StringPair", "order": "Sort_A", "reducer": "Sum_W"},
        {"kind": "StringPairWeight", "reducer": "Sum_W"},
        {"kind": "StringPair", "shuffle": "Hash_A", "internal": True},
    ],
)
def test_bad_outputs(more):
    with pytest.raises(GraphError):
        Graph().task("a").output("x", **more)


def test_more_that_can_not_run(spark):
    graph, task = wired()
    with pytest.raises(GraphError):
        task.input("x", "a", "partition", "plain")
    task.input("x", "a", Edge.PARTITION, "plain").input("y", "one", Edge.ALL_TO_ALL, "out")
    with pytest.raises(GraphError):
        task.input("x", "a", Edge.PARTITION, "plain")
    loop = Graph()
    loop.task("a").input("x", "b", Edge.PARTITION, "y").output("y")
    loop.task("b").input("x", "a", Edge.PARTITION, "y").output("y")
    with pytest.raises(GraphError, match="cycle"):
        loop.validate()
    both = Graph()
    for name in ("a", "b"):
        both.task(name, pairs(spark)).output("out")
    both.task("copy").input("x", "a", Edge.PARTITION, "out").input("y", "b", Edge.PARTITION, "out").output("z")
    with pytest.raises(GraphError, match="copies one input"):
        Engine(spark, both, 4).plan()
    short = Graph()
    short.task("a", lambda ctx: {"out": spark.createDataFrame([("x",)], "a string")}).output("out", "StringPair")
    with pytest.raises(GraphError, match="without b"):
        Engine(spark, short, 4).plan()


def test_registering_again_changes_nothing():
    graph, kinds = Graph(), registry()
    assert graph.task("a", len) is graph.task("a", max) and graph.task("a").body is len
    assert kinds.register(registry()["UInt32"]) is kinds["UInt32"]
    with pytest.raises(KeyError):
        kinds["StringPair"].order("Sort_Z")


def test_pipelines(spark):
    graph = Graph()
    outer = graph.pipeline("outer", least=2)
    inner = outer.pipeline("inner", most=3)
    assert inner.config == {"least": 2, "most": 3}
    inner.task("make", pairs(spark)).output("out", "StringPair")
    inner.expose_output("rows", "make", "out")
    outer.expose_nested("rows", inner, "rows")
    reader = graph.pipeline("reader")
    reader.bind_link("rows", outer, "rows")
    task = reader.task("read", lambda ctx: {"out": ctx.inputs["x"].groupBy("a").agg(F.count("*").alias("n"))}, partitioned=False)
    assert reader.connect(task, "x", "rows", Edge.ALL_TO_ALL)
    assert not reader.connect(task, "more", "missing", optional=True)
    task.output("out")
    reader.sibling(reader.task("last", partitioned=False), "x", "read", "out").output("out")
    assert {(r.a, r.n) for r in Engine(spark, graph, 4).plan()["reader.last", "out"].collect()} == {("x", 2), ("y", 1), ("z", 1)}
    with pytest.raises(GraphError):
        outer.source("other")
    with pytest.raises(GraphError):
        reader.connect(task, "y", "missing")
    assert "outer.inner.make" in graph.describe() and "[all_to_all]" in graph.describe()


@pytest.mark.parametrize("partitions", [1, 3, 4, 5])
def test_reducers_combine_over_all_producers(spark, partitions):
    """Each of several producer partitions makes the same words; readers of every kind of edge see one sum."""
    make = lambda ctx: {"w": ctx.generate().select("p", F.lit(1.0).alias("w"), F.explode(F.array(F.lit("the"), F.lit("fox"), F.lit("the"))).alias("str"))}
    graph = Graph()
    port = {"order": "Sort_Str", "reducer": "Sum_W"}
    for name in ("one", "two"):
        graph.task(name, make).output("w", "StringWeight", shuffle="Hash_Str", **port)
        graph.task(f"{name}_plain", make).output("w", "StringWeight", **port)
    graph.task("dealt").input("w", "one", Edge.SHUFFLE).output("out")
    graph.task("both").input("w", "one|two", Edge.SHUFFLE).output("out")
    graph.task("all").input("w", "one_plain", Edge.ALL_TO_ALL).output("out")
    graph.task("own").input("w", "one_plain|two_plain", Edge.PARTITION).output("out")
    made = Engine(spark, graph, partitions).plan()
    sums = lambda name: sorted((r.str, r.w) for r in made[name, "out"].collect())
    n = float(partitions)
    assert sums("dealt") == sums("all") == [("fox", n), ("the", 2 * n)]
    assert sums("both") == [("fox", 2 * n), ("the", 4 * n)]
    assert sums("own") == sorted([("fox", 2.0), ("the", 4.0)] * partitions)


def test_round_robin_and_reading_options(spark):
    graph = Graph()
    rows = spark.range(103).select(F.lit(1.0).alias("w"), F.concat(F.lit("x"), F.col("id") % 7).alias("str"))
    graph.task("make", lambda ctx: {"w": rows}).output("w", "StringWeight", shuffle="round_robin", order="Sort_W_Desc")
    graph.task("read").input("w", "make", Edge.SHUFFLE).output("out")
    graph.task("files", lambda ctx: {"out": ctx.inputs["w"]}, partitioned=False).input_files("w", lambda s: rows, expect="StringWeight", reducer="Sum_W", order="Sort_Str", limit=2).output("out")
    made = Engine(spark, graph, 4).plan()
    counts = [r["count"] for r in made["read", "out"].groupBy("p").count().collect()]
    assert sorted(counts) == [25, 26, 26, 26]
    assert [(r.str, r.w) for r in made["files", "out"].collect()] == [("x0", 15.0), ("x1", 15.0)]
    with pytest.raises(GraphError):
        Graph().task("a").output("x", format="paper")


def test_inputs_handed_inwards_and_outputs_outwards(spark):
    graph = Graph()
    graph.task("make", pairs(spark)).output("out", "StringPair")
    outer = graph.pipeline("outer").bind_input("rows", "make", "out")
    inner = outer.pipeline("inner")
    outer.expose_input("rows", inner, "got")
    task = inner.task("count", lambda ctx: {"n": ctx.inputs["x"].groupBy().count(), "m": ctx.inputs["none"]}, partitioned=False)
    assert inner.connect(task, "x", "got") and not inner.connect(task, "none", "nowhere", empty="StringPair")
    task.output("n").output("m", "StringPair")
    inner.expose_output("n", "count", "n").bind_output("n", outer, "total")
    name, port = outer.source("total")
    made = Engine(spark, graph, 4).plan()
    assert made[name, port].first()["count"] == 4 and made[name, "m"].count() == 0


def test_tagged_inputs_tell_source_partitions(spark):
    seen = {}

    def look(ctx):
        seen["all"] = sorted((r.source_p, r.a) for r in ctx.loaded("out").collect())
        seen["one"] = sorted(r.a for r in ctx.loaded("out", 1).collect())
        with pytest.raises(GraphError):
            ctx.loaded("plain")
        return {"n": ctx.inputs["out"].groupBy("source_p").count()}

    def graph(**more):
        graph = Graph()
        graph.task("make", pairs(spark)).output("out", "StringPair")
        graph.task("look", look).input("out", "make", tagged=True, **more).input("plain", "make", Edge.ALL_TO_ALL, "out").output("n")
        return graph

    made = Engine(spark, graph(), 4).plan()
    assert seen == {"all": [(0, "x"), (1, "x"), (1, "y"), (3, "z")], "one": ["x", "y"]}
    assert sorted(tuple(r) for r in made["look", "n"].collect()) == [(0, 1), (1, 2), (3, 1)]
    for edge in (Edge.FIRST, Edge.PARTITION, Edge.SHUFFLE):
        with pytest.raises(GraphError):
            graph(edge=edge)
