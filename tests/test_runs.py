"""Workspaces: what runs again, numbered runs, clean-up, inspection, the command line."""

import os
import time

import pytest

from weirflow.plans import inspect
from weirflow.plans.cli import main, selection
from weirflow.plans.graph import Edge, Engine, Graph, GraphError
from weirflow.plans.runs import Runner, Workspace
from weirflow.sources.files import text_lines


@pytest.fixture
def lines(tmp_path):
    path = tmp_path / "in.txt"
    path.write_text("the quick fox\nthe dog\n")
    return path


def words(path, keep=True):
    """files -> split (4 partitions) -> count, and a side task that reads the files alone."""

    def split(ctx):
        from pyspark.sql import functions as F

        from weirflow.functions.text import poly_bucket

        rows = ctx.inputs["lines"].select(F.explode(F.split("value", " ")).alias("str"))
        return {"words": rows.withColumn("p", poly_bucket(F.col("str"), 4)).select("p", F.lit(1.0).alias("w"), "str")}

    graph = Graph()
    task = graph.task("split", split).input_files("lines", lambda s: text_lines(s, str(path)), [str(path)])
    task.output("words", "StringWeight", shuffle="Hash_Str", order="Sort_Str", reducer="Sum_W", keep=keep)
    graph.task("count", lambda ctx: {"counts": ctx.inputs["words"]}).input("words", "split", Edge.SHUFFLE).output("counts", "StringWeight", order="Sort_Str", reducer="Sum_W")
    graph.task("aside", lambda ctx: {"lines": ctx.inputs["lines"]}, partitioned=False).input_files("lines", lambda s: text_lines(s, str(path))).output("lines")
    return graph


def later(path):
    time.sleep(0.01)
    os.utime(path, (time.time() + 5, time.time() + 5))


def test_only_what_changed_runs_again(spark, tmp_path, lines):
    ws = Workspace(spark, str(tmp_path / "ws"))
    runner = lambda: Runner(Engine(spark, words(lines), 4), ws)
    assert runner().run() == ["split", "count", "aside"]
    assert {(r.str, r.w) for r in ws.load("count", "counts").collect()} == {("the", 2.0), ("quick", 1.0), ("fox", 1.0), ("dog", 1.0)}
    assert runner().run() == []
    later(lines)
    again = runner()
    assert again.stale() == {"split", "count"}
    assert again.run({"aside"}, force=True) == ["aside"]


def test_everytime_and_force(spark, tmp_path, lines):
    ws = Workspace(spark, str(tmp_path / "ws"))
    graph = words(lines)
    graph.task("aside").run_everytime()
    Runner(Engine(spark, graph, 4), ws).run()
    runner = Runner(Engine(spark, graph, 4), ws)
    assert runner.stale() == {"aside"}
    assert runner.stale(force=True) == {"split", "count", "aside"}
    with pytest.raises(GraphError):
        runner.run({"nobody"})


def test_clean_up_and_what_it_costs(spark, tmp_path, lines):
    ws = Workspace(spark, str(tmp_path / "ws"))
    Runner(Engine(spark, words(lines, keep=False), 4), ws).run()
    assert not ws.stored("split", "words") and ws.stored("count", "counts")
    runner = Runner(Engine(spark, words(lines, keep=False), 4), ws)
    assert runner.stale() == set()
    assert runner.stale({"count"}, force=True) == {"count"}
    assert runner.run(force=True) == ["split", "count", "aside"]
    Runner(Engine(spark, words(lines, keep=False), 4), ws, keep=True).run(force=True)
    assert ws.stored("split", "words")


def test_arguments_are_kept(spark, tmp_path, lines):
    ws = Workspace(spark, str(tmp_path / "ws"))
    Runner(Engine(spark, words(lines), 4, {"x": "1"}), ws)
    with pytest.raises(GraphError):
        Runner(Engine(spark, words(lines), 4, {"x": "2"}), ws)
    Runner(Engine(spark, words(lines), 4, {"x": "2"}), ws, new_args=True)
    Runner(Engine(spark, words(lines), 4, {"x": "2"}), ws)


def test_previous_runs(spark, tmp_path):
    graph = Graph()

    def step(ctx):
        more = ctx.spark.createDataFrame([(ctx.engine.store.run,)], "val long")
        return {"all": ctx.inputs["before"].unionByName(more)}

    graph.task("grow", step, partitioned=False).input_previous("before", "grow", "all").output("all", "UInt32")
    for n in range(3):
        ws = Workspace.next_run(spark, str(tmp_path / "ws"))
        assert ws.run == n
        Runner(Engine(spark, graph, 4), ws).run()
    assert sorted(r.val for r in ws.load("grow", "all").collect()) == [0, 1, 2]
    assert ws.runs() == [0, 1, 2]
    with pytest.raises(GraphError):
        Runner(Engine(spark, graph, 4), Workspace(spark, str(tmp_path / "plain"))).run()


def test_a_failing_body_keeps_what_ran(spark, tmp_path, lines):
    graph = words(lines)
    graph.task("bad", lambda ctx: 1 / 0).input("x", "count", Edge.PARTITION, "counts").output("y")
    ws = Workspace(spark, str(tmp_path / "ws"))
    with pytest.raises(ZeroDivisionError):
        Runner(Engine(spark, graph, 4), ws).run()
    assert ws.ack("count") and not ws.ack("bad")


def test_inspection(spark, tmp_path, lines):
    ws = Workspace(spark, str(tmp_path / "ws"))
    engine = Engine(spark, words(lines), 4)
    Runner(engine, ws).run()
    assert "acknowledged" in inspect.listing(engine, ws)
    assert [r.line for r in inspect.dump(engine, ws, "count", "counts", match="o").orderBy("line").collect()] == ["1.0\tdog", "1.0\tfox"]
    report, lines_ = inspect.sample(engine, ws, "count", "counts", 1, 2)
    assert report.count() == 4 and sum(r.n for r in report.collect()) == 4
    assert 1 <= lines_.count() <= 2
    paths = inspect.debug(engine, "count", ord("t") % 4, str(tmp_path / "debug"))
    assert all(r.p == ord("t") % 4 for r in spark.read.parquet(paths["counts"]).collect())
    with pytest.raises(GraphError):
        inspect.dump(engine, ws, "count", "nothing")


def test_selection():
    graph = Graph()
    graph.task("a")
    graph.task("b", partitioned=False)
    assert selection("a:0,2-3|b", graph, 4) == {"a": {0, 2, 3}, "b": {0}}
    for bad in ("c", "a:4", "a:3-1", "a:x", "b:1", "a:"):
        with pytest.raises(GraphError):
            selection(bad, graph, 4)


def test_command_line(spark, tmp_path, lines):
    said = []
    call = lambda *argv: main(lambda args: words(lines), spark, ["-w", str(tmp_path / "ws"), *argv], said.append)
    assert call() == 0 and [x.split(":")[0] for x in said] == ["split", "count", "aside"]
    for argv, want in ((["-l"], "split"), (["-s"], "acknowledged"), (["-d", "-t", "count", "--match", "fox"], "1.0\tfox"), (["-p", "-t", "count", "--match", "fox"], "count.counts:"), (["--sample", "1:1", "-t", "count"], "empty partitions")):
        said.clear()
        assert call(*argv) == 0 and any(want in x for x in said), (argv, said)
    said.clear()
    assert call("--debug", "count:1", str(tmp_path / "d")) == 0 and "counts" in said[0]
    assert call("-t", "nobody") == 1 and call("-a", "x") == 2 and call("-a", "x=1") == 1
    assert call("-a", "x=1", "--new-args", "-f", "-t", "aside") == 0


def counting(start, keep=True):
    """Every partition p makes ten numbers from start + 10 p, dealt by their remainder."""
    from pyspark.sql import functions as F

    def src(ctx):
        return {"n": ctx.generate(F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k")).select("p", (F.col("p") * 10 + F.col("k") + start[0]).cast("long").alias("val"))}

    graph = Graph()
    graph.task("src", src).output("n", "UInt32", shuffle=lambda n: F.pmod("val", F.lit(n)).cast("int"), keep=keep)
    graph.task("read", lambda ctx: {"out": ctx.inputs["n"]}).input("n", "src", Edge.SHUFFLE).output("out", "UInt32")
    return graph


def test_chosen_partitions_run_alone(spark, tmp_path):
    start = [0]
    ws = Workspace(spark, str(tmp_path / "ws"))
    call = lambda *argv: main(lambda args: counting(start), spark, ["-w", str(tmp_path / "ws"), *argv], [].append)
    assert call() == 0
    start[0] = 1000
    assert call("-f", "-t", "src:2") == 0
    assert sorted(r.val for r in ws.load("src", "n").collect()) == sorted([*range(20), *range(1020, 1030), *range(30, 40)])
    runner = Runner(Engine(spark, counting(start), 4), ws)
    assert runner.stale() == {"read"}
    runner.run()
    assert sorted(r.val for r in ws.load("read", "out").collect()) == sorted([*range(20), *range(1020, 1030), *range(30, 40)])
    fresh = Workspace(spark, str(tmp_path / "fresh"))
    runner = Runner(Engine(spark, counting(start), 4), fresh)
    assert runner.run({"src": {1, 3}}) == ["src"]
    assert sorted(r.val for r in fresh.load("src", "n").collect()) == [*range(1010, 1020), *range(1030, 1040)]
    assert runner.stale() == {"src", "read"}
    assert runner.run({"src": {0, 2}}) == ["src"] and runner.stale() == {"read"}


def test_debug_is_of_the_partition_that_makes_rows(spark, tmp_path):
    start = [0]
    ws = Workspace(spark, str(tmp_path / "ws"))
    engine = Engine(spark, counting(start), 4)
    paths = inspect.debug(engine, "src", 2, str(tmp_path / "a"), ws)
    assert sorted(r.val for r in spark.read.parquet(paths["n"]).collect()) == list(range(20, 30))
    Runner(engine, ws).run()
    start[0] = 5  # stored inputs are read, not made anew
    paths = inspect.debug(engine, "read", 1, str(tmp_path / "b"), ws)
    assert sorted(r.val for r in spark.read.parquet(paths["out"]).collect()) == [x for x in range(40) if x % 4 == 1]


@pytest.mark.parametrize("format", ["parquet", "json", "csv", "orc"])
def test_outputs_are_stored_in_order_and_format(spark, tmp_path, format):
    graph = Graph()
    rows = [(0, 1.0, "a"), (0, 3.0, "b"), (1, 2.0, "c"), (0, 2.0, "d"), (1, 5.0, "e")]
    body = lambda ctx: {"out": ctx.spark.createDataFrame(rows, "p int, w double, str string")}
    graph.task("make", body).output("out", "StringWeight", order="Sort_W_Desc", format=format, compression="gzip" if format != "orc" else "zlib")
    graph.task("few").input("x", "make", Edge.PARTITION, "out", limit=1).output("out", "StringWeight")
    ws = Workspace(spark, str(tmp_path / "ws"))
    engine = Engine(spark, graph, 2)
    Runner(engine, ws, keep=True).run()
    want = ["3.0\tb", "2.0\td", "1.0\ta", "5.0\te", "2.0\tc"]
    assert [r.line for r in inspect.dump(engine, ws, "make", "out").collect()] == want
    assert [f"{r.w}\t{r.str}" for r in ws.load("make", "out").coalesce(1).collect()] == want
    assert sorted(r.str for r in ws.load("few", "out").collect()) == ["b", "e"]
    assert [r.line for r in inspect.sample(engine, ws, "make", "out", 1, 2)[1].orderBy("p").collect()] == ["3.0\tb", "5.0\te"]


def test_opaque_outputs_are_handed_on(spark, tmp_path):
    """A task writes a file of its own and hands on its path; the reader, in a later run too, gets that path."""
    at, seen = str(tmp_path / "own.txt"), []

    def write(ctx):
        with open(at, "w") as f:
            f.write("own bytes")
        return {"where": at}

    graph = Graph()
    graph.task("write", write, partitioned=False).output("where", opaque=True, keep=True)
    graph.task("read", lambda ctx: seen.append(open(ctx.inputs["x"]).read()) or {}, partitioned=False).input("x", "write", Edge.PARTITION, "where")
    ws = Workspace(spark, str(tmp_path / "ws"))
    assert Runner(Engine(spark, graph, 2), ws).run() == ["write", "read"]
    assert Runner(Engine(spark, graph, 2), ws).run({"read"}, force=True) == ["read"]
    assert seen == ["own bytes", "own bytes"]
    with pytest.raises(GraphError):
        Graph().task("a").output("x", "UInt32", opaque=True)
