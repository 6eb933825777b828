"""Command line of a graph: run it in a workspace, select tasks, list, dump, sample, debug.

    from weirflow.plans.cli import main
    main(build, spark)          # build(args: dict) -> Graph

Tasks are selected as `task`, `task:2`, `task:0,2-4` and joined by `|`.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import SparkSession

from weirflow.plans import inspect
from weirflow.plans.graph import Engine, Graph, GraphError
from weirflow.plans.runs import Runner, Workspace


def selection(text: str, graph: Graph, partitions: int) -> dict[str, set[int]]:
    """'a:0,2-4|b' -> partitions of each selected task; GraphError for unknown tasks and numbers out of range."""
    out: dict[str, set[int]] = {}
    for part in text.split("|"):
        name, colon, numbers = part.partition(":")
        if graph.find(name) is None:
            raise GraphError(f"{name} is no task")
        count = partitions if graph.tasks[name].partitioned else 1
        chosen = out.setdefault(name, set())
        if not colon:
            chosen |= set(range(count))
        for piece in numbers.split(",") if colon else ():
            first, dash, last = piece.partition("-")
            if not first.isdigit() or (dash and not last.isdigit()):
                raise GraphError(f"{piece!r} is no partition or range of {name}")
            lo, hi = int(first), int(last) if dash else int(first)
            if lo > hi or hi >= count:
                raise GraphError(f"{name} has partitions 0 to {count - 1}, not {piece}")
            chosen |= set(range(lo, hi + 1))
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Run or inspect a task graph.")
    p.add_argument("-w", "--workspace", required=True, help="folder for outputs and acknowledgements")
    p.add_argument("-n", "--partitions", type=int, default=4)
    p.add_argument("-l", "--list", action="store_true", help="print the plan")
    p.add_argument("-s", "--show-files", action="store_true", help="print the plan and where outputs lie")
    p.add_argument("-t", "--tasks", help="only these tasks, as task:0,2-4|task2")
    p.add_argument("-o", "--outputs", help="outputs to dump or sample, comma-separated; default all of the selected tasks")
    p.add_argument("-f", "--force", action="store_true", help="run what is selected even if it is up to date")
    p.add_argument("-r", "--runs", action="store_true", help="work in numbered runs; without --run a new one")
    p.add_argument("--run", type=int, help="number of the run to work in")
    p.add_argument("--keep-files", action="store_true", help="keep intermediate outputs")
    p.add_argument("--new-args", action="store_true", help="replace the workspace's stored arguments")
    p.add_argument("-a", "--arg", action="append", default=[], metavar="NAME=VALUE", help="argument of the graph")
    p.add_argument("-d", "--dump", action="store_true", help="print records")
    p.add_argument("-p", "--prefix", action="store_true", help="print records with output and partition")
    p.add_argument("--match", help="only records whose text holds this")
    p.add_argument("--sample", metavar="R:P", help="first R records of P partitions that have any, after a report of empty ones")
    p.add_argument("--debug", nargs=2, metavar=("TASK:PARTITION", "FOLDER"), help="evaluate one partition of a task alone")
    return p


def main(build: Callable[[dict], Graph], spark: SparkSession, argv: list[str] | None = None, say: Callable[[str], None] = print) -> int:
    """0 if all went well; errors of graph and arguments are said, not raised."""
    a = parser().parse_args(argv)
    try:
        args = dict(x.split("=", 1) for x in a.arg)
    except ValueError:
        say("error: --arg takes NAME=VALUE")
        return 2
    looks = a.list or a.show_files or a.dump or a.prefix or a.sample or a.debug
    try:
        graph = build(args)
        graph.validate()
        engine = Engine(spark, graph, a.partitions, args)
        if a.run is None and (a.runs and not looks):
            workspace = Workspace.next_run(spark, a.workspace)
        else:
            workspace = Workspace(spark, a.workspace, a.run)
            if a.runs and a.run is None and workspace.runs():
                workspace = Workspace(spark, a.workspace, workspace.runs()[-1])
        engine.store = workspace
        chosen = selection(a.tasks, graph, a.partitions) if a.tasks else None
        if a.debug:
            picked = selection(a.debug[0], graph, a.partitions)
            if len(picked) != 1 or len(next(iter(picked.values()))) != 1:
                raise GraphError("--debug takes one partition of one task")
            (name, parts), folder = next(iter(picked.items())), a.debug[1]
            for output, path in inspect.debug(engine, name, next(iter(parts)), folder, workspace).items():
                say(f"{output}: {path}")
        elif a.dump or a.prefix or a.sample:
            wanted = set(a.outputs.split(",")) if a.outputs else None
            for task in graph.order():
                if chosen is not None and task.name not in chosen:
                    continue
                for output, port in task.outputs.items():
                    if port.internal or port.opaque or (wanted is not None and output not in wanted) or not workspace.stored(task.name, output):
                        continue
                    if a.sample:
                        records, _, parts = a.sample.partition(":")
                        report, lines = inspect.sample(engine, workspace, task.name, output, int(records), int(parts or 1), a.match)
                        empty = [r.p for r in report.where("empty").orderBy("p").toLocalIterator()]
                        say(f"{task.name}.{output}: {len(empty)} empty partitions {empty}")
                    else:
                        lines = inspect.dump(engine, workspace, task.name, output, a.match, chosen and chosen[task.name])
                    for r in lines.toLocalIterator():
                        say(f"{task.name}.{output}:{r.p}\t{r.line}" if a.prefix or a.sample else r.line)
        elif looks:
            say(inspect.listing(engine, workspace if a.show_files else None))
        else:
            runner = Runner(engine, workspace, a.keep_files, a.new_args)
            for name in runner.run(chosen, a.force):
                say(f"{name}: {next(x['ms'] for x in runner.log if x['task'] == name)} ms")
    except (GraphError, KeyError, FileNotFoundError) as e:
        say(f"error: {e}")
        return 1
    return 0
