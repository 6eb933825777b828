"""Task graphs: named tasks with typed ports, four kinds of edges, unions, sub-graphs and skips.

A task's body maps the DataFrames of its inputs to those of its outputs. An engine with N partitions
gives every partitioned port a column `p` in [0, N); what an edge does with it:

  PARTITION   rows stay in their partition; both ends must be partitioned alike
  SHUFFLE     rows go to the bucket that the output's partitioner names; of any producer
  ALL_TO_ALL  every consumer partition reads all rows: the port arrives without a partition
  FIRST       every consumer partition reads the rows of partition 0

An output's reducer (or keep-first) combines what each producer partition makes and, where an edge brings
several of these together (shuffles, all-to-all, unions), once more what a consumer reads.

Bodies return lazy plans; Spark plans each chain of tasks as a whole. Skips are control flow: a small
set of partitions for each output that a body declares with `ctx.skip`, evaluated before any data.
"""

from __future__ import annotations

import enum
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions.records import RecordType, Registry, registry


class GraphError(ValueError):
    """A graph that can't run: unknown names, types or partition counts that don't fit, cycles."""


#: Formats an output can be stored in: all keep names and types, given the port's record type.
FORMATS = ("parquet", "orc", "json", "csv")


class Edge(enum.Enum):
    FIRST = "first"
    PARTITION = "partition"
    SHUFFLE = "shuffle"
    ALL_TO_ALL = "all_to_all"


@dataclass
class Output:
    name: str
    kind: RecordType | None = None
    shuffle: Callable[[int], Column] | str | None = None
    order: str | None = None
    reducer: str | None = None
    first: bool = False
    keep: bool = False
    internal: bool = False
    render: Callable[[], Column] | None = None

    compression: str | None = None
    format: str = "parquet"
    opaque: bool = False

    @property
    def combines(self) -> bool:
        return self.kind is not None and self.order is not None and bool(self.reducer or self.first)

    def combine(self, df: DataFrame, *within: str) -> DataFrame:
        """One record for each key of the ordering, in each group `within` (of those columns that are there)."""
        extra = [c for c in ("p", *within) if c in df.columns]
        if not self.combines:
            return df
        keys = list(dict.fromkeys([*extra, *self.kind.keys(self.order)]))
        rest = [c for c in self.kind.schema.names if c not in keys]
        if not rest:
            df = df.select(*keys).distinct()
        elif self.first:
            least = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_least"))
            df = least.select(*keys, *[F.col(f"_least.{c}").alias(c) for c in rest])
        else:
            how = self.kind.reducers[self.reducer]
            df = df.groupBy(*keys).agg(*[how.get(c, F.min)(c).alias(c) for c in rest])
        return df.select(*extra, *self.kind.schema.names)

    def route(self, df: DataFrame, parts: int) -> DataFrame:
        """Rows in the partition that the partitioner names; where they were made stands in `made_in`."""
        if self.shuffle is None:
            return df
        if "p" in df.columns:
            df = df.withColumnRenamed("p", "made_in")
        if self.shuffle == "round_robin":
            from weirflow.operators.relational import dealt

            return dealt(df, parts)
        return df.withColumn("p", self.shuffle(parts))

    def keyed(self, df: DataFrame, parts: int) -> bool:
        """Whether the partitioner reads only columns by which records are combined."""
        if not self.combines or self.shuffle is None or self.shuffle == "round_robin":
            return False
        try:
            df.select(*[c for c in self.kind.keys(self.order) if c in df.columns]).select(self.shuffle(parts))
        except AnalysisException:
            return False
        return True

    def columns(self) -> list[Column]:
        """Sort columns of the port's ordering, if it has one."""
        return self.kind.order(self.order) if self.kind is not None and self.order is not None else []

    def finish(self, df: DataFrame, parts: int) -> DataFrame:
        """Combine what each producer partition sends to each bucket; a reader combines over producers.

        A bucket that follows from the combined key is taken once for each combined record, not for each record made.
        """
        if not self.keyed(df, parts):
            return self.combine(self.route(df, parts), "made_in")
        made = self.combine(df)
        if "p" in made.columns:
            made = made.withColumnRenamed("p", "made_in")
        # always true; it keeps Spark from moving filters on p, and with them the partitioner, below the aggregate
        bucket = F.when(F.spark_partition_id() >= 0, self.shuffle(parts))
        return made.select(bucket.alias("p"), *made.columns)


@dataclass
class Input:
    name: str
    sources: list[tuple[str, str]]
    edge: Edge = Edge.ALL_TO_ALL
    expect: str | None = None
    limit: int | None = None
    limit_by: list[str] | None = None
    reducer: str | None = None
    order: str | None = None
    files: Callable | None = None
    paths: list[str] = field(default_factory=list)
    previous: bool = False
    tagged: bool = False


@dataclass
class Context:
    """What a body sees: the engine, its task, its inputs, and the partitions that still run."""

    engine: Engine
    task: Task
    inputs: dict[str, DataFrame]
    alive: frozenset[int]

    def loaded(self, name: str, partition: int | None = None) -> DataFrame:
        """The rows of a tagged input, of all source partitions or of one."""
        if not self.task.inputs[name].tagged:
            raise GraphError(f"{self.task.name}.{name} isn't tagged")
        df = self.inputs[name]
        return df if partition is None else df.where(F.col("source_p") == partition)

    @property
    def spark(self):
        return self.engine.spark

    @property
    def partitions(self) -> int:
        return self.engine.partitions if self.task.partitioned else 1

    @property
    def args(self) -> dict:
        return self.engine.args

    def generate(self, rows: Column | None = None) -> DataFrame:
        """One row for each partition that runs, with its number: the start of a generator."""
        df = self.spark.createDataFrame([(p,) for p in sorted(self.alive)], "p int")
        return df if rows is None else df.select("p", rows)


class Task:
    """A node. Ports and dependencies are declared on it; the body runs when the engine plans it."""

    def __init__(self, graph: Graph, name: str, body: Callable[[Context], dict[str, DataFrame]] | None, partitioned: bool = True):
        self.graph, self.name, self.body, self.partitioned = graph, name, body, partitioned
        self.inputs: dict[str, Input] = {}
        self.outputs: dict[str, Output] = {}
        self.full: list[str] = []
        self.partial: list[str] = []
        self.everytime = False
        self.skips: dict[str, Callable[[int, dict], bool]] = {}

    def input(self, name: str, source: str, edge: Edge = Edge.ALL_TO_ALL, port: str | None = None, **more) -> Task:
        """Read `port` of the task `source`; "a|b" is the union of several tasks' ports.

        tagged: rows of an all-to-all edge say in `source_p` which partition they are from (0 for ports without), and are
        combined by partition only.
        """
        if name in self.inputs:
            raise GraphError(f"{self.name} has an input {name} already")
        if not isinstance(edge, Edge):
            raise GraphError(f"{self.name}.{name}: an input has exactly one kind of edge, not {edge!r}")
        if more.get("tagged") and (edge is not Edge.ALL_TO_ALL or more.get("reducer")):
            raise GraphError(f"{self.name}.{name}: only an all-to-all edge without a reducer of its own can be tagged")
        ports = (port or name).split("|")
        names = source.split("|")
        ports = ports * len(names) if len(ports) == 1 else ports
        if len(ports) != len(names):
            raise GraphError(f"{self.name}.{name}: {len(names)} tasks but {len(ports)} ports")
        self.inputs[name] = Input(name, list(zip(names, ports, strict=True)), edge, **more)
        return self

    def input_files(self, name: str, read: Callable, paths: list[str] | None = None, **more) -> Task:
        """An external input: read(spark) gives its rows. A change of what `paths` name makes the task run again."""
        self.inputs[name] = Input(name, [], Edge.ALL_TO_ALL, files=read, paths=list(paths or []), **more)
        return self

    def input_previous(self, name: str, source: str, port: str, edge: Edge = Edge.ALL_TO_ALL, **more) -> Task:
        """A port as the previous run left it, empty in run 0; no edge of the graph."""
        self.inputs[name] = Input(name, [(source, port)], edge, previous=True, **more)
        return self

    def output(self, name: str, kind: str | None = None, *, shuffle: str | Callable | None = None, order: str | None = None, reducer: str | None = None, first: bool = False, keep: bool = False, internal: bool = False, render=None, format: str = "parquet", compression: str | None = None, opaque: bool = False) -> Task:
        """A port. opaque: the body hands on a text (a path it wrote itself, say) that readers get as it is. shuffle: a partitioner's name, "round_robin" or a function of the bucket count; format: one of FORMATS."""
        if name in self.outputs:
            raise GraphError(f"{self.name} has an output {name} already")
        if kind and kind not in self.graph.types:
            raise GraphError(f"{self.name}.{name}: unknown record type {kind}")
        record = self.graph.types[kind] if kind else None
        if record is None and (order or reducer or first or (isinstance(shuffle, str) and shuffle != "round_robin")):
            raise GraphError(f"{self.name}.{name}: named partitioners, orderings and reducers belong to record types")
        for what, known in ((order, record and record.orderings), (reducer, record and record.reducers), (shuffle if isinstance(shuffle, str) and shuffle != "round_robin" else None, record and record.partitioners)):
            if what and what not in known:
                raise GraphError(f"{self.name}.{name}: {kind} has no {what}; it has {', '.join(sorted(known)) or 'none'}")
        if opaque and (kind or shuffle or order):
            raise GraphError(f"{self.name}.{name}: an opaque output has no records to type, deal or sort")
        if (reducer or first) and not order:
            raise GraphError(f"{self.name}.{name}: records are combined by an ordering's keys; name one")
        if internal and shuffle:
            raise GraphError(f"{self.name}.{name}: an internal output can't be shuffled")
        if format not in FORMATS:
            raise GraphError(f"{self.name}.{name}: {format} is none of {', '.join(FORMATS)}")
        named = isinstance(shuffle, str) and shuffle != "round_robin"
        part = record.partitioners[shuffle] if named else shuffle
        self.outputs[name] = Output(name, record, part, order, reducer, first, keep, internal, render, compression, format, opaque)
        return self

    def depends(self, *names: str, partial: bool = False) -> Task:
        """Run after these tasks: after all their partitions, or (partial) after the same ones."""
        (self.partial if partial else self.full).extend(names)
        return self

    def skip(self, output: str, when: Callable[[int, dict], bool]) -> Task:
        """Declare that `output` doesn't exist for partitions where when(partition, args) holds."""
        self.skips[output] = when
        return self

    def run_everytime(self) -> Task:
        self.everytime = True
        return self


class Graph:
    """Tasks by name; registering a name again returns the task that is there."""

    def __init__(self, types: Registry | None = None):
        self.types = types or registry()
        self.tasks: dict[str, Task] = {}

    def task(self, name: str, body: Callable | None = None, partitioned: bool = True) -> Task:
        if name not in self.tasks:
            self.tasks[name] = Task(self, name, body, partitioned)
        return self.tasks[name]

    def find(self, name: str) -> Task | None:
        return self.tasks.get(name)

    def pipeline(self, name: str, **config) -> Pipeline:
        return Pipeline(self, name, config)

    def parents(self, task: Task) -> list[str]:
        edges = [t for i in task.inputs.values() if not i.previous for t, _ in i.sources]
        return list(dict.fromkeys([*edges, *task.full, *task.partial]))

    def order(self) -> list[Task]:
        """Tasks after all they need; raises on cycles and unknown names."""
        done, path, out = set(), [], []

        def visit(name: str) -> None:
            if name in done:
                return
            if name in path:
                raise GraphError("cycle: " + " -> ".join([*path[path.index(name) :], name]))
            if name not in self.tasks:
                raise GraphError(f"{path[-1]} needs {name}, which is no task")
            path.append(name)
            for parent in self.parents(self.tasks[name]):
                visit(parent)
            path.pop()
            done.add(name)
            out.append(self.tasks[name])

        for name in self.tasks:
            visit(name)
        return out

    def validate(self) -> None:
        """Ports exist, expected types equal produced ones, partition-to-partition ends are partitioned alike."""
        for task in self.order():
            for port in task.inputs.values():
                for source, name in port.sources:
                    made = self.tasks[source].outputs.get(name) if source in self.tasks else None
                    if made is None:
                        raise GraphError(f"{task.name}.{port.name} reads {source}.{name}, which doesn't exist")
                    if made.internal and source != task.name:
                        raise GraphError(f"{task.name}.{port.name} reads {source}.{name}, which is internal")
                    if port.expect and (made.kind is None or made.kind.name != port.expect):
                        raise GraphError(f"{task.name}.{port.name} expects {port.expect}; {source}.{name} has {made.kind.name if made.kind else 'no type'}")
                    if port.edge is Edge.PARTITION and self.tasks[source].partitioned != task.partitioned:
                        raise GraphError(f"{task.name}.{port.name}: partition edges join tasks of equal partition counts")
                    if port.edge is Edge.SHUFFLE and made.shuffle is None and not port.previous:
                        raise GraphError(f"{task.name}.{port.name}: {source}.{name} isn't shuffled")
                    if port.edge is not Edge.SHUFFLE and made.shuffle is not None and not port.previous:
                        raise GraphError(f"{task.name}.{port.name}: {source}.{name} is shuffled and needs a shuffle edge")

    def describe(self) -> str:
        lines = []
        for task in self.order():
            lines.append(f"{task.name}" + ("" if task.partitioned else " (one partition)"))
            for i in task.inputs.values():
                source = "files" if i.files else " | ".join(f"{t}.{p}" for t, p in i.sources)
                lines.append(f"  in  {i.name} <- {source}" + ("" if i.files else f" [{i.edge.value}]") + (" of the previous run" if i.previous else ""))
            for o in task.outputs.values():
                lines.append(f"  out {o.name}" + (f": {o.kind.name}" if o.kind else "") + (f" by {o.order}" if o.order else "") + (f" reduced by {o.reducer}" if o.reducer else "") + (" shuffled" if o.shuffle else "") + (" internal" if o.internal else ""))
            for d in task.full + task.partial:
                lines.append(f"  after {d}")
        return "\n".join(lines)


class Pipeline:
    """A sub-graph whose tasks bear its name as a prefix; ports bind from outside and expose to it; nestable."""

    def __init__(self, graph: Graph, name: str, config: dict):
        self.graph, self.name, self.config = graph, name, config
        self.bound: dict[str, tuple[str, str]] = {}
        self.exposed: dict[str, tuple[str, str]] = {}

    def task(self, name: str, body: Callable | None = None, partitioned: bool = True) -> Task:
        return self.graph.task(f"{self.name}.{name}", body, partitioned)

    def pipeline(self, name: str, **config) -> Pipeline:
        return Pipeline(self.graph, f"{self.name}.{name}", self.config | config)

    def bind_input(self, port: str, task: str, output: str) -> Pipeline:
        self.bound[port] = (task, output)
        return self

    def bind_link(self, port: str, other: Pipeline, other_port: str) -> Pipeline:
        self.bound[port] = other.source(other_port)
        return self

    def expose_output(self, port: str, task: str, output: str) -> Pipeline:
        self.exposed[port] = (f"{self.name}.{task}", output)
        return self

    def expose_input(self, port: str, nested: Pipeline, nested_port: str) -> Pipeline:
        """Hand what is bound to this pipeline's port on to a nested one's."""
        if port in self.bound:
            nested.bound[nested_port] = self.bound[port]
        return self

    def bind_output(self, port: str, outer: Pipeline, outer_port: str) -> Pipeline:
        """Show this pipeline's port as the outer one's."""
        outer.exposed[outer_port] = self.source(port)
        return self

    def expose_nested(self, port: str, nested: Pipeline, nested_port: str) -> Pipeline:
        self.exposed[port] = nested.source(nested_port)
        return self

    def source(self, port: str) -> tuple[str, str]:
        if port not in self.exposed:
            raise GraphError(f"pipeline {self.name} exposes no {port}")
        return self.exposed[port]

    def connect(self, task: Task, name: str, port: str, edge: Edge = Edge.ALL_TO_ALL, optional: bool = False, empty: str | None = None, **more) -> bool:
        """Give one of the pipeline's tasks a bound port as its input; false if it is optional and unbound.

        empty: a record type; an unbound port then is an input of that type without rows.
        """
        if port not in self.bound:
            if empty is not None:
                schema = self.graph.types[empty].schema
                task.input_files(name, lambda spark: spark.createDataFrame([], schema), expect=empty)
            if optional or empty is not None:
                return False
            raise GraphError(f"pipeline {self.name}: nothing is bound to {port}")
        source, output = self.bound[port]
        task.input(name, source, edge, output, **more)
        return True

    def sibling(self, task: Task, name: str, other: str, output: str, edge: Edge = Edge.PARTITION, **more) -> Task:
        """An input from tasks of the same pipeline ("a|b" for a union)."""
        return task.input(name, "|".join(f"{self.name}.{x}" for x in other.split("|")), edge, output, **more)


class Engine:
    """Plans graphs over one Spark session. `parts` of a result are logical; Spark places rows as it likes."""

    def __init__(self, spark, graph: Graph, partitions: int = 4, args: dict | None = None, store=None):
        self.spark, self.graph, self.partitions, self.args, self.store = spark, graph, partitions, dict(args or {}), store

    def alive(self) -> dict[str, frozenset[int]]:
        """Partitions of each task that run. A partition starves if all sources of some input skipped it, or any partition of a task that it fully depends on was skipped."""
        out: dict[str, frozenset[int]] = {}
        for task in self.graph.order():
            parts = set(range(self.partitions if task.partitioned else 1))
            for port in task.inputs.values():
                if port.files or port.previous:
                    continue
                fed = set()
                for source, name in port.sources:
                    there = self.exists(self.graph.tasks[source], name, out[source])
                    if port.edge is Edge.PARTITION:
                        fed |= there
                    elif port.edge is Edge.FIRST:
                        fed |= parts if 0 in there else set()
                    else:  # every partition reads whatever there is
                        fed |= parts if there else set()
                parts &= fed
            for name in task.full:
                if len(out[name]) < (self.partitions if self.graph.tasks[name].partitioned else 1):
                    parts = set()
            for name in task.partial:
                parts &= out[name]
            out[task.name] = frozenset(parts)
        return out

    def exists(self, task: Task, output: str, alive: frozenset[int]) -> set[int]:
        when = task.skips.get(output)
        return {p for p in alive if not (when and when(p, self.args))}

    def read(self, task: Task, port: Input, made: dict, alive: dict) -> DataFrame:
        """The rows that a port's edge brings to a task."""
        if port.files:
            return self.shown(port.files(self.spark), port, None)
        hidden = [self.graph.tasks[t].outputs[o].opaque for t, o in port.sources if t in self.graph.tasks]
        if any(hidden):
            if not all(hidden) or port.previous:
                raise GraphError(f"{task.name}.{port.name}: opaque outputs don't unite with others and have no previous run")
            found = [made[x] for x in port.sources]
            return found[0] if len(found) == 1 else found
        sides = []
        for source, name in port.sources:
            if port.previous:
                if self.store is None:
                    raise GraphError(f"{task.name}.{port.name}: previous runs need a workspace")
                df = self.store.previous(source, name, self.graph.tasks[source].outputs[name].kind if source in self.graph.tasks else None)
            else:
                df = made[source, name]
            made_by = self.graph.tasks[source].outputs[name] if source in self.graph.tasks else None
            df = df.drop("made_in")
            if port.tagged:
                df = df if "p" in df.columns else df.withColumn("p", F.lit(0))
            elif "p" in df.columns:
                if port.edge is Edge.FIRST:
                    df = df.where(F.col("p") == 0).drop("p")
                elif port.edge is Edge.ALL_TO_ALL:
                    df = df.drop("p")
                else:
                    df = df.where(F.col("p").isin(sorted(alive[task.name])))
            if made_by is not None and made_by.combines and (port.edge in (Edge.SHUFFLE, Edge.ALL_TO_ALL) or len(port.sources) > 1):
                df = made_by.combine(df)
            sides.append(df)
        df = sides[0]
        for other in sides[1:]:
            df = df.unionByName(other)
        first = self.graph.tasks[port.sources[0][0]].outputs[port.sources[0][1]] if port.sources[0][0] in self.graph.tasks else None
        if len(sides) > 1 and first is not None:
            df = first.combine(df)
        if port.tagged:
            df = df.withColumnRenamed("p", "source_p")
        return self.shown(df, port, first)

    def shown(self, df: DataFrame, port: Input, made_by: Output | None) -> DataFrame:
        """What a port does at reading: combine by its own reducer, then the first records of each partition by its or its source's order."""
        kind = made_by.kind if made_by is not None else self.graph.types[port.expect] if port.expect else None
        if port.reducer:
            if kind is None or not port.order:
                raise GraphError(f"{port.name}: a reducer at reading needs a record type and an ordering")
            df = Output(port.name, kind, order=port.order, reducer=port.reducer).combine(df)
        if port.limit is not None:
            from weirflow.operators.relational import limit_per_partition

            part = F.col("p") if "p" in df.columns else F.lit(0)
            if port.limit_by:
                order = [F.col(c) for c in port.limit_by]
            elif kind is not None and port.order:
                order = kind.order(port.order)
            else:
                order = made_by.columns() if made_by is not None else []
            rest = [F.col(c) for c in df.columns if c != "p"]
            limited = limit_per_partition(df, part, [*order, *rest], port.limit)
            df = limited if "p" in df.columns else limited.drop("p")
        return df

    def plan(self, only: set[str] | None = None) -> dict[tuple[str, str], DataFrame]:
        """(task, output) -> rows of every task, or of some and what they need."""
        self.graph.validate()
        alive = self.alive()
        wanted = set(self.graph.tasks) if only is None else set(only)
        tasks = self.graph.order()
        for task in reversed(tasks):
            if task.name in wanted:
                wanted |= set(self.graph.parents(task))
        made: dict[tuple[str, str], DataFrame] = {}
        for task in tasks:
            if task.name in wanted:
                made |= self.plan_task(task, made, alive)
        return made

    def plan_task(self, task: Task, made: dict, alive: dict) -> dict[tuple[str, str], DataFrame]:
        inputs = {n: self.read(task, p, made, alive) for n, p in task.inputs.items()}
        if task.body is None:  # no body: a barrier, or a copy of the only input to every output
            if not task.outputs:
                return {}
            if len(inputs) != 1:
                raise GraphError(f"{task.name} copies one input, not {len(inputs)}")
            found = dict.fromkeys(task.outputs, next(iter(inputs.values())))
        else:
            found = task.body(Context(self, task, inputs, alive[task.name])) or {}
        out = {}
        for name, port in task.outputs.items():
            if name not in found:
                raise GraphError(f"{task.name} made no {name}")
            df = found[name]
            if port.opaque:
                out[task.name, name] = df
                continue
            if port.kind is not None:
                extra = ["p"] if "p" in df.columns else []
                missing = [c for c in port.kind.schema.names if c not in df.columns]
                if missing:
                    raise GraphError(f"{task.name}.{name} is a {port.kind.name} without {', '.join(missing)}")
                df = df.select(*extra, *[F.col(f.name).cast(f.dataType).alias(f.name) for f in port.kind.schema])
            there = self.exists(task, name, alive[task.name])
            if task.partitioned and "p" in df.columns and len(there) < self.partitions:
                df = df.where(F.col("p").isin(sorted(there)))
            out[task.name, name] = port.finish(df, self.partitions)
        return out
