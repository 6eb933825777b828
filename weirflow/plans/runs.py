"""Workspaces: stored outputs, acknowledgements, incremental re-execution, numbered runs, clean-up.

A workspace is a folder that Spark can write to. Every task that ran has its outputs there as Parquet
and one acknowledgement with its time. A task runs again if it has none, is marked to run every time,
is forced, reads a task that was acknowledged later, or reads a file that changed later; so after a
change only what depends on it runs. Outputs that nobody needs any longer are removed unless kept; where
a later run needs one of them again, its task runs again too. The arguments of the first run are stored
and must be the same later, or be replaced on purpose.

All access goes through Hadoop's file system, so the folder may be local or in any store Spark reads.
"""

from __future__ import annotations

import json
import re
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weirflow.functions.records import RecordType
from weirflow.plans.graph import Engine, GraphError, Output, Task


class Files:
    """The few file operations a workspace needs, on any file system of Spark's."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark.sparkContext._jvm

    def _at(self, path: str):
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def read(self, path: str) -> str:
        fs, at = self._at(path)
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Written beside and renamed, so that a reader never sees half of it."""
        fs, at = self._at(path)
        beside = self.jvm.org.apache.hadoop.fs.Path(f"{path}.part")
        stream = fs.create(beside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        fs.delete(at, False)
        if not fs.rename(beside, at):
            raise OSError(f"can't rename {beside} to {at}")

    def replace(self, new: str, path: str) -> None:
        """Put a finished folder in the place of another."""
        fs, at = self._at(path)
        fs.delete(at, True)
        if not fs.rename(self.jvm.org.apache.hadoop.fs.Path(new), at):
            raise OSError(f"can't rename {new} to {at}")

    def delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)

    def names(self, path: str) -> list[str]:
        fs, at = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def changed(self, pattern: str) -> int:
        """The latest change, in ms, of what a path or glob pattern names; folders count with what lies in them."""
        fs, at = self._at(pattern)
        latest, open_ = 0, list(fs.globStatus(at) or [])
        if not open_:
            raise FileNotFoundError(pattern)
        while open_:
            status = open_.pop()
            latest = max(latest, status.getModificationTime())
            if status.isDirectory():
                open_ += list(fs.listStatus(status.getPath()))
        return latest


@dataclass
class Workspace:
    """The folder of one run. run=None: a workspace without numbered runs."""

    spark: SparkSession
    root: str
    run: int | None = None
    files: Files = field(init=False)

    def __post_init__(self):
        self.files = Files(self.spark)

    @classmethod
    def next_run(cls, spark: SparkSession, root: str) -> Workspace:
        """The workspace of a new run, numbered after the last."""
        last = cls(spark, root).runs()
        return cls(spark, root, last[-1] + 1 if last else 0)

    def runs(self) -> list[int]:
        return sorted(int(m[1]) for x in self.files.names(self.root) if (m := re.fullmatch(r"run_(\d+)", x)))

    def folder(self, run: int | None = None) -> str:
        run = self.run if run is None else run
        return self.root if run is None else f"{self.root}/run_{run}"

    def path(self, task: str, output: str, run: int | None = None) -> str:
        """Where an output lies."""
        return f"{self.folder(run)}/{task}/{output}"

    def stored(self, task: str, output: str) -> bool:
        return self.files.exists(f"{self.path(task, output)}/_SUCCESS")

    def load(self, task: str, output: str, run: int | None = None) -> DataFrame:
        """An output as it is stored; `made_in`, where a row has it, is the partition that made it."""
        at = self.path(task, output, run)
        if self.files.exists(f"{at}/opaque.json"):
            return json.loads(self.files.read(f"{at}/opaque.json"))
        beside = f"{at}.schema.json"
        if not self.files.exists(beside):
            return self.spark.read.parquet(at)
        known = json.loads(self.files.read(beside))
        reader = self.spark.read.format(known["format"]).schema(StructType.fromJson(known["schema"]))
        return (reader.option("header", True) if known["format"] == "csv" else reader).load(at)

    def save(self, task: str, output: str, df: DataFrame, port: Output | None = None, parts: set[int] | None = None) -> None:
        """Store an output, ordered within its partitions where its port has an ordering, in the port's format.

        parts: only what these partitions made is new; what others made stays.
        """
        at = self.path(task, output)
        if port is not None and port.opaque:
            self.files.write(f"{at}/opaque.json", json.dumps(df))
            self.files.write(f"{at}/_SUCCESS", "")
            return
        by = port.columns() if port is not None else []
        maker = "made_in" if "made_in" in df.columns else "p" if "p" in df.columns else None
        if parts is not None and maker is not None and self.stored(task, output):
            df = df.unionByName(self.load(task, output).where(~F.col(maker).isin(sorted(parts))).select(*df.columns))
        if by:
            df = df.orderBy(*(["p"] if "p" in df.columns else []), *by)
        kind = port.format if port is not None else "parquet"
        writer = df.write.mode("overwrite").format(kind)
        if port is not None and port.compression:
            writer = writer.option("compression", port.compression)
        writer = writer.option("header", True) if kind == "csv" else writer
        new = f"{at}.new"
        writer.save(new)
        if kind == "parquet":
            self.files.delete(f"{at}.schema.json")
        else:
            self.files.write(f"{at}.schema.json", json.dumps({"format": kind, "schema": df.schema.jsonValue()}))
        self.files.replace(new, at)

    def ack(self, task: str) -> dict | None:
        at = f"{self.folder()}/{task}/ack.json"
        return json.loads(self.files.read(at)) if self.files.exists(at) else None

    def acknowledge(self, task: str, **what) -> None:
        self.files.write(f"{self.folder()}/{task}/ack.json", json.dumps({"task": task} | what))

    def previous(self, task: str, output: str, kind: RecordType | None) -> DataFrame:
        """An output as the run before left it; before the first run an empty one of its type."""
        if self.run is None:
            raise GraphError("previous runs need numbered runs")
        at = self.path(task, output, self.run - 1)
        if self.run > 0 and self.files.exists(f"{at}/_SUCCESS"):
            return self.load(task, output, self.run - 1)
        if kind is None:
            raise GraphError(f"{task}.{output} has no type and no earlier run, so its columns aren't known")
        return self.spark.createDataFrame([], kind.schema)

    def check_args(self, args: dict, replace: bool = False) -> None:
        """Store the arguments of the first run; later ones must be equal unless they are to replace them."""
        at = f"{self.root}/args.json"
        if self.files.exists(at) and not replace:
            known = json.loads(self.files.read(at))
            if known != args:
                raise GraphError(f"the workspace ran with {known}, not {args}")
        else:
            self.files.write(at, json.dumps(args, sort_keys=True))


class _Made(dict):
    """Outputs of tasks that ran before, read where they lie."""

    def __init__(self, workspace: Workspace):
        super().__init__()
        self.workspace = workspace

    def __missing__(self, key):
        task, output = key
        if not self.workspace.stored(task, output):
            raise GraphError(f"{task}.{output} isn't there; run {task} first")
        return self.workspace.load(task, output)


class Runner:
    """Runs an engine's graph in a workspace, a task at a time in order, and only what has to run."""

    def __init__(self, engine: Engine, workspace: Workspace, keep: bool = False, new_args: bool = False):
        self.engine, self.workspace, self.keep = engine, workspace, keep
        engine.store = workspace
        workspace.check_args(engine.args, new_args)
        self.log: list[dict] = []

    def stale(self, selected: set[str] | None = None, force: bool = False) -> set[str]:
        """Names of the tasks that have to run."""
        graph, ws = self.engine.graph, self.workspace
        tasks, acks, alive = graph.order(), {}, self.engine.alive()
        for task in tasks:
            acks[task.name] = ws.ack(task.name)
        out: set[str] = set()

        def must(task: Task) -> bool:
            ack = acks[task.name]
            if ack is None or not set(alive[task.name]) <= set(ack.get("parts", ack.get("alive", []))) or task.everytime or (force and (selected is None or task.name in selected)):
                return True
            parents = graph.parents(task)
            if any(p in out or (acks[p] or {}).get("at", 0) > ack["at"] for p in parents):
                return True
            return any(ws.files.changed(path) > ack["at"] for port in task.inputs.values() for path in port.paths)

        while True:
            before = len(out)
            out |= {task.name for task in tasks if must(task)}
            for task in reversed(tasks):
                if task.name in out:
                    for port in task.inputs.values():
                        if not port.previous:
                            out |= {t for t, o in port.sources if not ws.stored(t, o)}
            if len(out) == before:
                break
        return out if selected is None else out & selected

    def run(self, selected: set[str] | dict[str, set[int]] | None = None, force: bool = False) -> list[str]:
        """Run what has to; the names of the tasks that ran, in order. A failing body ends the run, and what ran before stays acknowledged.

        selected: only these tasks, or of each only some partitions: what its other partitions made before
        stays, and the task counts as done once all of them ran after the last change.
        """
        graph, ws = self.engine.graph, self.workspace
        graph.validate()
        for name in selected or ():
            if name not in graph.tasks:
                raise GraphError(f"{name} is no task")
        alive, due, ran = self.engine.alive(), self.stale(set(selected) if selected is not None else None, force), []
        made = _Made(ws)
        for task in graph.order():
            if task.name not in due:
                continue
            began = time.time()
            chosen = frozenset(selected[task.name]) & alive[task.name] if isinstance(selected, dict) else alive[task.name]
            found = self.engine.plan_task(task, made, alive | {task.name: chosen})
            some = set(chosen) if chosen != alive[task.name] else None
            for (name, output), df in found.items():
                if not task.outputs[output].internal:
                    ws.save(name, output, df, task.outputs[output], some)
            skipped = {o: sorted(alive[task.name] - self.engine.exists(task, o, alive[task.name])) for o in task.outputs}
            now = int(time.time() * 1000)
            latest = max([(ws.ack(p) or {}).get("at", 0) for p in graph.parents(task)], default=0)
            before = ws.ack(task.name) or {}
            # What other partitions made before counts on only where nothing that the task reads has changed since.
            current = not self.changed(task, before) if before else False
            done = set(chosen) | (set(before.get("parts", before.get("alive", []))) if some is not None and current else set())
            what = {"alive": sorted(alive[task.name]), "parts": sorted(done), "skipped": skipped}
            ws.acknowledge(task.name, at=max(now, latest), ms=int((time.time() - began) * 1000), **what)
            self.log.append({"task": task.name, "ms": int((time.time() - began) * 1000)})
            ran.append(task.name)
            if not self.keep and selected is None:
                self.clean(due - set(ran))
        return ran

    def changed(self, task: Task, ack: dict) -> bool:
        """Whether something a task reads is newer than its acknowledgement."""
        ws = self.workspace
        newer = any((ws.ack(p) or {}).get("at", 0) > ack["at"] for p in self.engine.graph.parents(task))
        return newer or any(ws.files.changed(path) > ack["at"] for port in task.inputs.values() for path in port.paths)

    def clean(self, waiting: set[str] = frozenset()) -> list[str]:
        """Remove outputs that some task reads, that aren't kept, and that no waiting task reads."""
        graph, ws, gone = self.engine.graph, self.workspace, []
        readers: dict[tuple[str, str], set[str]] = {}
        for task in graph.tasks.values():
            for port in task.inputs.values():
                for source in port.sources:
                    readers.setdefault(source, set()).add("" if port.previous else task.name)
        for (name, output), who in readers.items():
            if name not in graph.tasks or graph.tasks[name].outputs[output].keep or "" in who or who & waiting or name in waiting:
                continue
            if all(ws.ack(w) for w in who) and ws.stored(name, output):
                ws.files.delete(ws.path(name, output))
                gone.append(f"{name}.{output}")
        return gone
