"""Looking into a workspace: plan listing, record dumps, samples of partitions, one partition alone.

Dumps and samples are DataFrames of text lines; nothing comes to the driver but what the command line
prints. A partition's number is the logical one; outputs of unpartitioned tasks stand under 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirflow.operators.relational import health
from weirflow.plans.graph import Engine, GraphError
from weirflow.plans.runs import Workspace


def listing(engine: Engine, workspace: Workspace | None = None) -> str:
    """The graph in order of execution; with a workspace also where each output lies and when it ran."""
    lines = [engine.graph.describe()]
    if workspace is not None:
        for task in engine.graph.order():
            ack = workspace.ack(task.name)
            lines.append(f"{task.name}: " + (f"acknowledged at {ack['at']}, {ack['ms']} ms" if ack else "not run"))
            for name, port in task.outputs.items():
                if not port.internal:
                    lines.append(f"  {workspace.path(task.name, name)}" + ("" if workspace.stored(task.name, name) else " (absent)"))
    return "\n".join(lines)


def rendered(engine: Engine, task: str, output: str, df: DataFrame) -> Column:
    """Text of a record: the port's own renderer, its type's, or its columns tab-separated."""
    port = engine.graph.tasks[task].outputs[output]
    if port.render is not None:
        return port.render()
    if port.kind is not None:
        return port.kind.render()
    return F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string") if t != "binary" else F.hex(c), F.lit("")) for c, t in df.dtypes if c != "p"])


def stored(engine: Engine, workspace: Workspace, task: str, output: str) -> DataFrame:
    """An output's records, combined over the partitions that made them, as a reader gets them."""
    if task not in engine.graph.tasks or output not in engine.graph.tasks[task].outputs:
        raise GraphError(f"there is no {task}.{output}")
    df, port = workspace.load(task, output), engine.graph.tasks[task].outputs[output]
    return port.combine(df.drop("made_in")) if "made_in" in df.columns else df


def dump(engine: Engine, workspace: Workspace, task: str, output: str, match: str | None = None, partitions: set[int] | None = None) -> DataFrame:
    """(p, line) of an output's records, of those whose line holds `match`, in order of partition and of the port's ordering.

    partitions: of a shuffled output, its buckets.
    """
    df = stored(engine, workspace, task, output)
    part = (F.col("p") if "p" in df.columns else F.lit(0)).cast("int")
    if partitions is not None:
        df = df.where(part.isin(sorted(partitions)))
    line = rendered(engine, task, output, df)
    if match is not None:
        df = df.where(F.contains(line, F.lit(match)))
    by = engine.graph.tasks[task].outputs[output].columns()
    return (df.orderBy(part, *by) if by else df).select(part.alias("p"), line.alias("line"))


def sample(engine: Engine, workspace: Workspace, task: str, output: str, records: int, partitions: int, match: str | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Rows of every partition (n, empty), and the first matching records of a few seeded ones that have any."""
    df = stored(engine, workspace, task, output)
    line = rendered(engine, task, output, df)
    if match is not None:
        df = df.where(F.contains(line, F.lit(match)))
    df = df if "p" in df.columns else df.withColumn("p", F.lit(0))
    count = engine.partitions if engine.graph.tasks[task].partitioned else 1
    report = health(df, F.col("p").cast("int"), count)
    some = df.select("p").distinct().orderBy(F.xxhash64("p", F.lit(seed)), "p").limit(partitions)
    by = engine.graph.tasks[task].outputs[output].columns()
    first = F.row_number().over(Window.partitionBy("p").orderBy(*by, line))
    chosen = df.join(F.broadcast(some), "p", "left_semi")  # as many rows as partitions are asked for
    return report, chosen.withColumn("place", first).where(F.col("place") <= records).select(F.col("p").cast("int").alias("p"), line.alias("line"), "place")


def debug(engine: Engine, task: str, partition: int, at: str, workspace: Workspace | None = None) -> dict[str, str]:
    """Evaluate one partition of a task alone and write what it makes below `at`: output -> path.

    Inputs come from the workspace where they are stored; otherwise what they need is planned too.
    """
    if task not in engine.graph.tasks:
        raise GraphError(f"{task} is no task")
    engine.store = workspace or engine.store
    engine.graph.validate()
    node, alive = engine.graph.tasks[task], engine.alive()
    needed = {source for port in node.inputs.values() if not port.previous for source in port.sources}
    if workspace is not None and all(workspace.stored(*x) for x in needed):
        made = {x: workspace.load(*x) for x in needed}
    else:
        made = engine.plan({x for x, _ in needed}) if needed else {}
    found, out = engine.plan_task(node, made, alive | {task: alive[task] & {partition}}), {}
    for (_, name), df in found.items():
        out[name] = f"{at}/{name}"
        df.drop("made_in").write.mode("overwrite").parquet(out[name])
    return out
