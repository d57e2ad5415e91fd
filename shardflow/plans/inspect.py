from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _children(node) -> list:
    seq = node.children()
    out = [seq.apply(i) for i in range(seq.size())]
    if not out and node.nodeName().startswith("AdaptiveSparkPlan"):
        out = [node.initialPlan()]
    return out


def dot(df: DataFrame) -> str:
    """The physical plan as a DOT digraph from start (sources) to end."""
    lines, count = ["digraph flow {", '  start [shape="circle"];', '  end [shape="circle"];'], 0

    def walk(node) -> str:
        nonlocal count
        name, count = f"t{count}", count + 1
        label = str(node.nodeName()).replace('"', "'")
        lines.append(f'  {name} [shape="box", label="{label}"];')
        below = [walk(x) for x in _children(node)]
        lines.extend(f"  {x} -> {name};" for x in below or ["start"])
        return name

    top = walk(df._jdf.queryExecution().executedPlan())
    return "\n".join([*lines, f"  {top} -> end;", "}"])


def observed(df: DataFrame, name: str = "flow") -> tuple[DataFrame, Observation]:
    """df that counts its rows as they pass; the observation has `rows` once an action ended."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def interrupt(spark: SparkSession) -> list[str]:
    """Stops what runs in this session."""
    return list(spark.interruptAll())
