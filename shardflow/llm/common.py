"""What the training-data operators share: column picking, word rules, shared scratch tables."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from shardflow.session import ship

#: A word, for Java's and Python's regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"
#: White space that normalisation deletes.
SPACE = r"[\x20\x09-\x0D]"

_made: dict[str, str] = {}
#: Of a worker: what operations keep from one task to the next, by name.
memory: dict[str, dict] = {}


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, renamed: pick(df, doc_id="id") has doc_id. Columns are found by place, so
    that others whose names clash (also in case alone) don't matter; of equal names the first counts."""
    plain, found, _ = numbered(df, **cols)
    return plain.select(*(plain[old].alias(new) for new, old in found.items()))


def numbered(df: DataFrame, **cols: str) -> tuple[DataFrame, dict[str, str], list[str]]:
    """df with columns c0, c1, ... (whatever their names were), the new names of the wanted columns, and all old names:
    for operators that pass every column on."""
    names = df.columns
    found = {}
    for new, old in cols.items():
        at = [i for i, n in enumerate(names) if n == old] or [i for i, n in enumerate(names) if n.lower() == old.lower()]
        if not at:
            raise ValueError(f"no column {old!r} among {names}")
        found[new] = f"c{at[0]}"
    return df.toDF(*(f"c{i}" for i in range(len(names)))), found, names


def n_words(text: Column) -> Column:
    """Words of a text as a long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def scratch(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir, which all executors share. Only where that is
    unset: a temporary folder in local mode, else a folder beside the warehouse."""
    app = spark.sparkContext.applicationId
    if app not in _made:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not root and spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            root = tempfile.mkdtemp(prefix="shardflow-")
        root = root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        _made[app] = f"{root.rstrip('/')}/{app}"
        atexit.register(release, spark)
    return _made[app]


def release(spark: SparkSession) -> None:
    """Deletes this application's scratch tables; results that read them must have been written by then."""
    with contextlib.suppress(Exception):  # the session may have ended
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made.pop(spark.sparkContext.applicationId))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def keep(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage, survives lost executors, and
    gives the planner the table's size, on which it bases broadcasts."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of one whole number each up to which a table is broadcast: some tens of megabytes.
FEW = 2_000_000


def if_few(ids: DataFrame) -> DataFrame:
    """A written table of one column of whole numbers, marked for a broadcast if it has FEW rows at most; beyond, Spark
    shuffles both sides of its join."""
    small = all(isinstance(f.dataType, IntegralType) for f in ids.schema) and ids.count() <= FEW
    return F.broadcast(ids) if small else ids


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _give_back() -> None:
    """Free memory of Arrow's and the C library's pools, where the latter can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def give_back(spark: SparkSession) -> None:
    """Free heap of the executors, between large steps: a JVM keeps what it once took, so that a step's peak stays beside the
    next one's; a full collection gives it back to the system, with buffers and generated classes that nothing holds any
    more. One task for each core; no result depends on it, and an executor that gets none keeps its heap."""
    n = spark.sparkContext.defaultParallelism
    with contextlib.suppress(PySparkException):  # where calls by name aren't allowed
        spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def on_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, holds: str = "") -> DataFrame:
    """mapInArrow with this package sent to the workers first. What a worker remembers between tasks (`memory`) is given up
    when it goes on to an operation that doesn't hold it: workers serve one stage after another, and give back to the
    system what is free."""
    ship(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in set(memory) - {holds}:
            del memory[name]
        _give_back()
        yield from run(batches)
        _give_back()

    return df.mapInArrow(task, schema)
