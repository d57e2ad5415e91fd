"""Sessions, and this package on the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once for each application: functions that run there are found by module,
    wherever the driver's working directory is."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    if here.is_dir():
        d = tempfile.mkdtemp()  # executors fetch it from the driver as long as it runs
        atexit.register(shutil.rmtree, d, True)
        z = Path(d, f"{here.name}.zip")
        with zipfile.ZipFile(z, "w", zipfile.ZIP_DEFLATED) as f:
            for p in sorted(here.rglob("*.py")):
                f.write(p, str(p.relative_to(here.parent)))
        sc.addPyFile(str(z))
        _shipped.add(sc.applicationId)


def local_session(name: str = "shardflow", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session in one JVM, for tests and benchmarks."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    base = {"spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}
    spark = b.config(map=base | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which executors share; only where that is unset, in local mode a
    temporary folder, else one beside the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        root = tempfile.mkdtemp(prefix="shardflow-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex[:12]}"
