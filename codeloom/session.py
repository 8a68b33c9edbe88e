"""Session builder and the few settings every job relies on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "codeloom", cores: int | str = "*", **conf: str) -> SparkSession:
    """Local session with AQE; a cluster passes its own session to the operators instead."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting (tests, a laptop) takes a folder under the warehouse;
    on a cluster, whose executors share no such folder, its absence is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", "")
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = shared or os.path.join(spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse"), "_checkpoints")
        context.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def busy_partitions(spark: SparkSession) -> int:
    """Partitions of a shuffle in front of CPU-bound work, which adaptive coalescing by bytes would put into few tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """A scan in front of CPU-bound work: rows are spread only where the files give fewer tasks than there are cores."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers when it is not on their path already.

    A session started elsewhere (another working directory, no PYTHONPATH, a cluster without the
    package installed) gets a zip of it through ``addPyFile``, once per context.
    """
    package = Path(__file__).resolve().parent
    root, context = str(package.parent), spark.sparkContext
    reachable = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if getattr(context, "_codeloom_shipped", False) or root in [os.path.abspath(p) for p in reachable if p]:
        return
    folder = tempfile.mkdtemp(prefix="codeloom-")  # the driver serves the file until the process ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder, "codeloom_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as bundle:
        for source in sorted(package.rglob("*.py")):
            bundle.write(source, source.relative_to(package.parent))
    context.addPyFile(str(target))
    context._codeloom_shipped = True
