"""Session helpers: local sessions for tests, scratch space, materialised tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession


# The fallback folder of a local session, made on first use.
_local_scratch: list[str] = []


def local_session(app: str = "threadlake", cpus: str = "*", shuffle: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A local session with the settings the library assumes on a cluster."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return use_utc(spark)


def use_utc(spark: SparkSession) -> SparkSession:
    """Calendar columns are defined on UTC days; workers get the package."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return ship_package(spark)


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application.

    The archive lies in Spark's own folder for files to distribute.
    """
    context, name = spark.sparkContext, f"{__package__}.zip"
    if name not in context._python_includes:
        home = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(SparkFiles.getRootDirectory(), "packed", name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with zipfile.ZipFile(path, "w") as packed:
            for folder, _, files in os.walk(home):
                for file in sorted(f for f in files if f.endswith(".py")):
                    full = os.path.join(folder, file)
                    packed.write(full, os.path.relpath(full, os.path.dirname(home)))
        context.addPyFile(path)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables and stream checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may fall back to a
    folder of its own: on a cluster a machine-local folder would be lost with its machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:  # a folder per application, so that what it leaves can be removed as one
        return f"{shared.rstrip('/')}/threadlake-{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if not _local_scratch:
        _local_scratch.append(tempfile.mkdtemp(prefix="threadlake-"))
    return _local_scratch[0]


def clear_scratch(spark: SparkSession) -> None:
    """Remove the tables this application has left in shared storage.

    For the caller, once the results that read them are written.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back.

    Cuts the lineage, survives executor loss, and gives the optimizer real file sizes for
    its broadcast decisions.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Use every core for work that costs far more than moving its rows.

    A few large files give a few scan tasks, which would then do all of it. Inputs that
    already have a task per core are left alone, and so are streams and what comes out of a shuffle
    (asking an adaptive plan for its partitions would run it).
    """
    if df.isStreaming or df._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
