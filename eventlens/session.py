"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cpus: int = 8, memory: str = "20g") -> SparkSession:
    """A session for one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("eventlens")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that
    setting gets a folder of its own.
    """
    context = spark.sparkContext
    folder = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir")
        or context.getCheckpointDir()
    )
    if folder:
        return folder.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="eventlens-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


def steps_dir(spark: SparkSession) -> str:
    """The folder of all steps that this application writes."""
    return f"{work_dir(spark)}/eventlens/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{steps_dir(spark)}/{uuid.uuid4().hex}/{name}"


def remove_steps(spark: SparkSession) -> None:
    """Remove what ``cut`` has written in this application. Results still read from there: call it
    once they are written elsewhere, before the session stops."""
    _delete(spark, steps_dir(spark))


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, so a lost
    executor costs one re-read, and row counts come from the file footers."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.step_path = path
    return stored


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def release(*steps: DataFrame) -> None:
    """Remove the tables of steps (results of ``cut`` themselves) that no result reads any more."""
    for step in steps:
        path = getattr(step, "step_path", None)
        if isinstance(path, str):
            _delete(step.sparkSession, path)


def measured_cut(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """``cut`` plus aggregates over the rows, taken while they are written."""
    seen = Observation()
    exprs = [expr.alias(metric) for metric, expr in metrics.items()]
    stored = cut(df.observe(seen, *exprs), name)
    return stored, seen.get


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores where a few small partitions would keep most of them idle. With as many
    partitions as cores, which is always so on large data, nothing is moved. ``df`` should be read
    from a source or a stored table: its partitions are known without running anything."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
