"""Session, table and intermediate-table helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def get_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the engine is tested with."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("verbatlas")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The Parquet table ``table`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors (or local workers, which may run elsewhere), once per application.

    Python kernels are pickled by reference, so that a worker keeps its caches (vocabularies,
    compiled patterns) between tasks; the package must then be importable on every executor.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(prefix=f"{root.name}-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    context.addPyFile(path)
    atexit.register(lambda: Path(path).unlink(missing_ok=True))


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only where that is unset (local runs and tests) a temporary folder of this machine is set.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if configured:
        return configured.rstrip("/")
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return str(current.get()).rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="verbatlas-shared-")
    context.setCheckpointDir(folder)
    return shared_dir(spark)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at exit; the folder is then the cluster's to clean
        pass


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Have a folder removed when the driver exits."""
    atexit.register(_remove, spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage as ``checkpoint()`` does, survives lost executors, and is columnar. The table
    is removed when the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/verbatlas/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(*frames: DataFrame) -> None:
    """Remove the files behind frames made by :func:`materialize`, once all that reads them is written itself."""
    for df in frames:
        for path in {os.path.dirname(p) for p in df.inputFiles()}:
            _remove(df.sparkSession, path)


def spread(df: DataFrame) -> DataFrame:
    """Spread the rows of a small input over all cores before work that is heavy on each row.

    An input with at least as many partitions as cores (any large one) is left as it is and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def parameter_rows(df: DataFrame, most: int) -> list:
    """The rows of a parameter table, which has at most ``most``; a larger one is an error, never cut."""
    rows = df.take(most + 1)
    if len(rows) > most:
        raise ValueError(f"a parameter table has more than {most} rows")
    return rows
