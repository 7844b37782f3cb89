"""Session defaults and the folder for tables that cut lineage."""

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def local_session(cores: str = "8", name: str = "alertloom") -> SparkSession:
    """A session for tests and single-machine runs; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("ALERTLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def tune(spark: SparkSession) -> SparkSession:
    """Keeps generated methods within what the JVM compiles.

    The per-alert CASE chains make one method of over 30 kB when fused; HotSpot leaves methods
    above 8000 bytes interpreted. With this limit Spark generates the projection in small methods.
    """
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def spread(df):
    """Shuffles a scan into more partitions when there are fewer of them than cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local-master session may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="alertloom-")
    return _LOCAL_DIRS[app]


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """What is run inside gives back its shuffle files when it has run, not when the driver happens to
    collect its garbage. For frames that are written or checkpointed: nothing reads their shuffles again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df, what: str):
    """The frame as a table in the shared folder, made once."""
    path = new_path(df.sparkSession, what)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder that only held tables between steps."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut_lineage(df):
    """Reliable checkpoint of ``df`` in the shared folder: it survives the loss of executors."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark))
    with shuffles_freed(spark):
        return df.select("*").checkpoint(eager=True)  # a frame made before would keep its shuffles
