"""Session defaults and the shared scratch folder."""

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

_LOCAL = {}


def build_session(master: str = "local[*]", app: str = "fleetlag", shuffle: int = 8) -> SparkSession:
    """A UTC session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def ship_code() -> None:
    """Send this package's functions to the workers by value, so that a session started from any
    folder can run them without installing the package on every node."""
    import fleetlag
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(fleetlag)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only where the session does not name one and runs on one machine is a temporary folder used; on a cluster each
    executor would write to its own disk, so an unset folder is refused there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="fleetlag-")
    return _LOCAL["dir"]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path inside the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, made: list[str] | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    The copy survives the loss of an executor, unlike a cached or locally checkpointed frame. Its path is added to
    ``made``, for :func:`discard` once nothing reads it any more.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, made: list[str]) -> None:
    """Remove the tables that :func:`cut_lineage` listed in ``made``, and empty the list."""
    sc = spark.sparkContext
    while made:
        path = sc._jvm.org.apache.hadoop.fs.Path(made.pop())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def cut_all(*frames: DataFrame) -> list[DataFrame]:
    """:func:`cut_lineage` for independent frames, their jobs running side by side."""
    with ThreadPoolExecutor(len(frames)) as pool:
        return list(pool.map(cut_lineage, frames))
