"""Session defaults and the helpers that cut lineage through shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(name: str = "paperloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` wins over them."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Where that setting is absent (tests on ``local[*]``) a temporary folder is made and set as
    the checkpoint folder; on any other master its absence is an error, because a folder of one
    machine would not survive the loss of that machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to storage that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="paperloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Folders made by this process that nothing has removed yet; a folder is in the list of every scratch it was made in.
_open: list[list[str]] = []


def new_folder(spark: SparkSession, label: str) -> str:
    """The name of a folder below the shared one that goes when the :func:`scratch` around it ends."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    for made in _open:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the tables that were written within it: consume the results inside.

    Without one, tables stay until whoever owns ``spark.checkpoint.dir`` clears it, because a lazy result may still
    read them.
    """
    made: list[str] = []
    _open.append(made)
    try:
        yield
    finally:
        _open.remove(made)
        for path in made:
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends at those files."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast.

    The size of compressed files, by which Spark would choose, tells little of their rows: a table that is small on disk can take
    hundreds of megabytes of the driver as a broadcast.
    """
    return df.hint("merge")


def discard(df: DataFrame) -> None:
    """Remove the files behind a table made by :func:`written` that nothing reads any more."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    root = shared_root(spark).split(":", 1)[-1].lstrip("/")
    for folder in folders:
        if root in folder:
            _remove(spark, folder)


def spread(df: DataFrame) -> DataFrame:
    """``df``, shuffled to all cores where its files give fewer partitions than there are cores; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fresh_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until it clashes with no column of ``df`` in any letter case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
