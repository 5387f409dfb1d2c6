"""Session settings and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "perilgrid", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; a cluster supplies its own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that intermediate tables and stream checkpoints go to.

    A cluster names a shared folder in ``spark.checkpoint.dir``.  Only a local
    master may fall back to a temporary folder, because executors on other
    machines could not read it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="perilgrid-ckpt-")
    sc.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Writes the rows under the shared folder and reads them back; ``codec`` is another compression for large ones.

    A lost executor then costs a read and not a replay.  A written table is
    used rather than ``checkpoint()`` because a checkpoint carries the size
    estimate of its plan along; in a loop of joins that estimate multiplies
    every round, while a table's size is that of its files.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes tables that ``cut_lineage`` wrote, once nothing will read them again.

    What has been worked out from them must have been written itself by then.
    """
    for table in tables:
        path = table.__dict__.pop("_scratch", None)
        if path:
            place = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
