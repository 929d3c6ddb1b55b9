"""Session helpers: table access and durable cuts of long lineages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "papyra", cpus: int | str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE); a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables, lazily; a file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    """How many tasks to spread work over that is heavier than its bytes tell, so that sizes alone would give too few."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by spark.checkpoint.dir; a local temporary one where that is unset, as in tests."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="papyra-"))
    return sc.getCheckpointDir()


_made: list[str] = []


def clear_cuts(spark: SparkSession) -> None:
    """Deletes everything that cuts of this process have written and not dropped. Only for when no result that reads it is needed any more, as after a query was written out."""
    while _made:
        at = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Cut:
    """Writes intermediate results as Parquet in the shared folder, so that a lost executor never replays a long lineage.

    ``cut(df)`` writes and reads back; ``drop(df)`` deletes what an iterative operator no longer needs. What is not
    dropped stays, as lazy results may still read it, until ``clear_cuts``.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base, self.paths = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", {}
        _made.append(self.base)

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{len(self.paths):04d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, df: DataFrame) -> None:
        path, _ = self.paths[id(df)]
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
