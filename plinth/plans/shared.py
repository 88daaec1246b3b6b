"""Tables written between the steps of a plan, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark's switch that deletes a query's shuffle files when it ends; else they go when the driver happens to collect its garbage.
CLEAR = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: The temporary folder of a session on one machine that names none.
_own: dict[str, str] = {}


def _resolved(spark: SparkSession, path: str):
    """Hadoop's file system and the whole path; one without a scheme belongs to the default file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return files, files.makeQualified(p)


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A session without one gets a temporary folder if it runs on one machine, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        at = _own[app] = _own.get(app) or f"file://{tempfile.mkdtemp(prefix='plinth-')}"
    whole = _resolved(spark, at)[1].toString()
    return whole if "://" in whole else whole.replace(":/", ":///", 1)


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _resolved(spark, path)
    return files.exists(at)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, in whatever store it is."""
    files, at = _resolved(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(at) if s.isDirectory()) if files.exists(at) else []


class Scratch:
    """A folder of one run. A kept table cuts the lineage: it survives the loss of any executor. The folder goes when the driver's JVM ends, as results may read from it until then.

    With ``clear`` the shuffle files of a table's query go as soon as it is kept.
    """

    def __init__(self, spark: SparkSession, name: str, clear: bool = False):
        self.spark, self.root, self.clear = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", clear
        files, at = _resolved(spark, self.root)
        files.deleteOnExit(at)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        before = self.spark.conf.get(CLEAR, "false")
        try:
            self.spark.conf.set(CLEAR, "true" if self.clear else before)
            df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        finally:
            self.spark.conf.set(CLEAR, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        for n in names:
            files, at = _resolved(self.spark, f"{self.root}/{n}")
            files.delete(at, True)
