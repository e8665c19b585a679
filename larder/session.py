"""Session settings, table access and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings that the operators expect (UTC, AQE)."""
    builder = SparkSession.builder.master(master).appName("larder")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only a local master without that setting gets a temporary folder; on a
    cluster a missing setting is an error, since a machine-local folder would
    not be seen by the other executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _local
    if _local is None:
        _local = tempfile.mkdtemp(prefix="larder-")
    return f"file://{_local}"


_local: str | None = None


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session; they may start elsewhere than the driver."""
    context = spark.sparkContext
    if getattr(context, "_larder_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():
        at = Path(tempfile.mkdtemp(prefix="larder-")) / "larder-package.zip"
        with zipfile.ZipFile(at, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(str(at))  # served by the driver to all executors
    context._larder_shipped = True


class Scratch:
    """Tables written to the shared folder, to cut lineage and reuse results.

    A written table survives the loss of executors and is read back with real
    sizes, so later joins are planned from them.  ``drop`` removes a table that
    no later step reads; the rest stays as long as lazy results may read it and
    goes with the shared folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def keep(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        path = self.path(name)
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._larder_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_larder_path", None)
        if path:
            jvm = self.spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
