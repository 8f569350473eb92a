"""Session helpers: shipping the package to executors and scratch tables."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Local scratch folders by application, and the folders of all operator runs.
_LOCAL: dict[str, str] = {}
_ROOTS: list[tuple[SparkSession, str]] = []


#: Settings of Arrow batches, with Spark's defaults and what suits whole texts.
ARROW_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m")}


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark application.

    Executors need not have the repository on their path: a zip of the package
    goes through ``addPyFile``, which every executor fetches from the driver. Arrow
    batches of whole texts get fewer rows and bytes than by Spark's defaults, which make
    tens of megabytes per task and copy; a setting of the user's own stays.
    """
    for name, (default, wanted) in ARROW_BATCHES.items():
        if spark.conf.get(name, None) == default:
            spark.conf.set(name, wanted)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``; without it only a local master can
    work, in a folder of its own. The session's settings stay as they are.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-checkpoints-")
        root = _LOCAL[app]
    return root.rstrip("/")


def _remove(jvm, conf, path: str) -> None:
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


@atexit.register
def _remove_scratch() -> None:
    """Results may be read as long as the program runs; then all scratch tables go."""
    for spark, root in _ROOTS:
        with contextlib.suppress(Exception):  # the JVM may be gone
            _remove(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), root)


class Scratch:
    """Named intermediate tables of one operator run, as Parquet in the shared folder.

    A written table cuts lineage and survives the loss of any executor. Tables no
    longer needed are dropped by the operator, so that disk use stays near that of
    the largest step.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        _ROOTS.append((spark, self.root))

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            _remove(jvm, conf, f"{self.root}/{name}")

    def release(self) -> None:
        """Let Spark clean the shuffle files of finished steps: it does so when the driver collects garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
