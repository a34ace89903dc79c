"""Session settings the operators rely on, and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Adaptive execution does the run-time work: it coalesces small shuffle
# partitions, splits skewed join partitions and turns a sort-merge join into a
# broadcast join only after the build side has been measured.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# HotSpot never compiles a method of more than 8,000 bytes, as whole-stage code over all features is: from there
# on Spark's smaller methods are faster.  Set per query, also in a session of a cluster.
QUERY_SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def local_session(cores: int | str = 8, app: str = "formline", memory: str = "12g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    for key, value in (SETTINGS | QUERY_SETTINGS).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> None:
    """Give the session what the plans over all features need."""
    for key, value in QUERY_SETTINGS.items():
        spark.conf.set(key, value)


def work_folder(spark: SparkSession) -> str:
    """The folder shared by driver and executors.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset in
    local mode, as in a test run, is a fresh temporary folder made and remembered;
    elsewhere executors would each write to a disk of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="formline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the work folder that nothing else uses."""
    return f"{work_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df, name: str):
    """Write ``df`` to the work folder and read it back, which cuts its lineage."""
    path = new_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, folder: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def numbered_folders(spark: SparkSession, folder: str, name: str, mark: str = "_SUCCESS") -> list[int]:
    """The numbers of the complete folders ``name=<number>`` in ``folder``, in order; ``mark`` is what tells."""
    at, files = _files(spark, folder)
    if not files.exists(at):
        return []
    paths = [s.getPath() for s in files.listStatus(at) if s.isDirectory()]
    whole = [p for p in paths if p.getName().startswith(f"{name}=") and files.exists(p.suffix(f"/{mark}"))]
    return sorted(int(p.getName().partition("=")[2]) for p in whole)


def remove_folder(spark: SparkSession, folder: str) -> None:
    at, files = _files(spark, folder)
    files.delete(at, True)


_stages: dict[tuple, object] = {}


def stage_table(spark: SparkSession, name: str, source: str, build):
    """A table written once per session: the boundary between two stages of a plan.

    ``build`` makes the rows of ``name`` from the tables in ``source``.
    """
    key = (spark.sparkContext.applicationId, name, source)
    if key not in _stages:
        _stages[key] = stored(build(), name)
    return _stages[key]


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, so that they need not find it in their working folder."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="formline-")) / "formline.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
