"""Session set-up and the shared folder that staged tables are written to."""

from __future__ import annotations

import os
import shutil
import tempfile
import threading

from pyspark.sql import SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName("offerloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can read, taken from ``spark.checkpoint.dir``.

    Only a local session may run without that setting; it then gets a fresh
    temporary folder. A cluster without it is an error, because a folder on one
    machine would be lost together with that machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="offerloom-")
    return _LOCAL_FOLDERS[app]


def ensure_checkpoint_folder(spark: SparkSession) -> None:
    """Give Spark ML a checkpoint folder if the session has none yet."""
    folder = shared_folder(spark)
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{folder}/checkpoints")


#: Bytes of a method beyond which the JVM no longer compiles it but interprets it for every row.
JIT_LIMIT = 8000


def compile_wide_rows(spark: SparkSession) -> None:
    """Have Spark cut a projection of very many columns into methods that the JVM compiles.

    Spark by default generates one method of up to 65,535 bytes for all steps of a stage. Rows come out the same.
    """
    if int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) > JIT_LIMIT:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(JIT_LIMIT))


_SHIPPED: set[str] = set()
_SHIPPING = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the Python workers, once per application; threads of side-by-side jobs wait for each other."""
    app = spark.sparkContext.applicationId
    with _SHIPPING:
        if app in _SHIPPED:
            return
        package = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="offerloom-py-"), "offerloom_core")
        archive = shutil.make_archive(target, "zip", os.path.dirname(package), os.path.basename(package))
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(app)
