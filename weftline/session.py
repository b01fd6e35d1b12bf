"""Session helpers: local test sessions and lineage cuts that survive executor loss."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, tuple] = {}


def local_session(cpus: int | str = "*", app: str = "weftline", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the local bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local folder is only made for a local master."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="weftline-ckpt-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    sc.setCheckpointDir(made)
    return made


def scratch_folder(spark: SparkSession) -> str:
    """Folder of this application under the shared checkpoint folder; it goes when the Python driver ends."""
    sc = spark.sparkContext
    folder = f"{checkpoint_dir(spark)}/weftline-{sc.applicationId}"
    if folder not in _FOLDERS:
        # Kept beside the folder, as a stopped session has neither.
        _FOLDERS[folder] = (sc._jvm, sc._jsc.hadoopConfiguration())
        atexit.register(_remove, folder, folder)
    return folder


def _remove(folder: str, path: str) -> None:
    """Delete a path in a scratch folder, also once its session has stopped."""
    jvm, conf = _FOLDERS[folder]
    try:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    except (Py4JError, OSError):  # the JVM ended first: the folder is named after the application and harmless
        pass


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once as a table in the shared checkpoint folder and read them back.

    The rows survive a lost executor. Against ``checkpoint()`` the plan also gets the true size of the
    table: a checkpointed plan keeps its estimate, and estimates multiply over the joins of a loop.
    The table goes with ``release`` or at the end of the application.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``cut_lineage`` wrote and that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_cut_path", None):
            _remove(path.rpartition("/")[0], path)
