"""Session helpers: table access and the shared scratch folder."""

from __future__ import annotations

import atexit
import gc
import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table; only the columns a query selects are scanned."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once per context.

    The packed modules go to the shared folder and are added as a Python file,
    so that workers need neither an installation nor the driver's search path.
    """
    context = spark.sparkContext
    if getattr(context, "_gridloom_shipped", False):
        return
    here, packed = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(here.rglob("*.py")):
            z.writestr(f"{here.name}/{source.relative_to(here).as_posix()}", source.read_bytes())
    folder = f"{shared_dir(spark)}/gridloom-code-{uuid.uuid4().hex}"
    path = f"{folder}/gridloom.zip"
    _FILES[folder], (at, fs) = _file_system(spark, folder), _file_system(spark, path)
    out = fs.create(at)
    out.write(packed.getvalue())
    out.close()
    context.addPyFile(path)
    context._gridloom_shipped = True


def activate(spark: SparkSession) -> None:
    """Make the session the active one of this thread, by which data sources are looked up."""
    SparkSession._get_j_spark_session_class(spark.sparkContext._jvm).setActiveSession(spark._jsparkSession)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, taken from ``spark.checkpoint.dir``.

    Where that setting is absent the context's own checkpoint folder counts. Only
    on one machine (tests) a folder of our own is made and recorded in the
    session, so that later calls agree on it; on a cluster that is a
    ``ValueError``, since executors would write to and read from different disks.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("gridloom.scratch.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("gridloom.scratch.dir", path)
    return path.rstrip("/")


#: Paths written by this process -> what tells whether a plan still reads them (None: kept to the end).
_HELD: dict[str, object] = {}
_FILES: dict[str, tuple] = {}


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: a lost executor re-reads files instead of recomputing,
    and the plan after it starts from a scan. The table is columnar and
    compressed, and is computed exactly once (an RDD checkpoint computes twice).
    It is deleted by :func:`discard`, by the first :func:`sweep` after no plan
    reads it any more, or at the end of the process.
    """
    spark = df.sparkSession
    sweep(spark)
    path = f"{shared_dir(spark)}/gridloom/{label}-{uuid.uuid4().hex}"
    _FILES[path] = _file_system(spark, path)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._gridloom_path = path
    try:  # every plan over the table, however derived, holds this one object of its scan
        _HELD[path] = spark.sparkContext._jvm.java.lang.ref.WeakReference(back._jdf.queryExecution().analyzed().relation())
    except Py4JError:  # another kind of scan: kept to the end
        _HELD[path] = None
    return back


@contextmanager
def scratch(spark: SparkSession, label: str) -> Iterator[str]:
    """A folder of its own in the shared one, deleted at the end."""
    path = f"{shared_dir(spark)}/gridloom/{label}-{uuid.uuid4().hex}"
    _FILES[path] = _file_system(spark, path)
    try:
        yield path
    finally:
        _delete(path)


def discard(table: DataFrame) -> None:
    """Delete a table made by :func:`cut` that no later plan reads."""
    _delete(table._gridloom_path)


def sweep(spark: SparkSession, collect: bool = False) -> None:
    """Delete the cut tables that no plan reads any more.

    ``collect`` first has the garbage of Python and of the JVM collected.
    """
    if collect:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    for path, seen in list(_HELD.items()):
        try:
            unread = seen is not None and seen.refersTo(None)
        except Py4JError:  # of a JVM that has ended
            _HELD.pop(path, None)
            _FILES.pop(path, None)
            continue
        if unread:
            _delete(path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this library has cut in the shared folder."""
    path = f"{shared_dir(spark)}/gridloom"
    _FILES[path] = _file_system(spark, path)
    _delete(path)
    for inner in [p for p in _HELD if p.startswith(f"{path}/")]:
        del _HELD[inner], _FILES[inner]


def _delete(path: str) -> None:
    _HELD.pop(path, None)
    if found := _FILES.pop(path, None):  # another thread may have been faster
        at, fs = found
        fs.delete(at, True)


@atexit.register
def _leave() -> None:
    """What is left at the end of the process."""
    for path in list(_FILES):
        try:
            _delete(path)
        except Exception:  # the JVM is gone
            return


def _file_system(spark: SparkSession, path: str):
    """Hadoop's path and file system object of a path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
