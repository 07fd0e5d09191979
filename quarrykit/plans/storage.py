"""Shared storage: where lineage is cut so that a lost executor costs only its own tasks."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process (tests) is a
    temporary folder of our own used; a cluster without the setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="quarrykit-")
    return _OWN[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/quarrykit-{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: whoever owns the folder clears it
        pass


#: With it Spark drops a query's shuffle files at the query's end, not when the driver's collector finds them unreachable.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: cuts the lineage, survives lost executors.

    The shuffles behind the written table are dropped at once; the session's own setting holds again afterwards.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(DROP_SHUFFLES)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarrykit_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``staged`` wrote, once everything that reads them is written itself."""
    for t in tables:
        _remove(t.sparkSession, t._quarrykit_path)


def width(spark: SparkSession) -> int:
    """How many partitions the cluster wants for a shuffle."""
    ship(spark)
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that they need no copy of the repository."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    file = Path(tempfile.mkdtemp(prefix="quarrykit-ship-")) / "quarrykit.zip"
    with zipfile.ZipFile(file, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(file))
    _SHIPPED.add(sc.applicationId)
