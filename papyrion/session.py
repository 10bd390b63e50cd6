"""Session helpers: reading the tables and cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors' Python, once a session."""
    context = spark.sparkContext
    if getattr(context, "_papyrion_shipped", False):
        return
    root, data = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    # Through the cluster's own file system, so that every machine can read it.
    folder = f"{shared_dir(spark)}/papyrion-{uuid.uuid4().hex}/package"
    path = f"{folder}/papyrion.zip"
    fs, target = file_system(spark, path)
    out = fs.create(target)
    out.write(data.getvalue())
    out.close()
    _written.append((spark, folder))
    context.addPyFile(path)
    context._papyrion_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all machines share.

    Only where it is unset on one machine (tests, laptops) a folder of our own is made; on a cluster that would be
    another folder on each machine, so it is refused.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        path = "file://" + tempfile.mkdtemp(prefix="papyrion-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, which goes with ``release`` or when the driver's Python ends."""
    path = f"{shared_dir(spark)}/papyrion-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a table into the shared folder and reads it again.

    The written table survives the loss of executors, and unlike ``checkpoint()`` the plan runs once.
    The files go with ``release`` or when the driver's Python ends.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):  # noqa: ANN201 - objects of the JVM
    """The Hadoop file system that holds ``path``, and the path as it knows it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def write_marker(spark: SparkSession, path: str) -> None:
    """An empty file, made in one step: what it stands for is complete."""
    fs, target = file_system(spark, path)
    fs.create(target, True).close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, written over one that is there."""
    fs, target = file_system(spark, path)
    out = fs.create(target, True)
    out.write(text.encode())
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file; None where there is none."""
    fs, target = file_system(spark, path)
    if not fs.exists(target):
        return None
    source = fs.open(target)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders right below ``path``, in order; none where it doesn't exist."""
    fs, target = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def release(spark: SparkSession) -> None:
    """Deletes all that was written on the way to results, once the results were read or written elsewhere.

    A long session calls it between queries; DataFrames that were made before can't be read any more.
    """
    kept = []
    for session, path in _written:
        if session is not spark or path.endswith("/package"):
            kept.append((session, path))
            continue
        fs, target = file_system(spark, path)
        fs.delete(target, True)
    _written[:] = kept


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            fs, target = file_system(spark, path)
            fs.delete(target, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return
