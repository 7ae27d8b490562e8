"""Session helpers shared by every operator."""

from __future__ import annotations

import hashlib
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only a local session that names none (tests) gets a temporary one: on a
    cluster each machine would write to a disk of its own, so it is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/dossierkit-shared"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def intermediates(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it goes when the driver's JVM ends."""
    sc = spark.sparkContext
    path = f"{shared_folder(spark)}/dossierkit-{sc.applicationId}"
    if getattr(sc, "_dossierkit_folder", None) != path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        sc._dossierkit_folder = path
    return path


def clear(spark: SparkSession) -> None:
    """Remove the application's intermediate tables; frames not yet computed can't be after that."""
    p = spark._jvm.org.apache.hadoop.fs.Path(intermediates(spark))
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    for name in ("_dossierkit_folder", "_dossierkit_indexes"):
        if hasattr(spark.sparkContext, name):
            delattr(spark.sparkContext, name)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table among the intermediates and read it back.

    Smaller on disk than a checkpoint (columnar, compressed) and it survives the
    loss of any executor; later reads prune columns and push filters.
    """
    spark = df.sparkSession
    path = f"{intermediates(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once a session.

    Workers that don't share the driver's import path get it as a zip in the
    shared folder, which Spark distributes.
    """
    sc = spark.sparkContext
    if getattr(sc, "_dossierkit_shipped", False):
        return
    package = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(Path(package.name) / p.relative_to(package))), p.read_bytes())
    body = buffer.getvalue()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{package.name}-{hashlib.md5(body).hexdigest()[:12]}-{uuid.uuid4().hex[:8]}.zip")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(body))
    out.close()
    sc.addPyFile(path.toString())
    sc._dossierkit_shipped = True
