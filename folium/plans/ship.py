"""Makes the package importable in the Python workers of any cluster; cuts lineage in the folder they share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: dict[str, bool] = {}


def ensure_shipped(spark: SparkSession) -> None:
    """Sends the package's source to the executors, once per application."""
    sc = spark.sparkContext
    if _shipped.get(sc.applicationId):
        return
    root = Path(__file__).resolve().parent.parent
    if root.is_dir():  # when it already came from an archive, nothing is to be done
        folder = tempfile.mkdtemp(prefix="folium-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, f"{root.name}_{sc.applicationId.replace('-', '_')}.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        sc.addPyFile(path)
    _shipped[sc.applicationId] = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder of our own only where none is set, as in tests."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not (sc.master.startswith("local[") or sc.master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="folium-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back; the table is removed when the application ends.

    Unlike a checkpoint it is columnar and compressed, so that each use reads the columns it needs.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/folium-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)
