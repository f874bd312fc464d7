"""The folder that all executors share, for checkpoints and for state that outlives a query.

A cluster names it in ``spark.checkpoint.dir``. Only where that is unset (tests, a laptop) a
local temporary folder takes its place, once per session.
"""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from keyloom.sources.files import Files

_fallback: dict[str, str] = {}
_made: set[str] = set()
_shipped: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="keyloom-")
    return _fallback[app]


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A new, unused path in the shared folder, in a folder of this application that is deleted when it ends. State that is to outlive it belongs to a path of the caller's."""
    app = spark.sparkContext.applicationId
    folder = f"{shared_root(spark)}/keyloom/{app}"
    if app not in _made:
        files = Files(spark)
        files.make(folder)
        files.delete_at_end(folder)
        _made.add(app)
    return f"{folder}/{purpose}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and safe from lost executors."""
    path = shared_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers through the shared folder, once per application, so that it need not be installed where they run."""
    context = spark.sparkContext
    root = Path(__file__).resolve().parent.parent
    if context.applicationId in _shipped or not root.is_dir():
        return
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    place = f"{shared_path(spark, 'code')}/{root.name}.zip"
    Files(spark).put(place, archive.getvalue())
    context.addPyFile(place)
    _shipped.add(context.applicationId)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in enough partitions for much work per row. Only an input of fewer partitions than there are cores is shuffled; a larger one stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
