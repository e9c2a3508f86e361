"""Session helpers: reading tables, and cutting lineage in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Bytes of input for each core below which a table is dealt anew for long work.
SMALL_BYTES = 64 << 20
_SET_HERE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only where the setting is absent and the master is local does this fall back
    to a temporary folder; on a cluster without the setting it raises, since a
    machine-local folder would lose data with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _SET_HERE:
        _SET_HERE[app] = tempfile.mkdtemp(prefix="presencia-")
    return _SET_HERE[app]


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, lineage cut.

    The columnar copy survives the loss of any executor.  Folders are named
    ``presencia/<application>/<name>-<random>``; :func:`clear` removes an application's, and an operator of the
    cluster may delete those of finished ones.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/presencia/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the folder of what :func:`materialise` returned, once nothing reads it any more."""
    for file in df.inputFiles()[:1]:
        fs, inner = pafs.FileSystem.from_uri(file.rpartition("/")[0])
        fs.delete_dir(inner)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder; results that still read it must have been stored."""
    folder = f"{shared_dir(spark)}/presencia/{spark.sparkContext.applicationId}"
    fs, inner = pafs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)
    if fs.get_file_info(inner).type == pafs.FileType.Directory:
        fs.delete_dir(inner)


def spread(df: DataFrame) -> DataFrame:
    """``df``, a scan of files, over all cores, for work that is long for its bytes: dealt anew only if it is small.

    Small is fewer files than cores, of less than SMALL_BYTES for each core in all: such files may hold too few row groups to
    keep all cores busy.  A larger table is left as it is, so nothing is moved where that would cost.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = df.inputFiles()
    if len(files) >= cores:
        return df
    size = 0
    for file in files:
        fs, inner = pafs.FileSystem.from_uri(file)
        size += fs.get_file_info(inner).size or 0
    return df.repartition(cores) if size < SMALL_BYTES * cores else df
