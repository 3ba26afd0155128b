"""What every operator of this subpackage shares: shipping code, shared scratch tables, small collects."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_LOCAL_SCRATCH: dict[str, str] = {}
ARROW_BATCH, _BATCH_CONF = "8m", "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors, once per application.

    Arrow batches are held to ARROW_BATCH bytes, unless the session has another bound than Spark's default: two
    workers' batches of long texts would fill a small executor.
    """
    sc = spark.sparkContext
    if spark.conf.get(_BATCH_CONF) in ("67108864b", "64m", "64MB"):
        spark.conf.set(_BATCH_CONF, ARROW_BATCH)
    if sc.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parents[1]
    if sc.master.startswith("local["):  # workers see the driver's files
        sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [str(top.parent), sc.environment.get("PYTHONPATH")]))
    else:  # the driver serves the archive as long as the application runs
        archive = os.path.join(tempfile.mkdtemp(prefix="querent-code-"), f"{top.name}.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only for local masters that name none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    sc = spark.sparkContext
    if not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[sc.applicationId] = tempfile.mkdtemp(prefix="querent-")
    return _LOCAL_SCRATCH[sc.applicationId]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared scratch folder and read it back: later plans start there.

    A lost executor costs no recomputation of df, as the files outlive it.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/querent/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files of cut() tables that no live plan needs."""
    jvm = spark._jvm
    for table in tables:
        for f in table.inputFiles():
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(column: str, n: int):
    """crc32(column as text) mod n, the fold that labels are split by; null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n
