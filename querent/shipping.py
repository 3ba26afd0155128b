"""Makes this package importable where tasks run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Bytes of an Arrow batch where the session has Spark's default; texts, or blocks of an index, would fill a small executor.
ARROW_BATCH, _BATCH_CONF = "8m", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Arrays are read row by row: a vectorized batch holds 4,096 rows, however long, and a block of an index can be some MB.
_NESTED_CONF = "spark.sql.parquet.enableNestedColumnVectorizedReader"


def ship(spark: SparkSession) -> None:
    """Once per application; what runs Python in tasks calls it. Local workers see the driver's files, others get an archive
    that the driver serves as long as the application runs."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH_CONF) in ("67108864b", "64m", "64MB"):
        spark.conf.set(_BATCH_CONF, ARROW_BATCH)
    spark.conf.set(_NESTED_CONF, "false")
    if sc.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    if sc.master.startswith("local["):
        sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [str(top.parent), sc.environment.get("PYTHONPATH")]))
    else:
        archive = os.path.join(tempfile.mkdtemp(prefix="querent-library-"), "querent-library.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)
