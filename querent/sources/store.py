"""Tables that are kept by key: written aside, renamed into place as a whole, and believed only if they are whole.

A table is a folder with Parquet files under data and a manifest of facts: what its maker says, and how many files of
how many bytes there are. Writers work in folders of their own and the first to rename wins; a table whose files
aren't those of its manifest counts as absent, is moved away and made again. Files outlive executors, so nothing is
recomputed when one is lost, and a key holds what the source's files were, so a rewritten source is never answered
from an old table.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL: dict[str, str] = {}


def default_root(spark: SparkSession) -> str:
    """What spark.querent.store names, or a folder below spark.checkpoint.dir; where neither is set, a local one, which
    only a local master may use."""
    named = spark.conf.get("spark.querent.store", None)
    if named:
        return named.rstrip("/")
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return f"{found.rstrip('/')}/querent-store"
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share, or name a root")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="querent-store-")
    return _LOCAL[sc.applicationId]


@cache
def code_version() -> str:
    """A digest of this package's code, so that tables of other code aren't taken for this one's."""
    top = Path(__file__).resolve().parents[1]
    files = [f for part in ("functions", "operators", "sources") for f in sorted((top / part).glob("*.py"))]
    return hashlib.sha256(b"\0".join(f.read_bytes() for f in files)).hexdigest()[:16]


def digest(*parts: object) -> str:
    """A key of 32 hex digits, of parts and of this package's code."""
    return hashlib.sha256("\0".join(map(str, (code_version(), *parts))).encode()).hexdigest()[:32]


def fingerprint(df: DataFrame) -> str:
    """A digest that changes with df's plan, its schema or the names, sizes and times of the files it reads; of a frame
    without files, with its rows."""
    spark, seen = df.sparkSession, []
    for name in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        seen.append((name, status.getLen(), status.getModificationTime()))
    if not seen:
        found = df.select(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)).cast("decimal(38,0)").alias("h")).agg(F.count("*"), F.sum("h")).first()
        return digest(df.schema.simpleString(), *found)
    return digest(df.schema.simpleString(), df.semanticHash(), seen)


class Store:
    """Tables below a root folder, which the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, (root or default_root(spark)).rstrip("/")

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    @contextmanager
    def scratch(self) -> Iterator[Store]:
        """A store within this one that goes with all its tables in the end."""
        name = f"aside/scratch-{uuid.uuid4().hex}"
        try:
            yield Store(self.spark, f"{self.root}/{name}")
        finally:
            path, fs = self._path(name)
            fs.delete(path, True)

    def manifest(self, key: str) -> dict | None:
        """The facts of a whole table; None for one that is absent or broken."""
        path, fs = self._path(key, "manifest.json")
        try:
            stream = fs.open(path)
            try:
                text = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            facts = json.loads(text)
            data, _ = self._path(key, "data")
            size = fs.getContentSummary(data)
            if (size.getFileCount(), size.getLength()) == (facts["files"], facts["bytes"]):
                return facts
        except (Py4JJavaError, ValueError, KeyError):
            pass
        return None

    def read(self, key: str) -> DataFrame | None:
        facts = self.manifest(key)
        return None if facts is None else self._data(key, T.StructType.fromJson(facts["schema"]))

    def _data(self, folder: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{folder}/data").select(*(f"`{f.name}`" for f in schema))

    def build(self, key: str, make: Callable[[], DataFrame], facts: Callable[[DataFrame], dict] | None = None, partition_by: tuple[str, ...] = (), fits: Callable[[dict], bool] = lambda facts: True) -> DataFrame:
        """The table of a key, made and written if there is none that is whole and fits.

        facts: what the manifest says of the written table besides its schema, files and bytes.
        """
        for _ in range(3):  # once more where another writer has put one in place that doesn't hold
            held = self.manifest(key)
            if held is not None and fits(held):
                return self._data(key, T.StructType.fromJson(held["schema"]))
            self._discard(key)
            aside = f"aside/{key}-{uuid.uuid4().hex}"
            try:
                frame = make()
                frame.write.partitionBy(*partition_by).option("compression", "zstd").parquet(f"{self.root}/{aside}/data")
                said = facts(self._data(aside, frame.schema)) if facts else {}
                self._describe(aside, {**said, "schema": frame.schema.jsonValue()})
                self._into_place(aside, key)
            finally:
                path, fs = self._path(aside)
                fs.delete(path, True)
        raise RuntimeError(f"the table {key} doesn't hold what is asked of it")

    def _describe(self, aside: str, said: dict) -> None:
        data, fs = self._path(aside, "data")
        size = fs.getContentSummary(data)
        path, _ = self._path(aside, "manifest.json")
        stream = fs.create(path, False)
        try:
            stream.write(bytearray(json.dumps({**said, "files": size.getFileCount(), "bytes": size.getLength()}).encode()))
        finally:
            stream.close()

    def _into_place(self, aside: str, key: str) -> bool:
        """Rename unless another writer's table is there already; whether it was renamed."""
        (source, _), (target, _) = self._path(aside), self._path(key)
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        context.mkdir(target.getParent(), None, True)
        nothing = self.spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(source, target, nothing)
        except Py4JJavaError as e:
            if "AlreadyExists" not in str(e.java_exception.getClass().getName()) and "not empty" not in str(e):
                raise
            return False
        return True

    def _discard(self, key: str) -> None:
        """A broken table goes; it is moved first, so that no reader sees half of it."""
        (path, fs), (away, _) = self._path(key), self._path("aside", f"broken-{uuid.uuid4().hex}")
        if fs.exists(path):
            fs.mkdirs(away.getParent())
            if fs.rename(path, away):
                fs.delete(away, True)
