"""Written tables in the folder that all executors share (``spark.checkpoint.dir``).

A ``Scratch`` is the scope of one run: what is written while it is entered goes to one folder of its own, below that of the scope
around it. Scopes belong to the thread that entered them, so runs side by side know nothing of each other. A run that raises
removes its folder. A result is lazy and may be read at any later time, so what it reads stays until ``close``, or
until the session's JVM ends.
"""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar, Token

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_scope: ContextVar[Scratch | None] = ContextVar("rarefia_scope", default=None)
_own_roots: dict[str, str] = {}


def _root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that setting is missing, a session on one machine gets a temporary folder, and on a
    cluster it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _own_roots.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="rarefia-checkpoint-")
        _own_roots[context.applicationId] = root
    return root.rstrip("/")


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


class Scratch:
    """One run's folder of written tables; entered, it takes what this thread writes."""

    def __init__(self, spark: SparkSession):
        self.spark, self._parent, self._token = spark, _scope.get(), None
        above = self._parent.folder if self._parent else _root(spark)
        self.folder = f"{above}/rarefia-{uuid.uuid4().hex}"
        self._last = not self._parent
        self._named: list[str] = []

    def __enter__(self) -> Scratch:
        self._token: Token | None = _scope.set(self)
        return self

    def __exit__(self, kind, error, trace) -> None:
        _scope.reset(self._token)
        if kind is not None:
            self.close()

    def path(self) -> str:
        """A new folder for one table."""
        if self._last:  # the outermost scope's folder goes with the session at the latest
            path, system = _file_system(self.spark, self.folder)
            system.mkdirs(path)
            system.deleteOnExit(path)
            self._last = False
        self._named.append(f"{self.folder}/rarefia-{uuid.uuid4().hex}")
        return self._named[-1]

    def keep(self, *results: DataFrame) -> None:
        """Remove all tables of this scope but those that the results read."""
        used = {part for df in results for f in folders(df) for part in f.split("/")}
        for folder in self._named:
            if folder.rsplit("/", 1)[1] not in used:
                discard_path(self.spark, folder)
        self._named = [f for f in self._named if f.rsplit("/", 1)[1] in used]

    def close(self) -> None:
        """Remove the folder; nothing that reads it can be computed any more."""
        discard_path(self.spark, self.folder)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder for one written table, in the scope that is entered or in one of its own."""
    return (_scope.get() or Scratch(spark)).path()


def written(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends here, and a lost executor costs
    no more than the tasks that follow."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])).parquet(path)


def folders(df: DataFrame) -> set[str]:
    """The folders of the files that a table's plan reads."""
    return {f.rsplit("/", 1)[0] for f in df.inputFiles()}


def discard(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for df in tables:
        for folder in folders(df):
            discard_path(df.sparkSession, folder)


def discard_path(spark: SparkSession, folder: str) -> None:
    """Remove a folder that ``scratch_dir`` named."""
    if "/rarefia-" in folder:
        path, system = _file_system(spark, folder)
        system.delete(path, True)
