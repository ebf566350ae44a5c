"""Session defaults, the shared scratch folder, and tables that cut lineage."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Whether the files of a finished query's shuffles are removed; nothing reads them once its result is written.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL: dict[str, str] = {}  # application -> its temporary folder, local masters only


def local_session(cores: int | str = "*", app: str = "glosswork", shuffle_partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a machine-local folder
    would be lost with its executor, so an unset value is an error there.
    """
    path = spark.conf.get(CHECKPOINT_KEY, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="glosswork-")
        path = _LOCAL[app]
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch folder; nothing is ever overwritten there."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Tables written while it is open; they are deleted when it closes, but for those given to ``keep``.

    with scratch(spark) as tables:
        ...                          # materialize() as often as needed
        result = tables.keep(materialize(..., "result"))
    """

    def __init__(self, spark: SparkSession):
        self._spark, self._paths = spark, {}

    def add(self, df: DataFrame, path: str) -> None:
        self._paths[id(df)] = (df, path)  # holding the table keeps its id from being used again

    def keep(self, df: DataFrame) -> DataFrame:
        found = self._paths.pop(id(df), None)
        if found and len(_SCOPES) > 1 and _SCOPES[-1] is self:
            _SCOPES[-2].add(*found)  # the scope around this one decides
        return df

    def drop(self, *tables: DataFrame) -> None:
        """Delete some tables now."""
        for df in tables:
            _, path = self._paths.pop(id(df), (None, None))
            if path:
                target = self._spark._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(target, True)

    def close(self) -> None:
        self.drop(*[df for df, _ in list(self._paths.values())])


_SCOPES: list[Scratch] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    scope = Scratch(spark)
    _SCOPES.append(scope)
    try:
        yield scope
        scope.close()
    finally:
        _SCOPES.remove(scope)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Later passes do not repeat the upstream work, survive the loss of executors, and the optimizer
    knows the size of the table, so it broadcasts the table only when it is small enough. The files of
    the shuffles that led to it are removed when it stands. Inside ``scratch`` it is deleted at the end.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP_KEY, "false")
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP_KEY, before)
    result = spark.read.schema(df.schema).parquet(path)
    if _SCOPES:
        _SCOPES[-1].add(result, path)
    return result


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few driver-side rows as a relation inside the plan: no Python tasks, and a size the optimizer
    knows."""
    struct = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)
    columns = list(zip(*rows)) if rows else [()] * len(struct)
    table = pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table, struct)


def ship_by_value(module_name: str) -> None:
    """Pickle a module's functions by value, so Python workers need no copy of this package.

    Broadcast variables are always pickled by reference: they must hold plain arrays only."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
