"""Session helpers: shared scratch tables and size-checked joins.

Everything that has to survive the loss of an executor is written below the
folder that the session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a table counts as small enough to be sent to every executor.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16_000_000
#: Rows of a shuffle partition, and bytes of files or of merged partitions, that a task of a sized stage takes, about.
TASK_ROWS, TASK_BYTES = 1_000_000, 8_000_000

_local_roots: dict[str, str] = {}
_shipped: set[str] = set()
#: Paths of the open scopes, the innermost last, and the catalog's names of bucketed tables by path.
_scopes: list[list[str]] = []
_names: dict[str, str] = {}


def ship(spark: SparkSession) -> SparkSession:
    """Let the executors' Python import this package: once an application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = Path(__file__).resolve().parent
        path = f"{tempfile.mkdtemp(prefix='meshwork-')}/meshwork.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    ``spark.checkpoint.dir`` when the session has it. Where it is unset a folder
    of this process serves on a local master (tests, a single machine); on a
    cluster that would be another disk for each executor, so it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="meshwork-")
    return _local_roots[app]


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below the scratch folder, deleted when its scope or the JVM ends."""
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    if _scopes:
        _scopes[-1].append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    if path in _names:
        spark.sql(f"DROP TABLE IF EXISTS {_names.pop(path)}")
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(jpath, True)
    fs.cancelDeleteOnExit(jpath)


def materialise(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    Cuts the lineage: later failures re-read files, not the whole history.
    Column pruning and statistics keep working because it is plain Parquet.
    """
    spark = ship(df.sparkSession)
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._meshwork_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete materialised tables that nothing reads any more; others are left alone."""
    for df in tables:
        path = getattr(df, "_meshwork_path", None)
        if path:
            _delete(df.sparkSession, path)
            df._meshwork_path = None


def bucketed(df: DataFrame, key: str, tag: str = "b", dealt: bool = False) -> DataFrame:
    """Like ``materialise``, in as many buckets of ``key`` as the session has shuffle partitions.

    Spark knows how such a table is dealt out, so joins and aggregates on
    ``key`` do not shuffle it again. The files lie below the scratch folder; the
    session's catalog gets a name for them. ``dealt`` is for rows that come from
    such a table and need no other exchange.
    """
    spark = ship(df.sparkSession)
    path = scratch_path(spark, tag)
    name = "meshwork_" + path.rsplit("-", 1)[1]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df if dealt else df.repartition(n, key)).write.bucketBy(n, key).option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out._meshwork_path, _names[path] = path, name
    return out


@contextmanager
def sized(spark: SparkSession, rows: int):
    """What is written within is cut by size: a shuffle partition for every TASK_ROWS of ``rows``, but no fewer than the
    session asks for, and no more than TASK_BYTES of files or of merged partitions a task.

    So the memory of a task stays the same however large the tables are. It
    holds for plans that are run within, not for those that are only built.
    """
    size_of = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    parts = "spark.sql.shuffle.partitions"
    before = {k: spark.conf.get(k) for k in (parts, "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        for k, v in before.items():
            spark.conf.set(k, str(max(int(v), -(-rows // TASK_ROWS)) if k == parts else min(size_of(v), TASK_BYTES)))
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@contextmanager
def scratch_scope(spark: SparkSession, keep: list[DataFrame]):
    """Delete the scratch tables made within, but for those appended to ``keep``."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield keep
    finally:
        _scopes.pop()
        kept = {getattr(df, "_meshwork_path", None) for df in keep}
        for path in made:
            if path not in kept:
                _delete(spark, path)
            elif _scopes:
                _scopes[-1].append(path)


def row_bytes(schema: T.StructType) -> Column:
    """About the bytes that a row takes: lengths of strings and arrays, eight for anything else."""

    def of(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        if isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
                return F.coalesce(F.aggregate(c, F.lit(16), lambda a, x: a + of(x, kind.elementType)), F.lit(16))
            return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) * 8 + 16
        if isinstance(kind, T.StructType):
            return sum((of(c[f.name], f.dataType) for f in kind.fields), F.lit(8))
        return F.lit(8)

    return sum((of(F.col(f"`{f.name}`"), f.dataType) for f in schema.fields), F.lit(0))


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a table, cheap to read, has few enough rows and bytes to be sent to every executor."""
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes(df.schema).cast("long")), F.lit(0))).first()
    return n <= rows and total <= size


def small_join(big: DataFrame, small: DataFrame, on, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join that broadcasts ``small`` only after its rows and bytes have been counted.

    ``small`` should be cheap to read (materialised). Beyond ``limit`` rows or
    BROADCAST_BYTES the join is a plain shuffle join whose skewed keys adaptive
    execution splits.
    """
    return big.join(F.broadcast(small) if is_small(small, limit) else small, on, how)
