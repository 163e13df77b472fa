"""Written tables between jobs, and joins against small keyed tables.

Everything here goes through the folder named by ``spark.checkpoint.dir``,
which a cluster points at shared storage, so a lost executor never loses an
intermediate result.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_dirs: dict[str, str] = {}
_owned: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the session's setting, or, on a local
    master only, a fresh temporary folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="keystead-")
    return _local_dirs[sc.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other table uses."""
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if folder not in _owned:
        _owned.add(folder)
        atexit.register(_remove_at_exit, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _remove_at_exit(spark: SparkSession, folder: str) -> None:
    """The application's own tables go when its driver ends; nothing else is in this folder."""
    if spark.sparkContext._jsc is not None:
        delete(spark, folder)
    elif folder.startswith(("/", "file:")):  # the session is stopped: a local folder can still be removed
        shutil.rmtree(folder.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def materialise(df: DataFrame, name: str = "stage", by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet and read it back.

    Cuts the lineage at the points where a later step reads the same rows more
    than once; the readers then prune columns and push filters into the scan.
    With ``by``, a folder for each value of that column (``path/by=value``).
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go when a query ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def discard(df: DataFrame) -> None:
    """Delete the table behind a result of ``materialise`` that nothing will read again."""
    delete(df.sparkSession, df.written_to)


def _place(spark: SparkSession, path: str):
    """A path and its file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    place, files = _place(spark, path)
    files.delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    place, files = _place(spark, path)
    return files.exists(place)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if it does not exist."""
    place, files = _place(spark, path)
    return [x.getPath().getName() for x in files.listStatus(place)] if files.exists(place) else []


def touch(spark: SparkSession, path: str) -> None:
    """An empty file, as a mark."""
    place, files = _place(spark, path)
    files.create(place, True).close()


def spread(df: DataFrame, key: str, rows_per_task: int | None = None) -> DataFrame:
    """A table in too few pieces for the cores at hand, spread by a unique key.

    A table of one small file is one task; anything with a piece per core or
    more stays as it is. With ``rows_per_task``, for narrow rows that much is made
    of, a written table also gets a piece for each that many rows, so that tasks
    stay as short however large the table and whatever the size of its files.
    """
    if df.isStreaming:
        return df
    pieces = df.sparkSession.sparkContext.defaultParallelism
    if rows_per_task is not None:
        pieces = max(pieces, -(-df.count() // rows_per_task))
    return df.repartition(pieces, key) if df.rdd.getNumPartitions() < pieces else df


def lookup_join(rows: DataFrame, table: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join rows with a per-key table whose size is known only at run time.

    The table is written first, so the planner sees its real size: under
    ``spark.sql.autoBroadcastJoinThreshold`` it is broadcast and the rows are
    not shuffled; above it the plan is a sort-merge join, whose hot keys
    adaptive execution splits.
    """
    return rows.join(materialise(table, "lookup"), on, how)


def read_if_present(spark: SparkSession, path: str, schema=None, fmt: str = "parquet", **options):
    """The table at ``path``, or None if there is none yet."""
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    try:
        return reader.load(path)
    except AnalysisException as err:
        if err.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
