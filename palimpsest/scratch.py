"""The folder that driver and executors share, and tables in it."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a temporary one on a local master; elsewhere an error, as executors would write to their own disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/palimpsest/{tag}-{uuid.uuid4().hex}"


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


#: Paths of the tables that written() made in this process, in order.
_MADE: list[str] = []


def made() -> int:
    """How many tables there are so far, for drop_since."""
    return len(_MADE)


def drop_since(spark: SparkSession, mark: int) -> None:
    """Deletes the tables that written() made since made() gave mark; nothing may read them any more."""
    while len(_MADE) > mark:
        fs, p = _file(spark, _MADE.pop())
        fs.delete(p, True)


def written(df: DataFrame, tag: str, by: list[str] | None = None, **options: str) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage, keeps plans of loops short, and outlives lost executors. by: columns that folders are named by. options are the Parquet writer's."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.options(**options).partitionBy(*by or []).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    _MADE.append(path)
    return out


#: Shuffled bytes that one task orders and writes, about.
PIECE = "12m"


@contextmanager
def small_pieces(spark: SparkSession):
    """What Spark deals by bytes while this holds is dealt by PIECE: rows of one kind pack into few bytes, which a task unpacks to sort them."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, PIECE)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def files_of(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files under a path: equal while nothing there was written anew."""
    fs, p = _file(spark, path)
    each, out = fs.listFiles(p, True), []
    while each.hasNext():
        f = each.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def is_there(df: DataFrame) -> bool:
    """Whether the table behind a frame that written() made still exists."""
    fs, p = _file(df.sparkSession, df._scratch)
    return fs.exists(p)


def drop_written(df: DataFrame) -> None:
    """Deletes the table behind a frame that written() made, once nothing reads it any more."""
    if getattr(df, "_scratch", None):
        fs, p = _file(df.sparkSession, df._scratch)
        fs.delete(p, True)
