"""What the corpus operators share: the folder for intermediate tables, word splitting and Arrow helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that hold more than one in so many rows are joined by broadcast.
MOST_HOT = 256
#: A word is a run of anything but these six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where that is unset, a local session gets a temporary folder; a cluster must name one.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    made = tempfile.mkdtemp(prefix="statloom-")
    atexit.register(shutil.rmtree, made, True)
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


#: Paths of the tables that stash() wrote and that are still there.
_STASHED: list[str] = []


def stash(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it back, which cuts its lineage. Returns it and its path."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path, compression="zstd")
    _STASHED.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in this application's part of the shared folder, which goes when the application ends."""
    folder = f"{shared_dir(spark)}/statloom/{spark.sparkContext.applicationId}"
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return f"{folder}/{tag}-{uuid.uuid4().hex}"


def drop_earlier(docs: DataFrame) -> None:
    """Delete the tables that stash() wrote, but for those that docs is read from. For a stage whose documents are the
    written result of the ones before."""
    files = docs.inputFiles()
    for path in [p for p in _STASHED if not any(p.rsplit("/", 1)[1] in f for f in files)]:
        drop(docs.sparkSession, path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that stash() wrote."""
    if path in _STASHED:
        _STASHED.remove(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int):
    """crc32 of the id written as text, modulo the number of folds."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def raw(column: pa.Array) -> list:
    """The UTF-8 bytes of a string column, None for null."""
    return column.cast(pa.large_binary()).to_pylist()


def bounded_sample(ids: DataFrame, column: str, most: int, seed: int) -> DataFrame:
    """At most `most` rows: those with the smallest hash of the id.

    Rows whose hash is far above the expected limit go before the sort, so that no task holds more than a few times
    that many rows.
    """
    n = ids.count()
    own = F.xxhash64(F.lit(seed), F.col(column))
    if n > 4 * most:
        ids = ids.where(uniform(own) < 2.0 * most / n + 1000.0 / n)
    return ids.orderBy(own, column).limit(most)


def uniform(digest):
    """A number in [0, 1) that grows with a 64-bit hash."""
    return digest / F.lit(2.0**64) + F.lit(0.5)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df over the session's number of shuffle partitions. For small rows that many rows are about to come from, which
    Spark would else gather in a few tasks by their present size.

    The rows go by a hash of the keys: Spark leaves out a repartition by keys that the rows are already parted by.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(F.lit(1), *keys))


def join_hot(rows: DataFrame, told: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of rows with told, which has one row a key and in n the number of rows with it; n is left out.

    total: the number of rows. Keys with more than 1/MOST_HOT of them, less than MOST_HOT keys, are broadcast with what
    told says of them, so that no task gathers the rows of one; the rest is joined as usual.
    """
    limit = total / MOST_HOT
    hot = F.broadcast(told.where(F.col(n) > limit).drop(n))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(told.where(F.col(n) <= limit).drop(n), key))
