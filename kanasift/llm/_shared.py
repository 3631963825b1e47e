"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the word separators of the operators' contracts.
ASCII_SPACE = r"[\x20\x09-\x0D]+"
#: A key is hot if it holds over 1/HOT_KEYS of all rows, so there are fewer than HOT_KEYS hot keys at any size.
HOT_KEYS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        path = getattr(spark, "_kanasift_dir", None)
        if not path:
            path = "file://" + tempfile.mkdtemp(prefix="kanasift-")
            spark._kanasift_dir = path
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df as a table in the shared folder, which survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Removes a table of written() that nothing will read any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text, as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), ASCII_SPACE), "")


def join_by_key(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """left joined to right, whose key is unique, where left may hold a third of its rows under one key.

    counts has key and __n, left's rows of that key. The keys over total / HOT_KEYS rows are fewer than
    HOT_KEYS, so they and their rows of right are small enough to broadcast at any size; the rest is a plain
    shuffle join, with no key over a thousandth of the rows.
    """
    hot = [r[0] for r in counts.where(F.col("__n") > F.lit(max(1, total // HOT_KEYS))).where(F.col(key).isNotNull()).select(key).limit(HOT_KEYS).collect()] if total > 20 * HOT_KEYS else []
    if not hot:
        return left.join(right, key, how)
    keys = left.sparkSession.createDataFrame([(k,) for k in hot], f"{key} {dict(left.dtypes)[key]}")
    small = right.join(F.broadcast(keys), key, "left_semi")
    cold = left.join(F.broadcast(keys), key, "left_anti").join(right, key, how)
    warm = left.join(F.broadcast(keys), key, "left_semi").join(F.broadcast(small), key, how)
    return cold.unionByName(warm.select(cold.columns))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame, total: int, spread: str) -> DataFrame:
    """left inner-joined to right on keys, where left may hold a third of its rows under one key.

    counts has keys and __n, left's rows of each key of right; total is left's rows. Keys over total / HOT_KEYS
    rows are few at any size, so they are broadcast: left's rows of them get one of several salts by the column
    `spread`, and right's rows of them are repeated for each salt, twice HOT_KEYS salts in all at most.
    """
    share = max(1, total // HOT_KEYS)
    hot = counts.where(F.col("__n") > share).select(*keys, F.ceil(F.col("__n") / share).cast("int").alias("__salts"))
    hot = F.broadcast(written(hot, "hot"))
    one = left.join(hot, keys, "left").withColumn("__salt", F.when(F.col("__salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.lit(3), spread), F.col("__salts")))).drop("__salts")
    two = right.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return one.withColumn("__salt", F.col("__salt").cast("int")).join(two, [*keys, "__salt"]).drop("__salt")
