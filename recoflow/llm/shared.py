"""Hand-offs between the jobs of an operator: tables in the shared folder of the cluster."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recoflow.session import scratch_path

#: Stands for a null doc_id: sorts before every other.
NULL_ID = -(2**63)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder (``spark.checkpoint.dir``): computed once, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def spent(*tables: DataFrame) -> None:
    """Removes written tables from which nothing is computed any more: whatever was made of them is itself written."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the tables written inside: a batch is held by the JVM and by Python. The session's own number comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(min(int(was), rows) if int(was) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, was)


#: Rows of a few numbers that may be sent to all executors (some 50 MB).
FEW_ROWS = 1 << 21


def few(keys: DataFrame, rows: int):
    """A narrow table of ``rows`` rows: sent to the other side of a join if it has at most FEW_ROWS, else joined by a shuffle."""
    return F.broadcast(keys) if rows <= FEW_ROWS else keys


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def key_columns(id_col: str, text_col: str) -> list:
    """ord and tk: ord orders the documents (null first), tk (64 bits) tells apart rows that share an id but not a text."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("ord"),
            F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tk")]


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(ord, tk, text) of each row; null text is empty."""
    return docs.select(*key_columns(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def in_order(df: DataFrame, *order) -> DataFrame:
    """The rows in ranges of ``order``, sorted in each partition. A row number breaks ties, so equal rows may lie in several partitions."""
    salted = df.withColumn("_tie", F.monotonically_increasing_id())
    return salted.repartitionByRange(shuffle_partitions(df.sparkSession), *order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")


#: Bits of a row's place in its partition in monotonically_increasing_id.
PLACE_BITS = 33


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """A written table of the rows with ``nth``, their place in the order (from 1): offsets of partitions, no window over all rows."""
    table = written(in_order(df, *order).withColumn("_place", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_place", PLACE_BITS)
    counts = sorted((r.p, r.n) for r in table.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row a partition
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, "_part long, _before long")
    nth = F.col("_before") + F.col("_place") - F.shiftleft("_part", PLACE_BITS) + 1
    return table.withColumn("_part", part).join(F.broadcast(offsets), "_part").select(*df.columns, nth.alias(name))
