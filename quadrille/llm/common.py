"""What the training-data operators share: shared-folder tables, global ranks, ASCII folding."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.session import ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The white space that separates words here: space, and tab to carriage return.
SPACE = "\\x20\\x09-\\x0D"
#: Most rows that Spark hands to a Python worker at once.
ARROW_ROWS = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Make this session ready for Python stages: the package on executors, and Arrow batches of few rows, so that long
    texts don't meet in one batch."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where that is unset, a local session gets a temporary folder of its own; a cluster, whose machines don't share one,
    is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quadrille-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Paths of the tables written so far, innermost `scratch` last; the first list is of those that nothing clears by itself.
_written: list[list[str]] = [[]]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends there, any executor can reread it.

    The table stays until the `scratch` block around the call ends, or until `clear`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """Delete the tables that are materialized inside when the block ends, but for those handed to the function given.

    What a lazy result still reads has to be handed over; it then belongs to the block around this one.
    """
    kept: set[str] = set()
    _written.append([])
    try:
        yield lambda *tables: kept.update(t._written_at for t in tables if t is not None)
    finally:
        own = _written.pop()
        _written[-1] += [p for p in own if p in kept]
        _delete(spark, [p for p in own if p not in kept])


def clear(spark: SparkSession) -> None:
    """Delete every table that operators have left for their lazy results; those results can't be read any more."""
    _delete(spark, _written[0])
    _written[0].clear()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the fast path, where both foldings agree."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def crc_mod(id_: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def range_parts(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df dealt by ranges of `order` and written, with `_part`, the range's number.

    Written, because a second evaluation of the ranges could sample other borders.
    """
    return materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)


def global_rank(df: DataFrame, order: list[str], out: str, name: str = "rank") -> DataFrame:
    """Add `out`, the row's place from 0 in the whole order, without a one-task sort.

    The offsets table has one row a range, so it is broadcast whatever the input's size.
    """
    asc = [F.col(c).asc_nulls_last() for c in order]
    parts = range_parts(df, asc, name)
    sums = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("_part", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*asc)) - 1
    return parts.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_before") + place).drop("_part", "_before")
