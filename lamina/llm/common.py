"""What the operators of this subpackage share: durable intermediate tables, checked broadcasts, ASCII text rules.

Text rules used everywhere: white space is exactly space and \\t \\n \\v \\f \\r, and only A-Z are lower-cased.
"""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\x0c\r"
#: Largest number of (narrow) rows that an operator broadcasts; beyond it the same join shuffles.
BROADCAST_ROWS = 200_000
#: Rows in an Arrow batch sent to Python. Packed arrays of a few MB a row are further bounded by a task's share of a file.
ARROW_ROWS = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir; only a local master may go without one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lamina-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def save(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, and outlives any executor. The rows are
    counted on the way."""
    spark, seen = df.sparkSession, Observation()
    path = f"{shared_dir(spark)}/lamina-{label}-{uuid.uuid4().hex}"
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_rows = seen.get.get("rows")
    return out


def rows_of(table: DataFrame) -> int | None:
    """The rows of a table as ``save`` returned it; None for any other."""
    return table.__dict__.get("saved_rows")


def empty(table: DataFrame) -> bool:
    n = rows_of(table)
    return not table.head(1) if n is None else n == 0


def discard(table: DataFrame) -> None:
    """Delete the files of a saved table that nothing will read again."""
    jvm, conf = table.sparkSession._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for name in table.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, False)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch for this session, unless it has a smaller bound already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def fits(table: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a saved table has at most so many rows; reads no more than needed to tell."""
    n = rows_of(table)
    return n <= rows if n is not None else table.limit(rows + 1).count() <= rows


def checked(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The saved table, marked for broadcast only when counted small; otherwise its join shuffles."""
    return F.broadcast(table) if fits(table, rows) else table.hint("merge")


def salted_join(rows: DataFrame, table: DataFrame, on: list[str], by: str, counts: DataFrame | None = None, each: int = 2_000, narrow: bool = True) -> DataFrame:
    """Rows joined with a table whose keys ``on`` are unique, with hot keys dealt out: a key of many rows (as ``counts``,
    with a column size, tells) has a copy of its table row for every ``each`` rows, and rows go to a copy by a hash of
    ``by``. So no key of any share of the rows meets in one task. Small tables of ``narrow`` rows are broadcast, after counting them."""
    if narrow and fits(table, 20_000):
        return rows.join(F.broadcast(table), on)
    counts = rows.groupBy(*on).agg(F.count("*").alias("size")) if counts is None else counts
    hot = save(counts.where(F.col("size") > each).select(*on, F.ceil(F.col("size") / each).alias("__copies")), "hot")
    if empty(hot):
        return rows.join(table.hint("merge"), on)
    copies = F.coalesce("__copies", F.lit(1).cast("long"))
    dealt = rows.join(checked(hot), on, "left").withColumn("__copy", F.pmod(F.xxhash64(by), copies)).drop("__copies")
    copied = table.join(checked(hot), on, "left").withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("__copies")
    return dealt.join(copied.hint("merge"), [*on, "__copy"]).drop("__copy")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Lower-cased words; null and blank texts give an empty array."""
    clean = F.btrim(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(SPACE))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, r"[ \t\n\x0b\f\r]+"))


def row_key(*cols: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a row, null-safe, for joins back to rows whose id may be null or repeated."""
    return [F.xxhash64(F.lit(i), *cols) for i in (1, 2)]


def parts_for(rows: int, each: int) -> int:
    return max(1, math.ceil(rows / each))


def trim() -> None:
    """Give freed memory of a Python worker back to the system, where the C library can; blocks of work call it at
    their end, as workers live on and the JVM beside them needs the room."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: arrays get pages of their own
        libc.malloc_trim(0)
