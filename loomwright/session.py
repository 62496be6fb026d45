"""Session helpers: reading tables, cutting lineage, checking sizes before a broadcast."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python workers need it for the Arrow steps; once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="loomwright-")) / "loomwright.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named in spark.checkpoint.dir.

    Where none is set, a local master (tests, a laptop) gets a temporary folder of this machine;
    on a cluster that would be a folder other machines can't read, so it is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = Path(tempfile.mkdtemp(prefix="loomwright-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder and read again: lineage ends here.

    Columnar and compressed, so it takes less disk than checkpointed rows, later steps read only the
    columns they need, and the optimiser knows its size. The table goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def drop_cuts(spark: SparkSession) -> None:
    """Remove the tables `cut` has written for this application: for long sessions, once the results that read them are written."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes (of the rows in memory) a side may have to be broadcast; beyond it the join is left to Catalyst.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df (a table that `cut` has written) with a broadcast hint if its rows take at most max_bytes, else df as it is.

    The size is measured, never assumed: the lengths of all strings and arrays are summed in one scan of the written table.
    """
    return F.broadcast(df) if measured(df)[0] <= max_bytes else df


def measured(df: DataFrame) -> tuple[int, int]:
    """About the bytes that the rows of df take in memory, and the largest of them."""
    width = reduce(lambda a, b: a + b, [_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields], F.lit(16))
    total, most = df.agg(F.sum(width), F.max(width)).first()
    return total or 0, most or 0


def written_once(df: DataFrame, column: str) -> DataFrame:
    """df (a table that `cut` has written) as it is; a Parquet file of this session then holds each of its texts once, however many rows have it.

    A writer leaves its dictionary for plain texts in every row once the dictionary is full, at 1 MB unless the session says
    more: so it says what these texts take, or, of more than BROADCAST_BYTES, two of the longest. Files are written after a
    query has returned, so the session keeps it. A dictionary takes memory only for what it holds. Smallest and largest values
    of the column are not kept: comparing long texts takes most of the time, and Parquet drops those above 4 kB.
    """
    spark = df.sparkSession
    total, most = measured(df)
    room = min(max(min(total, BROADCAST_BYTES), 2 * most), (1 << 31) - 1)
    if room > int(spark.conf.get("parquet.dictionary.page.size", None) or 1 << 20):
        spark.conf.set("parquet.dictionary.page.size", str(room))
    if most > 4096:
        spark.conf.set(f"parquet.column.statistics.enabled#{column}", "false")
    return df


def _bytes(c: Column, kind: T.DataType) -> Column:
    """About the bytes a value takes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
            return F.coalesce(F.aggregate(c, F.lit(16).cast("long"), lambda a, x: a + _bytes(x, kind.elementType)), F.lit(0))
        return F.coalesce(F.size(c), F.lit(0)) * 8 + 16
    if isinstance(kind, T.StructType):
        return reduce(lambda a, b: a + b, [_bytes(c[f.name], f.dataType) for f in kind.fields], F.lit(16))
    return F.lit(8)


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """df over all cores, by the columns if given: for Python steps behind a shuffle.

    Adaptive execution merges small shuffle partitions by bytes; that is right for the JVM, but
    leaves slow Python work of few bytes on one core. A stated number of partitions is kept.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *columns)


def widen(df: DataFrame) -> DataFrame:
    """A scan over all cores for Python work: shuffled only where the files give fewer than half as many partitions.

    A large table has more partitions than cores and passes as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores / 2 else df
