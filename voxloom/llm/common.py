"""What the operators of this subpackage share: word rules, stored tables, names that cannot clash."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The blanks between words (Java and Python regular expressions agree on this class).
BLANK = r"\x20\x09-\x0D"


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a whole text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{BLANK}]+", -1), "")


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share. Only a local session may do without the setting."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, buckets: tuple[int, str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again.

    Cuts lineage, survives lost executors, and gives later joins a size that Spark knows. With
    ``buckets`` (number, column) later joins on that column leave the table where it is.
    """
    spark = df.sparkSession
    name = f"llm_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    writer = df.write.option("compression", "zstd")
    if buckets is None:
        writer.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    writer.option("path", path).format("parquet").bucketBy(*buckets).saveAsTable(name)
    return spark.table(name)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII texts take the short way."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def unit(*parts: Column) -> Column:
    """A uniform number in [0, 1) from a hash of the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0**-53)
