"""Writing data sets once, and reading back what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxloom.functions.fingerprints import plain_columns, row_digest, set_fingerprint

#: What keeps a table as it is through text files.
_OPTIONS = {"csv": {"header": True, "quoteAll": True, "nullValue": "\\N", "emptyValue": "", "compression": "gzip", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}, "json": {"ignoreNullFields": False, "compression": "gzip"}}

#: Rows of one file at most, so that a file can be hashed whole.
_ROWS = 1_000_000


def dealt(df: DataFrame, by: str, *key: str) -> DataFrame:
    """Rows dealt by ``by`` and a hash of ``key``, so a job with a third of all rows is written by many tasks."""
    return df.repartition(F.col(by), F.pmod(F.xxhash64(*key), F.lit(16)))


def publish(df: DataFrame, folder: str, by: str, form: str = "parquet", deal: bool = True) -> DataFrame:
    """Write ``df`` below ``folder``, one subfolder for each value of ``by``, and read it back.

    An existing folder is refused by the writer, so nothing is overwritten or mixed. Rows are dealt by
    :func:`dealt` before, or the caller did so (``deal`` false) while they were still small. Text forms are
    packed by gzip.
    """
    if form not in ("parquet", "csv", "json"):
        raise ValueError(f"unknown form {form}")
    options = _OPTIONS.get(form, {})
    rows = dealt(df, by, *[c for c, kind in df.dtypes if not kind.startswith("map")]) if deal else df
    options = options | {"maxRecordsPerFile": _ROWS}
    rows.write.mode("errorifexists").partitionBy(by).format(form).options(**options).save(folder)
    rest = [f for f in df.schema if f.name != by]
    return df.sparkSession.read.schema(type(df.schema)([*rest, df.schema[by]])).format(form).options(**options).load(folder).select(*df.columns)


def differences(written: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of rows that were lost, added or changed between ``wanted`` and ``written``; equal rows cancel out."""
    marked = wanted.withColumn("_side", F.lit(1)).unionByName(written.withColumn("_side", F.lit(-1)))
    return marked.groupBy(*wanted.columns).agg(F.sum("_side").alias("_left")).where("_left <> 0").select(*keys).distinct()


def _folder_value(path: Column, by: str) -> Column:
    """The value of ``by`` that the writer put into a path, with its escapes undone."""
    raw = F.regexp_extract(path, f"/{by}=([^/]*)/[^/]*$", 1)
    return F.when(raw != "__HIVE_DEFAULT_PARTITION__", F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))))


def written_files(spark: SparkSession, folder: str, by: str) -> DataFrame:
    """(by, file, bytes, sha256) of every data file below a published folder, from its bytes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(folder)
    return raw.select(
        _folder_value(F.col("path"), by).alias(by), F.substring_index("path", "/", -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _file_prints(files: DataFrame, by: str) -> DataFrame:
    total = files.groupBy(by).agg(F.sum("bytes").alias("bytes"))
    prints = set_fingerprint(files, [by], row_digest(*plain_columns(files, "file", "bytes", "sha256")), "files_hash").withColumnRenamed("row_count", "files")
    return prints.join(total.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by"))).drop("_by")


def record_provenance(accepted: DataFrame, held: DataFrame, folder: str, by: str, dataset_fingerprint: str) -> DataFrame:
    """Write beside the published ``accepted`` rows where they come from, and read it back.

    One row per job: how many items were accepted and held, a hash of the accepted names and weights, the
    fingerprint of the data set, and files, bytes and hash of what was written. A job whose items were all
    held has a row with status ``none_accepted``, not a missing file. Only files of more than
    ``_ROWS`` rows are split, so each is hashed in one task; hashes travel, not contents.
    """
    both = accepted.select(F.col(by), F.lit(True).alias("_in")).unionByName(held.select(F.col(by), F.lit(False).alias("_in")))
    made = both.groupBy(by).agg(F.count_if("_in").alias("accepted"), F.count_if(~F.col("_in")).alias("held"))
    made = made.withColumn("status", F.when(F.col("accepted") > 0, "written").otherwise("none_accepted")).withColumn("dataset_fingerprint", F.lit(dataset_fingerprint))
    weights = set_fingerprint(accepted, [by], row_digest(*plain_columns(accepted, "name", "training_weight")), "weights_hash").drop("row_count")
    for more in (weights, _file_prints(written_files(accepted.sparkSession, folder, by), by)):
        made = made.join(more.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
    made = made.na.fill(0, ["files", "bytes"])
    made.write.mode("errorifexists").parquet(f"{folder}/_provenance")
    return accepted.sparkSession.read.parquet(f"{folder}/_provenance")


def provenance_problems(spark: SparkSession, folder: str, by: str) -> DataFrame:
    """Jobs whose files are not the ones that their provenance records: lost, added or changed."""
    told = spark.read.parquet(f"{folder}/_provenance").where("status = 'written'").select(F.col(by).alias("_told_by"), F.col("files_hash").alias("_told"))
    now = _file_prints(written_files(spark, folder, by), by)
    both = now.join(told, F.col(by).eqNullSafe(F.col("_told_by")), "full")
    problem = F.when(F.col("files_hash").isNull(), "files_missing").when(F.col("_told").isNull(), "files_unrecorded").when(F.col("files_hash") != F.col("_told"), "files_differ")
    return both.select(F.coalesce(by, "_told_by").alias(by), problem.alias("problem")).where("problem IS NOT NULL")
