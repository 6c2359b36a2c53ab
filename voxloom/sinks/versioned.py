"""Saves that hold only on the revision they were made from.

Each dataset has a current revision. A save names the revision it was read at; a join decides which
saves still hold, and of several in one batch the first wins. What is accepted is written once, an
ordinary Parquet table partitioned by the new revision; the rest come back as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxloom.sinks.files import publish


def judge_saves(saves: DataFrame, current: DataFrame) -> DataFrame:
    """``saves`` (dataset_id, expected, place, ...) with ``outcome`` and the new ``revision``.

    ``current`` has one row a dataset: dataset_id, revision. A new dataset has none and is saved under
    ``expected`` null. Of saves on the right revision the smallest ``place`` is accepted, the others are
    as stale as those on another revision. A dataset may get any number of saves: the first is found by
    a partial aggregate, not by a window.
    """
    now = current.select("dataset_id", F.col("revision").alias("_now"))
    joined = saves.join(now, "dataset_id", "left").withColumn("_fits", F.col("expected").eqNullSafe(F.col("_now")))
    first = joined.where("_fits").groupBy("dataset_id").agg(F.min("place").alias("_first"))
    won: Column = F.coalesce(F.col("_fits") & (F.col("place") == F.col("_first")), F.lit(False))
    return joined.join(first, "dataset_id", "left").select(
        *saves.columns, F.when(won, F.lit("saved")).otherwise(F.lit("stale")).alias("outcome"), F.when(won, F.coalesce("_now", F.lit(0).cast("long")) + 1).alias("revision"),
    )


def save_all(judged: DataFrame, folder: str) -> DataFrame:
    """Write the accepted saves, one folder a revision, and read them back; refuses a folder that exists."""
    return publish(judged.where("outcome = 'saved'").drop("outcome"), folder, "revision")


def advance(current: DataFrame, saved: DataFrame) -> DataFrame:
    """The revisions after the saves: one row a dataset."""
    both = current.select("dataset_id", "revision").unionByName(saved.select("dataset_id", "revision"))
    return both.groupBy("dataset_id").agg(F.max("revision").alias("revision"))


def latest_rows(history: DataFrame) -> DataFrame:
    """Of everything saved, the rows of each dataset's last revision."""
    newest = Window.partitionBy("dataset_id").orderBy(F.desc("revision"))
    return history.withColumn("_n", F.rank().over(newest)).where("_n = 1").drop("_n")
