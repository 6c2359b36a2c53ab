"""Requests to worker stages: what is wrong with a request is a column, never a failed task.

A request is (request_id, command, payload), the payload JSON text. Handlers are column expressions over
the parsed payload, so a stage stays one projection, whatever it is asked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: From the payload's fields (a map of texts) to the answer.
Handler = Callable[[Column], Column]


def request_error(command: Column, fields: Column, needs: dict[str, tuple[str, ...]]) -> Column:
    """The first thing wrong with a request, or null. ``needs`` names the fields of each known command."""
    missing = F.lit(None).cast("string")
    for name, wanted in needs.items():
        for field in reversed(wanted):
            missing = F.when((command == name) & ~F.map_contains_key(fields, field), F.lit(f"KeyError: '{field}'")).otherwise(missing)
    known = F.coalesce(command.isin(*needs), F.lit(False))
    return F.when(~known, F.lit("ValueError: unknown command")).when(fields.isNull(), F.lit("ValueError: payload is not an object")).otherwise(missing)


def run_stage(requests: DataFrame, needs: dict[str, tuple[str, ...]], answers: dict[str, Handler]) -> DataFrame:
    """(request_id, status, error, and one column for each answer; null where the request is refused)."""
    read = requests.select("request_id", "command", F.from_json("payload", "map<string,string>").alias("fields"))
    judged = read.withColumn("error", request_error(F.col("command"), F.col("fields"), needs))
    fine = F.col("error").isNull()
    return judged.select(
        "request_id", F.when(fine, F.lit("ok")).otherwise(F.lit("error")).alias("status"), "error", *[F.when(fine, f(F.col("fields"))).alias(n) for n, f in answers.items()]
    )
