"""Order-independent fingerprints of row sets.

A set's fingerprint is built from sums of its rows' SHA-256 digests (a multiset hash): it changes
when any row changes, appears, disappears or repeats, does not depend on input order, and is a plain
partial aggregate, so no group is ever collected or sorted in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, DoubleType, FloatType, MapType, StructType

_LANES, _HEX = 4, 15


def plain(value: Column, kind: DataType) -> Column:
    """Text of a value of any type, different for different values; NULL stays NULL.

    Real numbers are given in billionths where these fit a long, so that the last bits of a sum do not
    decide. Lists and structures become JSON lists of such texts; maps are ordered by key.
    """
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(F.abs(value) < 9e9, F.rint(value * 1e9).cast("long").cast("string")).otherwise(value.cast("string"))
    if isinstance(kind, ArrayType):
        return F.to_json(F.transform(value, lambda x: plain(x, kind.elementType)))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.to_json(F.array(*[plain(value[f.name], f.dataType) for f in kind])))
    if isinstance(kind, MapType):
        return F.to_json(F.array_sort(F.transform(
            F.map_entries(value), lambda e: F.to_json(F.array(plain(e["key"], kind.keyType), plain(e["value"], kind.valueType))))))
    return F.hex(value) if isinstance(kind, BinaryType) else value.cast("string")


def plain_columns(df: DataFrame, *names: str) -> list[Column]:
    """The named columns of ``df`` as text; without names, all of them in the order of their names."""
    return [plain(F.col(n), df.schema[n].dataType) for n in names or sorted(df.columns)]


def row_digest(*columns: Column) -> Column:
    """SHA-256 of the columns' text forms, each with its length, so that no two lists of values read
    alike; NULL and empty text stay different."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.lit("v"), F.length(t).cast("string"), F.lit(":"), t), F.lit("n")) for t in texts]
    return F.sha2(F.concat_ws("|", *parts), 256)


def set_fingerprint(df: DataFrame, keys: list[str], digest: Column, out: str = "fingerprint") -> DataFrame:
    """One fingerprint and row count per key."""
    lanes = [
        F.sum(F.conv(F.substring("_d", 1 + i * _HEX, _HEX), 16, 10).cast("decimal(20,0)")).alias(f"_l{i}") for i in range(_LANES)
    ]
    sums = df.select(*keys, digest.alias("_d")).groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), *lanes)
    text = F.concat_ws(":", F.col("row_count").cast("string"), *[F.col(f"_l{i}").cast("string") for i in range(_LANES)])
    return sums.select(*keys, "row_count", F.sha2(text, 256).alias(out))
