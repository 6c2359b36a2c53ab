"""Vector columns (ARRAY<DOUBLE>) and per-group vector means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxloom.functions.measure import clamp, finite, let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def unit(a: Column) -> Column:
    """Scale to length one; a zero vector is left alone."""
    return let(norm(a), lambda length: F.when(length > 0, F.transform(a, lambda x: x / length)).otherwise(a))


def all_finite(a: Column) -> Column:
    return F.coalesce((F.size(a) > 0) & F.forall(a, finite), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, NULL for empty, non-finite, zero or differently sized vectors."""
    usable = (
        all_finite(a) & all_finite(b) & (F.size(a) == F.size(b)) & (dot(a, a) > 1e-12) & (dot(b, b) > 1e-12)
    )
    return F.when(usable, clamp(dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)), -1.0, 1.0))


def group_vector_sum(df: DataFrame, keys: list[str], vector: str, weight: Column | None = None, out: str = "vector_sum") -> DataFrame:
    """Per-group weighted sum of vectors.

    One row per (group, dimension) is summed with map-side partial aggregation, so a group that
    holds a third of all rows never meets in one task; only ``dimension`` scalars per group do.
    """
    w = weight if weight is not None else F.lit(1.0)
    parts = df.select(*keys, w.alias("_w"), F.posexplode(vector).alias("_dim", "_x"))
    sums = parts.groupBy(*keys, "_dim").agg(F.sum(F.col("_x") * F.col("_w")).alias("_s"))
    return sums.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_dim", "_s"))), lambda x: x["_s"]
        ).alias(out)
    )
