"""Column helpers for measurements: a value never stands in for an unknown one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxloom.functions.vocabulary import FORCED_ALIGNMENT, PLACEHOLDER_ALIGNMENT


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A lambda that mentions an outer array would evaluate that array again for every element
    whenever the optimizer inlines its definition; a bound lambda variable is evaluated once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def finite(value: Column) -> Column:
    """True only for a real number: not NULL, not NaN, not infinite."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.lit(False))


def in_unit(value: Column) -> Column:
    return F.coalesce((value >= 0) & (value <= 1), F.lit(False))  # NaN is above every number here


def timed(start: Column, end: Column) -> Column:
    """True only for finite times from zero on with the end after the start.

    NaN is above every number, so an end that is below infinity and after the start excludes NaN and
    infinity on both sides. Three comparisons, because this runs once for each phone.
    """
    return F.coalesce((start >= 0) & (end > start) & (end < F.lit(float("inf"))), F.lit(False))


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def exact_mean(value: Column) -> Column:
    """Aggregate: the mean of numbers, whatever their order, from a sum without rounding.

    A sum of doubles depends in its last bits on the order and the partial sums, and a fingerprint of what is
    made of it then depends on the partitions. Numbers below 256 are summed as whole multiples of 2^-54; with a
    larger one, NaN or infinity in the group it is the plain mean.
    """
    whole = F.rint(value * F.lit(2.0**54)).try_cast("bigint").cast("decimal(20,0)")
    fits = F.abs(value) < F.lit(256.0)  # NaN is above every number
    total = F.sum(F.when(fits, whole)).cast("double")
    return F.when(F.coalesce(F.bool_and(fits), F.lit(True)), total / F.count(value) / F.lit(2.0**54)).otherwise(F.avg(value))


def blank(text: Column) -> Column:
    """NULL, or nothing but blanks of any script."""
    return F.coalesce(~text.rlike(r"(?U)\S"), F.lit(True))


def log_place(log: DataFrame) -> Column:
    """Place of an entry in its log: its time and, among equal times, ``seq`` where the log has one."""
    return F.struct("changed_at", *[c for c in ("seq",) if c in log.columns])


def reasons(*pairs: tuple[Column, str]) -> Column:
    """Ordered array of the codes whose condition holds."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(code)) for condition, code in pairs]))


def low_rank(n: Column, q: float) -> Column:
    """1-based rank of the low order statistic max(0, int(n*q) - 1)."""
    return F.greatest(F.lit(1).cast("long"), F.floor(n * F.lit(q)))


def high_rank(n: Column, q: float) -> Column:
    """1-based rank of the high order statistic min(n - 1, int(n*q))."""
    return F.least(n.cast("long"), F.floor(n * F.lit(q)) + 1)


def asr_measured(value: str = "asr_confidence", status: str = "asr_status") -> Column:
    """Is the recognition confidence a real measurement? Legacy zeros are unknown."""
    s = F.col(status)
    return (
        F.when(s == "measured", True)
        .when(s.isin("uncalibrated", "unavailable", "invalid"), False)
        .otherwise(F.coalesce(F.col(value) > 0, F.lit(False)))
    )


def alignment_measured(
    value: str = "alignment_confidence", status: str = "alignment_status", method: str = "alignment_method"
) -> Column:
    """Is the alignment confidence a real measurement? A forced aligner's legacy zero is unknown."""
    s = F.col(status)
    return (
        F.when(s == "measured", True)
        .when(s.isin("uncalibrated", "unavailable", "invalid"), False)
        .otherwise(~F.coalesce((F.col(method) == FORCED_ALIGNMENT) & (F.col(value) == 0), F.lit(False)))
    )


def measurement(measured: Column, value: Column, status: Column) -> Column:
    """(value, status) of a quality component; out-of-range measured values become invalid."""
    good = in_unit(value)
    return F.struct(
        F.when(measured & good, value).alias("value"),
        F.when(measured & good, F.lit("measured")).when(measured, F.lit("invalid")).otherwise(status).alias("status"),
    )


def legacy_measurement(value: Column, status: Column) -> Column:
    """Import a stored confidence by its recorded status only."""
    good = in_unit(value)
    known = F.coalesce(status, F.lit("legacy_unknown"))
    return F.struct(
        F.when(known.isin("unavailable", "invalid") | ~good, F.lit(None).cast("double")).otherwise(value).alias("value"),
        F.when(known == "measured", F.when(good, "measured").otherwise("invalid"))
        .when(known.isin("uncalibrated", "unavailable", "invalid"), known)
        .otherwise("legacy_unknown")
        .alias("status"),
    )


def placeholder_alignment(method: str = "alignment_method") -> Column:
    return F.coalesce(F.col(method) == PLACEHOLDER_ALIGNMENT, F.lit(False))


def valid_singing_alignment(phones: str = "phonemes", well_timed: Column | None = None) -> Column:
    """Forced, in-range, ordered and non-overlapping phones: the alignment singing data needs.

    ``well_timed`` is what ``phone_arrays.well_timed`` found, where phones were looked at as arrays.
    """
    def good(x: Column) -> Column:
        return timed(x["start_sec"], x["end_sec"]) & in_unit(x["confidence"])

    def rule(p: Column) -> Column:
        later = F.zip_with(p, F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda x, y: y.isNull() | (y["start_sec"] >= x["end_sec"] - F.lit(1e-6)))
        spelled = F.forall(F.array_distinct(F.transform(p, lambda x: x["phoneme"])), lambda x: ~blank(x))  # each spelling once
        return (F.size(p) > 0) & F.forall(p, good) & spelled & F.forall(later, lambda ok: ok)

    return F.coalesce(
        F.col("has_measurement") & (F.col("alignment_method") == FORCED_ALIGNMENT)
        & in_unit(F.col("alignment_confidence")) & (let(F.col(phones), rule) if well_timed is None else well_timed),
        F.lit(False),
    )
