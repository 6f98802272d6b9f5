"""Statistics as column arithmetic."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the normal quantile of a 95 % interval.
Z = 1.959963984540054
# The rules of the verdict.
SOURCE_RATE, PARSE_FAILURES, PASS_CI, PASS_RATE, FAIL_DIFF, MOST_SPREAD, VETO_RATE, LEAST_DOMAINS, LEAST_KAPPA = 0.90, 0.05, 0.10, 0.25, 0.25, 0.20, 0.10, 3, 0.6


def wilson(k: Column, n: Column, z: float = Z) -> dict[str, Column]:
    """rate, low and high of k in n; (0, 0, 1) without trials."""
    k, n = k.cast("double"), n.cast("double")
    p = k / F.nullif(n, F.lit(0.0))
    d = 1 + z * z / F.nullif(n, F.lit(0.0))
    mid = (p + z * z / (2 * F.nullif(n, F.lit(0.0)))) / d
    half = z * F.sqrt(p * (1 - p) / F.nullif(n, F.lit(0.0)) + z * z / (4 * F.nullif(n * n, F.lit(0.0)))) / d
    return {
        "rate": F.coalesce(p, F.lit(0.0)),
        "low": F.coalesce(F.greatest(F.lit(0.0), mid - half), F.lit(0.0)),
        "high": F.coalesce(F.least(F.lit(1.0), mid + half), F.lit(1.0)),
    }


def kappa(observed: Column, expected: Column) -> Column:
    """Cohen's kappa; NaN where chance agreement is complete."""
    return F.when(expected >= 1, F.lit(float("nan"))).otherwise((observed - expected) / F.nullif(1 - expected, F.lit(0.0)))


def upper_median(values: Column) -> Column:
    """The element at half the size of the sorted array."""
    s = F.sort_array(values)
    return F.when(F.size(s) > 0, F.element_at(s, F.floor(F.size(s) / 2).cast("int") + 1))


def sum_or_null(x: Column) -> Column:
    """The sum, or null if any value is unknown."""
    return F.when(F.count("*") == F.count(x), F.sum(x))


def f1(a: Column, b: Column) -> Column:
    """F1 of two sets; 1 if both are empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(2.0 * both / F.nullif(F.size(a) + F.size(b), F.lit(0)))


def retention(before: Column, after: Column) -> Column:
    """The share of a set's elements that another has; 0 for an empty set."""
    before = F.array_distinct(before)
    return F.coalesce(F.size(F.array_intersect(before, after)) / F.nullif(F.size(before), F.lit(0)), F.lit(0.0))


def relative_agreement(before: Column, after: Column) -> Column:
    """The mean of 1 less the relative error of each counter, an error being 1 at most and counters from 0 counting as from 1.

    Counters that are 0 on both sides don't count; 0 without any other. Each error is rounded to three places, halves up, and so is the mean.
    """
    pairs = F.filter(F.arrays_zip(before.alias("a"), after.alias("b")), lambda p: (p["a"] != 0) | (p["b"] != 0))
    per = F.transform(pairs, lambda p: F.round(1 - F.least(F.lit(1.0), F.abs(p["b"] - p["a"]) / F.greatest(p["a"], F.lit(1))), 3))
    return F.when(F.size(pairs) == 0, 0.0).otherwise(F.round(F.aggregate(per, F.lit(0.0), lambda s, x: s + x) / F.size(pairs), 3))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    """Great-circle distance in km."""
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * radius * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def local_magnitude(amplitude: Column, km: Column) -> Column:
    """A local magnitude: log amplitude and a correction for distance. No amplitude counts as 1e-9, no distance as 1 km."""
    positive = lambda x, least: F.when(x > 0, x).otherwise(F.lit(least))
    return F.log10(positive(amplitude, 1e-9)) + 3 * F.log10(positive(km, 1.0)) - 2.92


def gate(source_rate: Column, failures: Column) -> Column:
    """Whether a run is valid; without a source arm it isn't evaluated."""
    return F.when(source_rate.isNull(), "NOT EVALUATED").when((source_rate >= SOURCE_RATE) & (failures <= PARSE_FAILURES), "VALID").otherwise("INVALID")


def verdict(gate_: Column, domains: Column, spread: Column, blind: Column, veto: Column, high: Column, low: Column, rate: Column, diff: Column) -> Column:
    """The verdict of an arm, in the order of precedence of the rules."""
    return (
        F.when(gate_ != "VALID", "NO VERDICT")
        .when(domains < LEAST_DOMAINS, "INCONCLUSIVE")
        .when(veto >= VETO_RATE, "FAIL")
        .when(~blind, "NOT COMPUTABLE")
        .when(spread > MOST_SPREAD, "INCONCLUSIVE")
        .when((high <= PASS_CI) & (rate <= PASS_RATE), "PASS")
        .when((diff >= FAIL_DIFF) & (low > 0), "FAIL")
        .otherwise("INCONCLUSIVE")
    )


def days_since(day: Column, as_of: Column) -> Column:
    """Whole days from a date spelled YYYY-MM-DD to `as_of`; 0 for anything else."""
    right = day.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z")
    return F.coalesce(F.datediff(as_of, F.when(right, F.try_to_date(day, "yyyy-MM-dd"))), F.lit(0)).cast("long")


def remaining_life(hours: Column, cycles: Column, days: Column, most_hours: Column, most_cycles: Column, most_days: Column) -> Column:
    """struct(hours, cycles, days, governing_unit): what is left of each limit, and the unit of which the largest share is used, the first of equals.

    Units can't be compared, so their shares are. A limit that is null or not positive counts for nothing.
    """
    units = (("HOURS", hours.cast("double"), most_hours.cast("double")), ("CYCLES", cycles.cast("long"), most_cycles.cast("long")), ("CALENDAR_DAYS", days.cast("long"), most_days.cast("long")))
    shares = F.array(*[F.when(most > 0, F.struct((used / most).alias("share"), F.lit(-i).alias("first"), F.lit(name).alias("unit"))) for i, (name, used, most) in enumerate(units)])
    left = [F.when(most > 0, most - used) for _, used, most in units]
    return F.struct(left[0].alias("hours"), left[1].alias("cycles"), left[2].alias("days"), F.array_max(F.filter(shares, lambda x: x.isNotNull()))["unit"].alias("governing_unit"))


def hmac_sha256(key: bytes, text: Column) -> Column:
    """The HMAC of a text's UTF-8 under a key, in lowercase hex."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ x for b in key)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))), 256)
