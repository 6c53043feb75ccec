"""Similarities of sets, multisets and perceptual hashes as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; two empty sets are the same."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def multiset_similarity(a: Column, b: Column) -> Column:
    """Sum of smaller over sum of larger counts of two count maps; 1 for two empty ones."""
    pairs = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.struct(F.coalesce(x, F.lit(0)).alias("x"), F.coalesce(y, F.lit(0)).alias("y"))))
    total = lambda pick: F.aggregate(pairs, F.lit(0).cast("bigint"), lambda acc, p: acc + pick(p["x"], p["y"]))
    most = total(F.greatest)
    return F.when(most == 0, F.lit(1.0)).otherwise(total(F.least) / most)


def sibling_proximity(a: Column, b: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.abs(a - b))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes held as signed longs."""
    return F.bit_count(a.bitwiseXOR(b))


def visual_similarity(a: Column, b: Column) -> Column:
    return F.lit(1.0) - hamming(a, b) / F.lit(64.0)


def signed_hash(text: Column) -> Column:
    """An unsigned 64-bit number written as decimal text, as a signed long; null if it is none."""
    n = text.try_cast("decimal(20,0)")
    half, full = F.lit("9223372036854775808").cast("decimal(20,0)"), F.lit("18446744073709551616").cast("decimal(21,0)")
    return F.when((n >= 0) & (n < full), F.when(n >= half, (n - full).cast("bigint")).otherwise(n.cast("bigint")))


def added(before: Column, after: Column) -> Column:
    """Items of ``after`` that are not in ``before``, in order, each once."""
    return F.array_distinct(F.filter(after, lambda x: ~F.coalesce(F.array_contains(before, x), F.lit(False))))
