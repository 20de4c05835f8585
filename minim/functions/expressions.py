"""Scalar formulas shared by the operators, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTROPY_GAIN_MIN = 1e-12


def privacy_ratio(k: Column, k0: Column) -> Column:
    """`ln K0 - ln K`; NULL unless both are positive."""
    return F.when((k > 0) & (k0 > 0), F.log(k0) - F.log(k))


def privacy_cost(current_k: Column, next_k: Column) -> Column:
    """`ln(max(k - k_next, 2))`."""
    return F.log(F.greatest(current_k - next_k, F.lit(2)).cast("double"))


def candidate_score(
    gain: Column, current_k: Column, next_k: Column, policy: str = "ratio",
    influence: Column | None = None,
) -> Column:
    """Score of a candidate under a named policy.

    `ratio` = gain / cost, `privacy` = 1 / cost, `utility` = gain, `influence` = influence / cost.
    """
    cost = privacy_cost(current_k, next_k)
    if policy == "ratio":
        return gain / cost
    if policy == "privacy":
        return F.lit(1.0) / cost
    if policy == "utility":
        return gain
    if policy == "influence":
        if influence is None:
            raise ValueError("the influence policy needs an influence column")
        return influence / cost
    raise ValueError(f"unknown score policy {policy!r}")


def privacy_progress(k: Column, k_next: Column, n_min: Column, n_min_next: Column) -> Column:
    """Gain in min-K, or the relative fall in the number of classes at min-K when K stays."""
    return (
        F.when(k_next > k, (k_next - k).cast("double"))
        .when((k_next == k) & (n_min > 0), (n_min - n_min_next) / n_min.cast("double"))
    )


def utility_cost(loss_delta: Column, tolerance: float, epsilon: float) -> Column:
    """`max(loss_delta / max(tolerance, eps), eps)`; NULL when the delta is not finite."""
    scale = max(float(tolerance), float(epsilon))
    finite = loss_delta.isNotNull() & ~F.isnan(loss_delta) & (F.abs(loss_delta) < F.lit(float("inf")))
    return F.when(finite, F.greatest(loss_delta / F.lit(scale), F.lit(float(epsilon))))


def weighted_entropy(counts: Sequence[Column]) -> Column:
    """`n * H(counts)` in bits, i.e. `n log2 n - sum c log2 c`, with `0 log 0 = 0`."""
    def xlogx(c: Column) -> Column:
        return F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    total = counts[0]
    inner = xlogx(counts[0])
    for c in counts[1:]:
        total = total + c
        inner = inner + xlogx(c)
    return xlogx(total) - inner
