"""Statistics expressions: correlation, its p-value, labels and number formats."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: pairwise-complete correlation, null for a constant input."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(r > 1, 1.0).when(r < -1, -1.0).otherwise(r)


def pair_count(x: Column, y: Column) -> Column:
    return F.count(F.when(x.isNotNull() & y.isNotNull(), 1))


def pearson_p_value(r: Column, n: Column, steps: int = 1000) -> Column:
    """Two-sided p of a correlation ``r`` over ``n`` pairs.

    With t = tan(a) * sqrt(n - 2) Student's t becomes a cos(a)^(n - 3) density, and
    sin(a) = r, so p is the mass from asin(|r|) to pi/2 over the mass from 0. Both
    integrals are Simpson sums over the stretch where the density is not negligible,
    which keeps them accurate for any n.
    """
    power = (n - 3).cast("double")
    width = F.lit(40.0) / F.sqrt(F.greatest(power, F.lit(1.0)))

    def mass(start: Column) -> Column:
        end = F.least(F.lit(math.pi / 2), start + width)
        h = (end - start) / (2 * steps)

        def term(i: Column) -> Column:
            weight = F.when((i == 0) | (i == 2 * steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
            c = F.greatest(F.cos(start + i * h), F.lit(1e-300))
            return weight * F.exp(power * F.ln(c))

        total = F.aggregate(F.sequence(F.lit(0), F.lit(2 * steps)), F.lit(0.0), lambda s, i: s + term(i))
        return total * h / 3

    p = F.try_divide(mass(F.asin(F.abs(r))), mass(F.lit(0.0)))
    return (
        F.when(r.isNull() | (n < 2), F.lit(None).cast("double"))
        .when(n == 2, F.lit(1.0))
        .when(F.abs(r) >= 1, F.lit(0.0))
        .otherwise(F.least(p, F.lit(1.0)))
    )


def significance(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def signed(x: Column) -> Column:
    """``+0.123``; a dash where there is nothing to show."""
    return F.coalesce(F.when(x.isNotNull(), F.format_string("%+.3f", x)), F.lit("—"))


def fixed3(x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string("%.3f", x))
