"""Array mathematics as columns, linear in the arrays' lengths.

Spark inlines a column into a lambda that names it and then computes it once per element.
So what a lambda needs besides its element (a mean, a deviation, a norm) is always bound by
let() first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import NORM_FLOOR, SIGMA_FLOOR


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(a: Column | str) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column | str) -> Column:
    return F.try_divide(total(a), F.size(a).cast("double"))


def std_pop(a: Column | str, mu: Column | None = None) -> Column:
    """Population standard deviation; mu if the mean is known already."""

    def of(m: Column) -> Column:
        squares = F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m))
        return F.sqrt(F.try_divide(squares, F.size(a).cast("double")))

    return let(mean(a) if mu is None else mu, of)


def floored(sigma: Column) -> Column:
    """A deviation of next to nothing counts as 1, so that a constant series becomes zeros."""
    return F.when(sigma < SIGMA_FLOOR, F.lit(1.0)).otherwise(sigma)


def moments(a: Column | str) -> Column:
    """A struct of mu, sigma (floored) and z, the array with both taken out."""

    def of(m: Column) -> Column:
        return let(F.struct(m.alias("mu"), floored(std_pop(a, m)).alias("sigma")), lambda p: F.struct(p["mu"].alias("mu"), p["sigma"].alias("sigma"), F.transform(a, lambda x: (x - p["mu"]) / p["sigma"]).alias("z")))

    return let(mean(a), of)


def zscore(a: Column | str, mu: Column, sigma: Column) -> Column:
    return let(F.struct(mu.alias("mu"), sigma.alias("sigma")), lambda p: F.transform(a, lambda x: (x - p["mu"]) / p["sigma"]))


def unzscore(a: Column | str, mu: Column, sigma: Column) -> Column:
    return let(F.struct(mu.alias("mu"), sigma.alias("sigma")), lambda p: F.transform(a, lambda x: x * p["sigma"] + p["mu"]))


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def l2(a: Column | str) -> Column:
    """The unit vector, or zeros for a vector of next to no length."""
    return let(norm(a), lambda n: F.transform(a, lambda x: F.when(n > NORM_FLOOR, x / n).otherwise(0.0)))


def fit_length(a: Column | str, n: int) -> Column:
    """Shorter arrays get zeros at the head, longer ones keep their tail."""
    a = F.col(a) if isinstance(a, str) else a
    padded = F.concat(F.array_repeat(F.lit(0.0), F.lit(n) - F.size(a)), a)
    return F.when(F.size(a) < n, padded).otherwise(F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n))


def pearson(a: Column | str, b: Column | str) -> Column:
    """Correlation over the common length; 0 if either is empty, constant or not a number."""
    n = F.least(F.size(a), F.size(b))
    both = F.struct(F.slice(a, F.lit(1), F.greatest(n, F.lit(0))).alias("x"), F.slice(b, F.lit(1), F.greatest(n, F.lit(0))).alias("y"))

    def step(s: Column, d: Column) -> Column:
        return F.struct((s["xy"] + d["x"] * d["y"]).alias("xy"), (s["xx"] + d["x"] * d["x"]).alias("xx"), (s["yy"] + d["y"] * d["y"]).alias("yy"))

    def of(p: Column) -> Column:
        def around(m: Column) -> Column:
            away = F.zip_with(p["x"], p["y"], lambda x, y: F.struct((x - m["x"]).alias("x"), (y - m["y"]).alias("y")))
            zero = F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy"))
            return F.aggregate(away, zero, step, ratio)

        def ratio(s: Column) -> Column:
            k = F.size(p["x"]).cast("double")
            flat = (F.sqrt(F.try_divide(s["xx"], k)) < SIGMA_FLOOR) | (F.sqrt(F.try_divide(s["yy"], k)) < SIGMA_FLOOR)
            r = F.try_divide(s["xy"], F.sqrt(s["xx"]) * F.sqrt(s["yy"]))
            return F.when(~flat & ~F.isnan(r), r)

        return let(F.struct(mean(p["x"]).alias("x"), mean(p["y"]).alias("y")), around)

    return F.coalesce(let(both, of), F.lit(0.0))


def as_list(a: Column) -> Column:
    """An array in place of a null."""
    return F.coalesce(a, F.array().cast("array<double>"))
