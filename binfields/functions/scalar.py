"""Column expressions: bins, windows, categories, texts, and the normal and hypergeometric tails that Spark SQL lacks."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip_range(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Null stays null."""
    out = x if low is None else F.when(x < low, F.lit(low)).otherwise(x)
    return out if high is None else F.when(out > high, F.lit(high)).otherwise(out)


def minus_log10(x: Column, tiny: float = 1e-300) -> Column:
    return -F.log10(x + F.lit(tiny))


def conf_bins(x: Column) -> Column:
    return F.when((x >= 0) & (x < 0.4), "[0,0.4)").when((x >= 0.4) & (x < 0.7), "[0.4,0.7)").when((x >= 0.7) & (x < 1.01), "[0.7,1.01)").otherwise("other")


def conf_levels(x: Column) -> Column:
    """Right-closed low, mid, high; the lowest edge belongs to low."""
    return F.when((x >= 0) & (x <= 0.4), "low").when((x > 0.4) & (x <= 0.7), "mid").when((x > 0.7) & (x <= 1), "high")


def distance_bin(d: Column, low: float, high: float, width: float) -> Column:
    """Centre of the right-closed bin of equal width, lowest edge included; null outside."""
    place = F.greatest(F.ceil((d - low) / width) - 1, F.lit(0))
    return F.when((d >= low) & (d <= high), low + width * (place + 0.5))


def imbalance(up: Column, low: Column) -> Column:
    return F.coalesce(F.try_divide((up - low).cast("double"), (up + low).cast("double")), F.lit(0.0))


def dge_category(q: Column, lfc: Column, mean: Column, *, q_max: float = 0.05, lfc_min: float = 0.25, mean_min: float = 5.0) -> Column:
    significant = q < q_max
    practical = significant & (F.abs(lfc) >= lfc_min) & (mean >= mean_min)
    return F.when(practical & (lfc > 0), "A_enriched").when(practical & (lfc < 0), "B_enriched").when(significant, "Stat_sig_only").otherwise("NS")


def clean_term(term: Column, longest: int = 45) -> Column:
    """Readable name of a gene set: known prefixes and ids go, each run of letters begins upper-case, long names are cut."""
    out = F.regexp_replace(term, r"\s*\(GO:\d+\)", "")
    out = F.regexp_replace(out, r"\s*Homo sapiens\s*hsa\d+", "")
    out = F.replace(F.replace(out, F.lit("HALLMARK_"), F.lit("")), F.lit("_"), F.lit(" "))
    runs = F.regexp_extract_all(out, F.lit(r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"), F.lit(1))
    out = F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 2**31 - 1)))), "")
    return F.when(F.length(out) > longest, F.concat(F.substring(out, 1, longest - 3), F.lit("..."))).otherwise(out)


def format_q(q: Column) -> Column:
    return F.when(q.isNull() | F.isnan(q), "nan").when(q < 1e-300, "< 1e-300").otherwise(F.format_string("%.3e", q))


def scale_from_name(name: Column) -> tuple[Column, Column]:
    """Base and scale of a column name such as base_s30."""
    pattern = r"^(.*)_s(\d+)$"
    return F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2).cast("int")


# W. J. Cody's rational approximations of the error function (1969), highest power first.
_ERF = (
    (1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3),
    (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3),
)
_ERFC = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
_ERFC_FAR = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, however often f uses it."""
    return F.transform(F.array(x), f)[0]


def _rational(x: Column, parts: tuple[Sequence[float], Sequence[float]]) -> Column:
    top, bottom = (reduce(lambda s, c: s * x + F.lit(c), part[1:], F.lit(part[0])) for part in parts)
    return top / bottom


def erfc(x: Column) -> Column:
    """Complementary error function, to about fifteen digits in relative terms; null stays null."""

    def of(v: Column) -> Column:
        y = F.abs(v)
        square = F.when(y > 1e-20, 1 / (y * y)).otherwise(F.lit(1.0))
        near = 1 - v * _rational(v * v, _ERF)
        middle = _rational(y, _ERFC)
        far = (F.lit(1 / math.sqrt(math.pi)) - square * _rational(square, _ERFC_FAR)) / y
        # the exponent in two parts, as its square loses digits
        cut = F.floor(y * 16) / 16
        tail = F.exp(-cut * cut) * F.exp((cut - y) * (cut + y)) * F.when(y <= 4, middle).otherwise(far)
        outer = F.when(y > 27, F.lit(0.0)).otherwise(tail)
        return F.when(F.isnan(v), v).when(y <= 0.46875, near).when(v > 0, outer).otherwise(2 - outer)

    return _let(x.cast("double"), of)


def normal_sf(x: Column | str) -> Column:
    """Survival function of the normal distribution."""
    return 0.5 * erfc((F.col(x) if isinstance(x, str) else x) / math.sqrt(2))


def normal_cdf(x: Column | str) -> Column:
    return normal_sf(-(F.col(x) if isinstance(x, str) else x))


_SMALL = 16


def log_factorial(n: Column) -> Column:
    """ln(n!): a table of the first ones, Stirling's series beyond."""
    table = F.array(*(F.lit(math.lgamma(k + 1)) for k in range(_SMALL)))

    def series(v: Column) -> Column:
        i = 1 / v
        square = i * i
        rest = i * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square * (1 / 1680 - square / 1188))))
        return v * F.log(v) - v + 0.5 * F.log(2 * math.pi * v) + rest

    return F.when(n < _SMALL, F.element_at(table, (F.greatest(n, F.lit(0)) + 1).cast("int"))).otherwise(series(F.greatest(n, F.lit(_SMALL)).cast("double")))


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def hypergeom_sf(hits: Column | str, drawn: Column | str, marked: Column | str, total: Column | str) -> Column:
    """P(at least ``hits`` marked among ``drawn`` of ``total``, of which ``marked`` are).

    Terms are summed away from the mean, where each is smaller than the one before: from ``hits`` up, or one less the
    sum from ``hits`` down.
    """
    h, d, m, t = ((F.col(c) if isinstance(c, str) else c).cast("long") for c in (hits, drawn, marked, total))
    low, high = F.greatest(F.lit(0).cast("long"), d + m - t), F.least(d, m)

    def chance(k: Column) -> Column:
        return F.exp(log_choose(m, k) + log_choose(t - m, d - k) - log_choose(t, d))

    def ratio(k: Column) -> Column:
        """Chance of k + 1 over that of k."""
        k = k.cast("double")
        return ((m - k) * (d - k)) / ((k + 1) * (t - m - d + k + 1))

    def total_of(steps: Column, factor: Callable[[Column], Column]) -> Column:
        """1 + f1 + f1 f2 + ..."""
        start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
        grow = lambda s, k: F.struct((s["term"] * factor(k)).alias("term"), (s["sum"] + s["term"] * factor(k)).alias("sum"))
        return F.aggregate(steps, start, grow, lambda s: s["sum"])

    none = F.array().cast("array<bigint>")
    up = chance(h) * total_of(F.when(h < high, F.sequence(h, high - 1)).otherwise(none), ratio)
    below = h - 1
    down = chance(below) * total_of(F.when(below > low, F.sequence(below - 1, low)).otherwise(none), lambda k: 1 / ratio(k))
    upper = h.cast("double") * t > d.cast("double") * m
    return F.when(h <= low, F.lit(1.0)).when(h > high, F.lit(0.0)).when(upper, F.least(up, F.lit(1.0))).otherwise(F.greatest(1 - down, F.lit(0.0)))
