"""Normal and Student distributions as columns: built-in functions only, so they stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: coefficients of a rational approximation of the inverse normal distribution (relative error below 1.2e-9)
CENTRE = ([-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00],
          [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0])
TAIL = ([-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00],
        [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0])
EDGE = 0.02425
TERMS = 150  # of the series of the normal distribution; enough for |z| up to 8


def _horner(coefficients: list[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """The value below which a share ``p`` of the standard normal distribution lies."""
    def tail(q: Column) -> Column:
        t = F.sqrt(-2 * F.log(q))
        return _horner(TAIL[0], t) / _horner(TAIL[1], t)

    q = p - 0.5
    centre = _horner(CENTRE[0], q * q) * q / _horner(CENTRE[1], q * q)
    return F.when(p < EDGE, tail(p)).when(p > 1 - EDGE, -tail(1 - p)).otherwise(centre)


def normal_cdf(z: Column) -> Column:
    """0.5 + density * (z + z**3/3 + z**5/(3*5) + ...); 0 and 1 beyond eight deviations."""
    x = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    start = F.struct(x.alias("term"), x.alias("total"))

    def step(a: Column, k: Column) -> Column:
        term = a["term"] * x * x / (2 * k + 1)
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda a: a["total"])
    return F.least(F.greatest(0.5 + F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * total, F.lit(0.0)), F.lit(1.0))


def normal_cdf_sql(z: str) -> str:
    """The same series in closed form: z**(2k+1)/(1*3*...*(2k+1))."""
    x = f"least(greatest({z}, -8.0), 8.0)::DOUBLE"
    term = f"exp((2*k + 1)*ln(nullif(abs({x}), 0)) - (lgamma(2*k + 2) - k*ln(2.0) - lgamma(k + 1)))"
    return f"least(greatest(0.5 + coalesce(sign({x})*exp(-({x})*({x})/2)/sqrt(2*pi())*list_sum(list_transform(range({TERMS}), lambda k: {term})), 0.0), 0.0), 1.0)"


def normal_quantile_sql(p: str) -> str:
    horner = lambda c, x: "(" * (len(c) - 1) + repr(c[0]) + "::DOUBLE" + "".join(f")*{x} + ({v!r}::DOUBLE)" for v in c[1:])

    def tail(q: str) -> str:
        t = f"sqrt(-2*ln({q}))"
        return f"(({horner(TAIL[0], t)})/({horner(TAIL[1], t)}))"

    q = f"({p} - 0.5)"
    centre = f"({horner(CENTRE[0], f'({q}*{q})')})*{q}/({horner(CENTRE[1], f'({q}*{q})')})"
    return f"CASE WHEN {p} < {EDGE} THEN {tail(p)} WHEN {p} > {1 - EDGE!r} THEN -{tail(f'(1 - {p})')} ELSE {centre} END"


def student_upper(t: float, df: float) -> float:
    """The probability of a value above ``t``: the incomplete beta function as a continued fraction."""
    if math.isnan(t) or df <= 0:
        return float("nan")
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if x > 0 else 0.0

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1) or 1e-300)
        out = d
        for m in range(1, 1000):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + top * d) or 1e-300)
                c = (1 + top / c) or 1e-300
                out *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return out

    two = front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b
    return two / 2 if t > 0 else 1 - two / 2
