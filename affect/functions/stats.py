"""Distribution tails as Spark column expressions (no Python UDF).

Spark has no ``lgamma`` / incomplete beta, so the F and Student-t tails are
written as expressions: Lanczos log-gamma and the continued fraction of the
regularised incomplete beta (modified Lentz), unrolled with ``aggregate``
over a fixed number of terms.  They run inside whole-stage codegen on the
(small) one-row-per-test results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos approximation, g = 7, 9 terms (published coefficients).
LANCZOS_G = 7.0
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028,
           771.32342877765313, -176.61502916214059, 12.507343278686905,
           -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]

CF_TERMS = 1000
FPMIN = 1e-300
# Beyond this many denominator degrees of freedom the tail is expanded around
# its chi-square limit (the error is of the order of its inverse square).
LARGE_DOF = 1e8
GAMMA_TERMS = 400


def lgamma(z: Column) -> Column:
    """log Gamma(z) for z >= 0.5 (all callers pass half-integers >= 0.5)."""
    zm = z - F.lit(1.0)
    x = F.lit(LANCZOS[0])
    for i in range(1, len(LANCZOS)):
        x = x + F.lit(LANCZOS[i]) / (zm + F.lit(float(i)))
    t = zm + F.lit(LANCZOS_G + 0.5)
    return F.lit(0.5 * math.log(2 * math.pi)) + (zm + F.lit(0.5)) * F.log(t) - t + F.log(x)


def _betacf(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta (Lentz), CF_TERMS terms."""
    qab, qap, qam = a + b, a + F.lit(1.0), a - F.lit(1.0)

    def tiny(v):
        return F.when(F.abs(v) < FPMIN, F.lit(FPMIN)).otherwise(v)

    d0 = F.lit(1.0) / tiny(F.lit(1.0) - qab * x / qap)
    init = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

    def step(acc, m):
        m = m.cast("double")
        m2 = m * 2
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d1 = F.lit(1.0) / tiny(F.lit(1.0) + aa * acc["d"])
        c1 = tiny(F.lit(1.0) + aa / acc["c"])
        h1 = acc["h"] * d1 * c1
        aa2 = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d2 = F.lit(1.0) / tiny(F.lit(1.0) + aa2 * d1)
        c2 = tiny(F.lit(1.0) + aa2 / c1)
        return F.struct(c2.alias("c"), d2.alias("d"), (h1 * d2 * c2).alias("h"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(CF_TERMS)), init, step)["h"]


def betai(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta I_x(a, b)."""
    bt = F.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * F.log(x) + b * F.log(F.lit(1.0) - x))
    direct = bt * _betacf(a, b, x) / a
    mirror = F.lit(1.0) - bt * _betacf(b, a, F.lit(1.0) - x) / b
    return (F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0))
             .when(x < (a + F.lit(1.0)) / (a + b + F.lit(2.0)), direct).otherwise(mirror))


def gamma_q(a: Column, y: Column) -> Column:
    """Regularised upper incomplete gamma Q(a, y) by the series of P(a, y)."""
    def step(acc, i):
        term = acc["t"] * y / (a + i.cast("double"))
        return F.struct(term.alias("t"), (acc["s"] + term).alias("s"))

    first = F.struct((F.lit(1.0) / a).alias("t"), (F.lit(1.0) / a).alias("s"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(GAMMA_TERMS)), first, step)["s"]
    p = F.exp(a * F.log(y) - y - lgamma(a)) * series
    return F.when(y > a + F.lit(12.0) * F.sqrt(a) + F.lit(60.0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - p))


def _f_sf_large(f: Column, d1: Column, d2: Column) -> Column:
    """P(F' > f) for very many denominator degrees of freedom: G(x) + x^2 G''(x) / d2
    with G the chi-square tail and x = d1 f."""
    x, a = d1 * f, d1 / 2
    density = F.exp((a - 1) * F.log(x) - x / 2 - a * F.lit(math.log(2.0)) - lgamma(a))
    return gamma_q(a, x / 2) - x * x * density * ((a - 1) / x - F.lit(0.5)) / d2


def f_sf(f: Column, d1: Column, d2: Column) -> Column:
    """Survival function of the F distribution: P(F' > f)."""
    d1, d2 = d1.cast("double"), d2.cast("double")
    return F.when(f.isNull() | F.isnan(f), F.lit(None).cast("double")) \
        .when(f <= 0, F.lit(1.0)) \
        .when(d2 > LARGE_DOF, _f_sf_large(f, d1, d2)) \
        .otherwise(betai(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)))


def t_two_sided_p(t: Column, dof: Column) -> Column:
    """Two-sided p of Student's t (= F tail of t^2 with (1, dof))."""
    return f_sf(t * t, F.lit(1.0), dof)


# ---------------------------------------------------------------- DuckDB text
def _tiny_sql(v: str) -> str:
    return f"(CASE WHEN abs({v}) < {FPMIN} THEN {FPMIN} ELSE {v} END)"


def betacf_sql(a: str, b: str, x: str) -> str:
    """DuckDB text of the same continued fraction (same terms and order);
    ``a``, ``b``, ``x`` should be plain column names."""
    qab, qap, qam = f"({a} + {b})", f"({a} + 1.0)", f"({a} - 1.0)"
    d0 = f"(1.0 / {_tiny_sql(f'1.0 - {qab} * {x} / {qap}')})"
    m2 = "(2.0 * m)"
    aa = f"(m * ({b} - m) * {x} / (({qam} + {m2}) * ({a} + {m2})))"
    d1 = f"(1.0 / {_tiny_sql(f'1.0 + {aa} * acc.d')})"
    c1 = _tiny_sql(f"1.0 + {aa} / acc.c")
    aa2 = f"(-({a} + m) * ({qab} + m) * {x} / (({a} + {m2}) * ({qap} + {m2})))"
    d2 = f"(1.0 / {_tiny_sql(f'1.0 + {aa2} * {d1}')})"
    c2 = _tiny_sql(f"1.0 + {aa2} / {c1}")
    body = f"{{'c': {c2}, 'd': {d2}, 'h': acc.h * {d1} * {c1} * {d2} * {c2}}}"
    init = f"{{'c': CAST(1.0 AS DOUBLE), 'd': CAST({d0} AS DOUBLE), 'h': CAST({d0} AS DOUBLE)}}"
    return f"list_reduce(list_transform(range(1, {CF_TERMS + 1}), lambda i: CAST(i AS DOUBLE)), lambda acc, m: {body}, {init}).h"


def betai_sql(a: str, b: str, x: str) -> str:
    bt = f"exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln({x}) + {b} * ln(1.0 - {x}))"
    return (f"(CASE WHEN {x} <= 0 THEN 0.0 WHEN {x} >= 1 THEN 1.0 "
            f"WHEN {x} < ({a} + 1.0) / ({a} + {b} + 2.0) THEN {bt} * {betacf_sql(a, b, x)} / {a} "
            f"ELSE 1.0 - {bt} * {betacf_sql(b, a, f'(1.0 - {x})')} / {b} END)")


def f_sf_sql(f: str, d1: str, d2: str) -> str:
    """Needs ``f``, ``d1``, ``d2`` as columns; introduces half-dof columns."""
    return (f"(CASE WHEN {f} IS NULL OR isnan({f}) THEN NULL WHEN {f} <= 0 THEN 1.0 ELSE "
            f"{betai_sql(f'({d2} / 2.0)', f'({d1} / 2.0)', f'({d2} / ({d2} + {d1} * {f}))')} END)")


# ---------------------------------------------------------------- normal distribution
# The published rational approximations of the normal quantile (Wichura 1988, AS 241),
# highest power first: numerator and denominator near the middle, towards the tails, far out.
PPF_MIDDLE = ([2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125,
               1971.5909503065514427, 133.14166789178437745, 3.387132872796366608],
              [5226.495278852545925, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077,
               687.1870074920579083, 42.313330701600911252, 1.0])
PPF_TAIL = ([7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504,
             5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734],
            [1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455,
             1.6763848301838038494, 2.05319162663775882187, 1.0])
PPF_FAR = ([2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123,
            1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772],
           [2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525,
            0.13692988092273580531, 0.59983220655588793769, 1.0])
ERF_TERMS = 300


def poly(x: Column, coefficients: list[float]) -> Column:
    """Value of the polynomial, coefficients of the highest power first."""
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + F.lit(float(c))
    return out


def poly_sql(x: str, coefficients: list[float]) -> str:
    out = f"{float(coefficients[0])!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {float(c)!r}::DOUBLE)"
    return out


def norm_ppf(p: Column) -> Column:
    """Quantile of the standard normal distribution, to about 16 digits."""
    q = p - 0.5
    s = F.lit(0.180625) - q * q
    r = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    tail = F.when(r <= 5, poly(r - 1.6, PPF_TAIL[0]) / poly(r - 1.6, PPF_TAIL[1])).otherwise(poly(r - 5, PPF_FAR[0]) / poly(r - 5, PPF_FAR[1]))
    return F.when(F.abs(q) <= 0.425, q * poly(s, PPF_MIDDLE[0]) / poly(s, PPF_MIDDLE[1])).otherwise(F.signum(q) * tail)


def norm_ppf_sql(p: str) -> str:
    """DuckDB text of the same; ``p`` should be a plain column name."""
    q, s, r = f"({p} - 0.5)", f"(0.180625 - ({p} - 0.5) * ({p} - 0.5))", f"sqrt(-ln(least({p}, 1.0 - {p})))"
    near, far = f"({r} - 1.6)", f"({r} - 5)"
    return (f"(CASE WHEN abs({q}) <= 0.425 THEN {q} * {poly_sql(s, PPF_MIDDLE[0])} / {poly_sql(s, PPF_MIDDLE[1])} "
            f"WHEN {r} <= 5 THEN sign({q}) * {poly_sql(near, PPF_TAIL[0])} / {poly_sql(near, PPF_TAIL[1])} "
            f"ELSE sign({q}) * {poly_sql(far, PPF_FAR[0])} / {poly_sql(far, PPF_FAR[1])} END)")


def norm_sf(z: Column) -> Column:
    """P(Z > z), by the series of the error function that has no cancellation."""
    x = F.least(F.abs(z), F.lit(20.0))
    first = F.struct(x.alias("t"), x.alias("s"))

    def step(acc, i):
        term = acc["t"] * x * x / (2 * i + 1).cast("double")
        return F.struct(term.alias("t"), (acc["s"] + term).alias("s"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(ERF_TERMS)), first, step)["s"]
    half = series * F.exp(-x * x / 2) / math.sqrt(2 * math.pi)  # P(0 < Z < x)
    return F.when(z >= 0, F.greatest(F.lit(0.0), F.lit(0.5) - half)).otherwise(F.least(F.lit(1.0), F.lit(0.5) + half))


def norm_sf_sql(z: str) -> str:
    """DuckDB text of the same; ``z`` should be a plain column name."""
    x = f"least(abs({z}), 20.0::DOUBLE)"
    term = f"(acc.t * {x} * {x} / (2 * i + 1))"
    series = (f"list_reduce(list_transform(range(1, {ERF_TERMS + 1}), lambda k: CAST(k AS DOUBLE)), lambda acc, i: "
              f"{{'t': {term}, 's': acc.s + {term}}}, {{'t': CAST({x} AS DOUBLE), 's': CAST({x} AS DOUBLE)}}).s")
    half = f"({series} * exp(-{x} * {x} / 2) / {math.sqrt(2 * math.pi)!r}::DOUBLE)"
    return f"(CASE WHEN {z} >= 0 THEN greatest(0.0, 0.5 - {half}) ELSE least(1.0, 0.5 + {half}) END)"
