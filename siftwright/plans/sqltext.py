"""SQL text for tail probabilities, by numerical integration (Simpson, 4000 steps).

The checks need them because the comparing engine has no error function either; integrating the
density is independent of the series and continued fractions the Spark side uses.
"""

from __future__ import annotations

_STEPS = 4000


def _simpson(upper: str, density: str) -> str:
    """Integral of ``density`` (an expression in ``u``) from 0 to ``upper``."""
    weight = f"CASE WHEN i = 0 OR i = {_STEPS} THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END"
    body = density.replace("{u}", f"(({upper}) * i / {_STEPS}.0)")
    return f"(({upper}) / {_STEPS}.0 / 3.0 * list_sum(list_transform(range(0, {_STEPS + 1}), lambda i: ({weight}) * ({body}))))"


def normal_cdf(z: str) -> str:
    return f"(0.5 + {_simpson(z, 'exp(-({u}) * ({u}) / 2.0) / sqrt(2.0 * pi())')})"


def student_two_sided(t: str, v: str) -> str:
    density = (
        f"exp(lgamma((({v}) + 1.0) / 2.0) - lgamma(({v}) / 2.0)) / sqrt(({v}) * pi()) "
        f"* pow(1.0 + ({{u}}) * ({{u}}) / ({v}), -(({v}) + 1.0) / 2.0)"
    )
    return f"(1.0 - 2.0 * {_simpson(f'abs({t})', density)})"


def chi2_upper(x: str, k: str) -> str:
    """With u = sqrt(x) the density of any whole number of degrees is smooth at 0."""
    density = (
        f"2.0 * pow({{u}}, ({k}) - 1.0) * exp(-({{u}}) * ({{u}}) / 2.0) / (pow(2.0, ({k}) / 2.0) * exp(lgamma(({k}) / 2.0)))"
    )
    return f"(1.0 - {_simpson(f'sqrt({x})', density)})"


def kolmogorov_upper(d: str, n: str) -> str:
    term = f"(CASE WHEN i % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * i * i * ({d}) * ({d}) * ({n}))"
    return f"CASE WHEN ({d}) * sqrt({n}) < 0.3 THEN 1.0 ELSE greatest(0.0, least(1.0, list_sum(list_transform(range(1, 101), lambda i: {term})))) END"
