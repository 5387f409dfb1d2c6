"""Column expressions shared by the operators.  All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from perilgrid.functions import constants as K


def zero(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0))


def sql_literal(v) -> str:
    """A Python value as SQL text."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return f"{v!r}D"
    if isinstance(v, int):
        return str(v)
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def dot(vec: str, consts: list[float]) -> Column:
    """Dot product of a vector column with a fixed vector.

    Unrolled, so that it compiles to plain arithmetic; written as one SQL text,
    so that building the plan takes one call and not one per term.
    """
    return F.expr(" + ".join(f"{vec}[{k}] * {sql_literal(c)}" for k, c in enumerate(consts)))


def lookup(key: str | Column, table: dict, default=None) -> Column:
    """A small fixed mapping as one CASE expression, in table order."""
    if isinstance(key, str) and not any(isinstance(v, Column) for v in [*table.values(), default]):
        arms = " ".join(f"when {sql_literal(k)} then {sql_literal(v)}" for k, v in table.items())
        return F.expr(f"case {key} {arms} else {sql_literal(default)} end")
    key = F.col(key) if isinstance(key, str) else key
    out = None
    for k, v in table.items():
        out = F.when(key == F.lit(k), F.lit(v)) if out is None else out.when(key == F.lit(k), F.lit(v))
    return out if default is None else out.otherwise(default if isinstance(default, Column) else F.lit(default))


def clamp(c: Column, lo, hi) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.greatest(F.least(c, hi), lo)


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(start: Column, end: Column) -> Column:
    return (epoch_micros(end) - epoch_micros(start)) / F.lit(1000000.0)


def risk_rank(risk: Column) -> Column:
    return F.when(risk == "High", 3).when(risk == "Medium", 2).otherwise(1)


def risk_colour(risk: Column) -> Column:
    return lookup(risk, K.RISK_COLOUR, "Green")


def _number(c: Column, least: int, most: int, whole: str, exponent_digits: int) -> Column:
    """Shortest digits of a double, in plain notation for exponents from ``least`` up to ``most``."""
    # Catalyst's own text has a digit, a point and an exponent outside [1e-3, 1e7)
    sign = F.when(c < 0, "-").otherwise("")
    text = F.abs(c.cast("double")).cast("string")
    head = F.split_part(text, F.lit("E"), F.lit(1))
    whole_part, fraction = F.split_part(head, F.lit("."), F.lit(1)), F.split_part(head, F.lit("."), F.lit(2))
    raw = F.concat(whole_part, fraction)
    digits = F.regexp_replace(F.regexp_replace(raw, "^0+", ""), "0+$", "")
    zeros = F.length(raw) - F.length(F.regexp_replace(raw, "^0+", ""))
    shift = F.coalesce(F.nullif(F.split_part(text, F.lit("E"), F.lit(2)), F.lit("")).cast("int"), F.lit(0))
    e = shift + F.length(whole_part) - 1 - zeros
    n = F.length(digits)
    plain = (
        F.when(e < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits))
        .when(n <= e + 1, F.concat(digits, F.repeat(F.lit("0"), e + 1 - n), F.lit(whole)))
        .otherwise(F.concat(F.substring(digits, F.lit(1), e + 1), F.lit("."), F.substring(digits, e + 2, n)))
    )
    mantissa = F.when(n > 1, F.concat(F.left(digits, F.lit(1)), F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(digits)
    power = F.concat(F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.length(F.abs(e).cast("string")), F.lit(exponent_digits)), F.lit("0")))
    shown = F.when((e >= least) & (e < most), plain).otherwise(F.concat(mantissa, power))
    # most numbers need none of this: Catalyst prints them plainly, whole ones with a zero behind the point
    usual = c.cast("double").cast("string")
    usual = usual if whole == ".0" else F.when(usual.endswith(".0"), F.substring(usual, F.lit(1), F.length(usual) - 2)).otherwise(usual)
    return F.when((F.abs(c) >= 1e-3) & (F.abs(c) < 1e7), usual).when(c == 0, "0" + whole).when(F.isnan(c.cast("double")) | (F.abs(c) == float("inf")), c.cast("string")).otherwise(F.concat(sign, shown))


def js_number(c: Column) -> Column:
    """A number as JavaScript prints it: 4.0 is 4, 0.0004 stays plain, 1e21 does not."""
    return F.when(c.isNotNull(), _number(c, -6, 21, "", 1))


def py_number(c: Column) -> Column:
    """A number as Python prints it: 4.0 stays 4.0, 1e16 and 1e-05 have exponents."""
    return F.when(c.isNotNull(), _number(c, -4, 16, ".0", 2))


def fill(template: Column, variables: dict[str, Column]) -> Column:
    out = template
    for name, value in variables.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * K.EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def point_in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd test of a point against an open ring of ``{lon, lat}`` vertices."""
    n = F.size(ring)

    def crosses(vertex: Column, i: Column) -> Column:
        other = F.element_at(ring, F.when(i == 0, n).otherwise(i))
        straddles = (vertex["lat"] > lat) != (other["lat"] > lat)
        at = (other["lon"] - vertex["lon"]) * (lat - vertex["lat"]) / F.nullif(other["lat"] - vertex["lat"], F.lit(0.0)) + vertex["lon"]
        return straddles & F.coalesce(lon < at, F.lit(False))

    return F.size(F.filter(F.transform(ring, crosses), lambda hit: hit)) % 2 == 1


def stable_id(*parts) -> Column:
    """An id made of the business key, so that a re-run writes the same id."""
    return F.sha2(F.concat_ws("|", *[p if isinstance(p, Column) else F.col(p) for p in parts]), 256)
