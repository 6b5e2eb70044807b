"""Column functions: codes and numbers in text, compositions, vectors, great circles, intervals."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def code_prefix(c: Column, length: int = 8) -> Column:
    """Digits only, cut to ``length``."""
    return F.substring(F.regexp_replace(c, r"\D", ""), 1, length)


def decimal_number(c: Column, scale: float = 1.0) -> Column:
    """A number with a decimal comma; null where it is none."""
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double") * F.lit(scale)


def contains_ignore_case(c: Column, part: str) -> Column:
    """False for null."""
    return F.coalesce(F.contains(F.lower(c), F.lit(part.lower())), F.lit(False))


def log_positive(c: Column) -> Column:
    return F.when(c > 0, F.ln(c))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def clr(shares: Column, floor: float = 1e-6) -> Column:
    """Centred log-ratio of a composition: shares of the sum, zeros replaced, renormalised, row-centred logs."""
    s = array_sum(shares)
    logs = F.transform(shares, lambda x: F.ln(F.greatest(x / s, F.lit(floor))))
    # Renormalising subtracts one constant from all logs, which centring removes.
    return F.transform(logs, lambda v: v - array_sum(logs) / F.size(logs))


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    """Great-circle distance; infinite where a coordinate is missing."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.coalesce(F.lit(2 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h)))), F.lit(float("inf")))


def wilson_lower(correct: Column, n: Column, z: float = 1.96) -> Column:
    """Lower bound of the Wilson interval; 0 for no trials."""
    p = correct / n
    return F.when(n > 0, (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)).otherwise(0.0)


def md5_uniform(*keys: Column) -> Column:
    """In [0, 1) from the first 13 hex digits of an MD5 over the keys joined by '|'."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *keys)), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def average_rank(over: WindowSpec) -> Column:
    """Rank in an ordered window, ties averaged."""
    ties = F.count("*").over(over.rangeBetween(0, 0))
    return F.rank().over(over) + (ties - 1) / 2.0


def interpolate(c: Column, points: list[tuple[float, float]]) -> Column:
    """Linear between the points (sorted by x), constant beyond them."""
    out = F.lit(points[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:], strict=False))):
        out = F.when(c < x1, y0 + (y1 - y0) * (c - x0) / (x1 - x0)).otherwise(out)
    return F.when(c.isNotNull(), F.when(c <= points[0][0], points[0][1]).otherwise(out))


def section_letter(c: Column, letters: str, aliases: str) -> Column:
    """The capital that a code begins with, through an alphabet of aliases; empty where it begins with none."""
    return F.translate(F.regexp_extract(c, r"^(\p{Lu})", 1), letters, aliases)


def spaced_number(c: Column, digits: int, space: str = "\u2009") -> Column:
    """A number as text: decimal comma, thousands apart."""
    return F.translate(F.format_number(c, digits), ",.", f"{space},")
