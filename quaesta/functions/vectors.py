"""Vector and identifier functions, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: UUID of the URL name space; a fixed value.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision, in [-1, 1]; null for a zero vector."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm)))


def l2_normalize(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def require_dimension(v: Column, size: int) -> Column:
    bad = F.raise_error(F.concat(F.lit(f"a vector has not {size} numbers but "), F.coalesce(F.size(v).cast("string"), F.lit("none"))))
    return F.when(F.size(v) == size, v).otherwise(bad.cast("array<double>"))


def point_id(chunk_id: Column) -> Column:
    """Name-based UUID (version 5, URL name space)."""
    h = F.substring(F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(chunk_id, "utf-8"))), 1, 32)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))
