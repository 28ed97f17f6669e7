"""Scalar functions and operators of the pattern language, on (Column, type) pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions import geo
from weftgraph.functions import values as V

LONG, DOUBLE, STRING, BOOL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()
Typed = tuple[Column, T.DataType]
NULL = T.NullType()


def null(dtype: T.DataType = STRING) -> Typed:
    return F.lit(None).cast(dtype), dtype


def two_valued(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def equal(a: Typed, b: Typed) -> Column:
    (x, tx), (y, ty) = a, b
    if isinstance(tx, T.NullType) or isinstance(ty, T.NullType):
        return x.isNull() & y.isNull()
    kx, ky = V.kind(tx), V.kind(ty)
    if kx == ky and kx in "idsbx":
        return x.eqNullSafe(y)
    if {kx, ky} <= {"s", "x"}:
        return x.eqNullSafe(y)
    return V.same(x, tx, y, ty)


def less(op: str, a: Typed, b: Typed) -> Column:
    """Numbers with numbers, strings with strings; null is lowest; other pairs compare as equal."""
    (x, tx), (y, ty) = a, b
    kx, ky = V.kind(tx), V.kind(ty)
    if kx == ky and kx in "isbx" or {kx, ky} <= {"s", "x"}:
        p, q = x, y
    else:
        nx, ny = V.number(x, tx), V.number(y, ty)
        if nx is not None and ny is not None:
            p, q = nx, ny
        elif V.string(x, tx) is not None and V.string(y, ty) is not None:
            p, q = V.string(x, tx), V.string(y, ty)
        else:
            p, q = F.lit(0), F.lit(0)
    real = {"<": p < q, "<=": p <= q, ">": p > q, ">=": p >= q}[op]
    xn, yn = x.isNull(), y.isNull()
    nulls = {"<": xn & ~yn, "<=": xn, ">": ~xn & yn, ">=": yn}[op]
    return F.when(xn | yn, nulls).otherwise(two_valued(real))


def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    (x, tx), (y, ty) = a, b
    kx, ky = V.kind(tx), V.kind(ty)
    if op == "^":
        return power(a, b)
    if op == "+" and kx == ky == "s":
        return F.concat(x, y), STRING
    if op == "+" and kx == ky == "l":
        return F.concat(x, y), tx
    if kx == ky == "i":
        x, y = x.cast("long"), y.cast("long")
        if op == "/":
            return F.call_function("div", x, F.when(y != 0, y)), LONG
        if op == "%":
            return F.when(y != 0, x % F.when(y != 0, y)), LONG
        return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y), LONG
    nx, ny = V.number(x, tx), V.number(y, ty)
    if nx is None or ny is None or op == "%":
        return null(DOUBLE)
    if op == "/":
        return F.try_divide(nx, ny), DOUBLE
    return {"+": nx + ny, "-": nx - ny, "*": nx * ny}[op], DOUBLE


def power(a: Typed, b: Typed) -> Typed:
    nx, ny = V.number(*a), V.number(*b)
    if nx is None or ny is None:
        return null(DOUBLE)
    raw = F.pow(nx, ny)
    if V.kind(a[1]) == V.kind(b[1]) == "i":
        return F.when((b[0] >= 0) & (F.abs(raw) < 9.0e15), raw.cast("long")), LONG
    return raw, DOUBLE


def join_text(a: Typed, b: Typed) -> Typed:
    return F.concat(V.text(*a), V.text(*b)), STRING


def shaped(name: str, f, guard=None):
    """A function of one double; null outside its domain."""

    def run(a: Typed) -> Typed:
        n = V.number(*a)
        if n is None:
            return null(DOUBLE)
        return (F.when(guard(n), f(F.when(guard(n), n))) if guard else f(n)), DOUBLE

    return run


def _rounding(f):
    def run(a: Typed) -> Typed:
        if V.kind(a[1]) == "i":
            return a
        n = V.number(*a)
        return (f(n).cast("double"), DOUBLE) if n is not None else null(DOUBLE)

    return run


def size(a: Typed) -> Typed:
    k = V.kind(a[1])
    if k == "s":
        return F.octet_length(a[0]).cast("long"), LONG
    if k == "l":
        return F.when(a[0].isNotNull(), F.size(a[0])).cast("long"), LONG
    return null(LONG)


def _string(f):
    return lambda a, *more: (f(a[0], *more), STRING) if V.kind(a[1]) == "s" else null()


def substring(a: Typed, start: Typed, length: Typed | None = None) -> Typed:
    if V.kind(a[1]) != "s":
        return null()
    at = F.greatest(start[0].cast("int"), F.lit(0)) + 1
    n = F.greatest(length[0].cast("int"), F.lit(0)) if length else F.lit(2**31 - 1)
    return F.substring(a[0], at, n), STRING


def to_integer(a: Typed) -> Typed:
    k = V.kind(a[1])
    if k == "s":
        return F.trim(a[0]).try_cast("long"), LONG
    return (a[0].try_cast("long"), LONG) if k in "idb" else null(LONG)


def to_float(a: Typed) -> Typed:
    return (a[0].try_cast("double"), DOUBLE) if V.kind(a[1]) in "ids" else null(DOUBLE)


def to_boolean(a: Typed) -> Typed:
    k, c = V.kind(a[1]), a[0]
    if k == "b":
        return a
    if k == "s":
        low = F.lower(F.trim(c))
        return F.when(low.isin("true", "yes", "1"), True).when(low.isin("false", "no", "0"), False), BOOL
    return (c != 0, BOOL) if k == "i" else null(BOOL)


def coalesce(*args: Typed) -> Typed:
    target = V.common([t for _, t in args])
    return F.coalesce(*(V.as_common(c, t, target) for c, t in args)), target


def replace_text(a: Typed, b: Typed, c: Typed) -> Typed:
    return (F.replace(a[0], b[0], c[0]), STRING) if V.kind(a[1]) == "s" else null()


_SPACE = r"[\p{IsWhite_Space}]"
POINT = T.StructType([T.StructField("lon", DOUBLE), T.StructField("lat", DOUBLE)])


def point(lon: Typed, lat: Typed) -> Typed:
    return F.struct(lon[0].cast("double").alias("lon"), lat[0].cast("double").alias("lat")), POINT


def polygon(ring: Typed) -> Typed:
    points = F.transform(ring[0], lambda p: F.struct(p[0].cast("double").alias("lon"), p[1].cast("double").alias("lat"))) if isinstance(ring[1].elementType, T.ArrayType) else ring[0]
    return F.when(F.element_at(points, 1).eqNullSafe(F.element_at(points, -1)), points).otherwise(F.concat(points, F.slice(points, 1, 1))), T.ArrayType(POINT)


def in_box(p: Typed, *box: Typed) -> Typed:
    w, s, e, n = (b[0] for b in box)
    return two_valued((p[0]["lon"] >= w) & (p[0]["lon"] <= e) & (p[0]["lat"] >= s) & (p[0]["lat"] <= n)), BOOL


ONE = {
    "TOUPPER": _string(F.upper), "UPPER": _string(F.upper), "TOLOWER": _string(F.lower), "LOWER": _string(F.lower),
    "SIZE": size, "LENGTH": size,
    "TRIM": _string(lambda c: F.regexp_replace(c, f"^{_SPACE}+|{_SPACE}+$", "")), "LTRIM": _string(lambda c: F.regexp_replace(c, f"^{_SPACE}+", "")), "RTRIM": _string(lambda c: F.regexp_replace(c, f"{_SPACE}+$", "")),
    "ABS": lambda a: (F.abs(a[0]), a[1]) if V.kind(a[1]) in "id" else null(DOUBLE),
    "CEIL": _rounding(F.ceil), "CEILING": _rounding(F.ceil), "FLOOR": _rounding(F.floor), "ROUND": _rounding(F.round),
    "SIGN": lambda a: (F.signum(V.number(*a)).cast("long"), LONG) if V.number(*a) is not None else null(LONG),
    "SQRT": shaped("sqrt", F.sqrt, lambda n: n >= 0), "LOG": shaped("ln", F.ln, lambda n: n > 0), "LN": shaped("ln", F.ln, lambda n: n > 0), "LOG10": shaped("log10", F.log10, lambda n: n > 0),
    "EXP": shaped("exp", F.exp), "SIN": shaped("sin", F.sin), "COS": shaped("cos", F.cos), "TAN": shaped("tan", F.tan),
    "ASIN": shaped("asin", F.asin, lambda n: F.abs(n) <= 1), "ACOS": shaped("acos", F.acos, lambda n: F.abs(n) <= 1), "ATAN": shaped("atan", F.atan),
    "RADIANS": shaped("radians", F.radians), "TORADIANS": shaped("radians", F.radians), "DEGREES": shaped("degrees", F.degrees), "TODEGREES": shaped("degrees", F.degrees),
    "TOSTRING": lambda a: (V.text(*a), STRING) if V.kind(a[1]) in "idsbt" else null(),
    "TOINTEGER": to_integer, "TOINT": to_integer, "TOFLOAT": to_float, "TOBOOLEAN": to_boolean, "TOBOOL": to_boolean,
}
MANY = {
    "COALESCE": coalesce, "SUBSTRING": substring, "REPLACE": replace_text, "POW": power, "POWER": power,
    "ATAN2": lambda a, b: (F.atan2(V.number(*a), V.number(*b)), DOUBLE) if V.number(*a) is not None and V.number(*b) is not None else null(DOUBLE),
    "PI": lambda: (F.pi(), DOUBLE), "E": lambda: (F.e(), DOUBLE),
    "POINT": point, "POLYGON": polygon,
    "POINT.DISTANCE": lambda a, b: (geo.haversine(a[0], b[0]), DOUBLE),
    "POINT.WITHIN_BBOX": in_box,
    "POINT.WITHIN_DISTANCE": lambda a, b, d: (two_valued(geo.haversine(a[0], b[0]) <= d[0]), BOOL),
}
