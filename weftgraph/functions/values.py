"""Dynamic value semantics over typed columns.

A property that has one type over all labels is a plain column. Where labels disagree it becomes a tagged
struct (``TAG``), whose fields are laid out so that the struct's own order is the traversal's sort order:
integers, floats, strings, booleans, the rest.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAG = T.StructType(
    [
        T.StructField("t", T.IntegerType()),
        T.StructField("i", T.LongType()),
        T.StructField("d", T.DoubleType()),
        T.StructField("s", T.StringType()),
        T.StructField("b", T.BooleanType()),
    ]
)
RANK = {"i": 0, "d": 1, "s": 2, "b": 3}


def kind(dtype: T.DataType) -> str:
    """i, d, s, b for scalars, l for lists, m for maps and structs, t for tagged, x for the rest."""
    if isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return "i"
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return "d"
    if isinstance(dtype, T.StringType):
        return "s"
    if isinstance(dtype, T.BooleanType):
        return "b"
    if isinstance(dtype, T.ArrayType):
        return "l"
    if dtype == TAG:
        return "t"
    if isinstance(dtype, (T.MapType, T.StructType)):
        return "m"
    return "x"


def kind_of(value) -> str:
    if isinstance(value, bool):
        return "b"
    if isinstance(value, int):
        return "i"
    if isinstance(value, float):
        return "d"
    if isinstance(value, str):
        return "s"
    if isinstance(value, (list, tuple)):
        return "l"
    return "x"


def widen(c: Column, dtype: T.DataType) -> tuple[Column, T.DataType]:
    """Integers to 64 bits and floats to doubles."""
    k = kind(dtype)
    if k == "i":
        return c.cast("long"), T.LongType()
    if k == "d":
        return c.cast("double"), T.DoubleType()
    return c, dtype


def tagged(c: Column, dtype: T.DataType) -> Column:
    """A value as a tagged struct; null stays null."""
    k = kind(dtype)
    if k == "t":
        return c
    parts = {n: F.lit(None).cast(t) for n, t in (("i", "long"), ("d", "double"), ("s", "string"), ("b", "boolean"))}
    if k in parts:
        parts[k] = c
    else:
        parts["s"] = F.to_json(c) if k in "lm" else c.cast("string")
    return F.when(c.isNotNull(), F.struct(F.lit(RANK.get(k, 4)).alias("t"), *(v.alias(n) for n, v in parts.items())))


def number(c: Column, dtype: T.DataType) -> Column | None:
    """The value as a double where it is numeric; None if the type never is."""
    k = kind(dtype)
    if k in "id":
        return c.cast("double")
    if k == "t":
        return F.coalesce(c["i"].cast("double"), c["d"])
    return None


def string(c: Column, dtype: T.DataType) -> Column | None:
    k = kind(dtype)
    return c if k == "s" else c["s"] if k == "t" else None


def equals(c: Column, dtype: T.DataType, value) -> Column:
    """Strict equality: an integer never equals a float, null equals null."""
    if value is None:
        return c.isNull()
    k, v = kind(dtype), kind_of(value)
    if k == "t":
        return F.coalesce(c[v] == F.lit(value), F.lit(False)) if v in RANK else F.lit(False)
    if k == "l" and v == "l":
        return F.coalesce(c == F.array(*map(F.lit, value)), F.lit(False))
    if k != v and k != "x":
        return F.lit(False)
    return F.coalesce(c == F.lit(value), F.lit(False))


def compare(c: Column, dtype: T.DataType, op: str, value) -> Column:
    """Ordering comparison: numbers with numbers, strings with strings, all else false."""
    v = kind_of(value)
    left = number(c, dtype) if v in "id" else string(c, dtype) if v == "s" else c if v == kind(dtype) == "x" else None
    if v in "id" and kind(dtype) == v == "i":
        left = c
    if left is None:
        if kind(dtype) == "x":
            left = c
        else:
            return F.lit(False)
    right = F.lit(value)
    out = {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]
    return F.coalesce(out, F.lit(False))


def same(a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    """Strict null-safe equality of two columns."""
    ka, kb = kind(ta), kind(tb)
    if ka == kb:
        return a.eqNullSafe(b)
    if "t" in (ka, kb):
        return tagged(a, ta).eqNullSafe(tagged(b, tb))
    return a.isNull() & b.isNull()


def common(types: list[T.DataType]) -> T.DataType:
    """One type for all: the type itself, or the tagged struct."""
    real = [t for t in types if not isinstance(t, T.NullType)]
    if not real:
        return T.StringType()
    kinds = {kind(t) for t in real}
    if len(kinds) == 1:
        return {"i": T.LongType(), "d": T.DoubleType()}.get(next(iter(kinds)), real[0])
    return TAG


def as_common(c: Column, dtype: T.DataType, target: T.DataType) -> Column:
    return tagged(c, dtype) if target == TAG else c.cast(target)


def truthy(c: Column, dtype: T.DataType) -> Column:
    """False for null, false, zero and the empty string."""
    k = kind(dtype)
    if k == "b":
        return F.coalesce(c, F.lit(False))
    if k in "id":
        return F.coalesce(c != 0, F.lit(False))
    if k == "s":
        return F.coalesce(c != "", F.lit(False))
    return c.isNotNull()


def text(c: Column, dtype: T.DataType) -> Column:
    """A scalar as text: whole floats without a fraction, booleans in lower case."""
    k = kind(dtype)
    if k == "d":
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return F.when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))
    if k == "t":
        return F.coalesce(c["s"], c["i"].cast("string"), text(c["d"], T.DoubleType()), c["b"].cast("string"))
    if k in "lm":
        return F.to_json(c)
    return c.cast("string")
