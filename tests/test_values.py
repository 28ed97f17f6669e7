"""Value semantics, math expressions and geometry."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions import geo
from weftgraph.functions import values as V
from weftgraph.functions.mathexpr import compile_math, names
from weftgraph.functions.predicates import P, TextP


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_equality_is_typed(spark):
    whole, real = (F.lit(1).cast("long"), T.LongType()), (F.lit(1.0), T.DoubleType())
    assert one(spark, V.equals(*whole, 1)) and not one(spark, V.equals(*whole, 1.0))
    assert one(spark, V.equals(F.lit(None).cast("long"), T.LongType(), None))
    assert one(spark, V.compare(*whole, "<", 1.5)) and one(spark, V.compare(*real, ">=", 1))
    assert not one(spark, V.compare(*whole, "<", "a"))


def test_tagged_order(spark):
    items = [(F.lit("a"), T.StringType()), (F.lit(2.5), T.DoubleType()), (F.lit(True), T.BooleanType()), (F.lit(9).cast("long"), T.LongType())]
    df = spark.range(1).select(F.explode(F.array(*(V.tagged(c, t) for c, t in items))).alias("x")).orderBy("x")
    assert [r.x.t for r in df.collect()] == [0, 1, 2, 3]


@pytest.mark.parametrize(("p", "value", "want"), [(P.between(1, 3), 3, False), (P.between(1, 3), 1, True), (P.inside(1, 3), 1, False), (P.outside(1, 3), 0, True), (P.within(1, 2), 2, True), (P.without(1, 2), 3, True), (P.neq(1.0), 1, True), (TextP.notContaining("a"), 1, False), (TextP.regex("^a.c$"), "abc", True), (TextP.endingWith("c").negate(), "abc", False)])
def test_predicates(spark, p, value, want):
    t = T.StringType() if isinstance(value, str) else T.LongType()
    assert one(spark, p.column(F.lit(value).cast(t), t)) is want


def test_bad_pattern():
    assert TextP.try_regex("(") is None


@settings(max_examples=15, deadline=None)
@given(st.integers(-50, 50), st.integers(1, 9))
def test_math(spark, a, b):
    text = "(_ + 2) * b - _ / b ^ 2"
    assert names(text) == ["_", "b"]
    got = one(spark, compile_math(text, {"_": F.lit(a), "b": F.lit(b)}))
    assert got == pytest.approx((a + 2) * b - a / b**2)


def test_math_undefined(spark):
    assert one(spark, compile_math("1 / _", {"_": F.lit(0)})) is None
    assert one(spark, compile_math("sqrt(_)", {"_": F.lit(-1)})) is None
    with pytest.raises(ValueError):
        compile_math("1 +", {})


@pytest.mark.parametrize(("lon", "lat", "met"), [(5, 5, True), (10, 5, True), (0, 5, True), (5, 10, True), (5, 0, True), (10, 10, True), (10, 11, False), (11, 10, False), (10.000001, 5, False)])
def test_intersects_holds_the_boundary(spark, lon, lat, met):
    p, square = geo.Point(lon, lat), geo.Polygon([(0, 0), (10, 0), (10, 10), (0, 10)])
    ring = T.ArrayType(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]))
    assert one(spark, P.geo_intersects(square).column(p.column(), ring.elementType)) is met
    assert one(spark, P.geo_intersects(p).column(square.column(), ring)) is met


def test_intersects_holds_slanted_sides(spark):
    meets = lambda *p: one(spark, geo.meets_ring(geo.Point(*p).column(), geo.Polygon([(0, 0), (8, 0), (0, 8)]).column()))
    assert meets(4, 4) and meets(8, 0) and not meets(4, 4.5) and not meets(9, -1)


def test_geometry(spark):
    paris, london = geo.Point(2.3522, 48.8566), geo.Point(-0.1276, 51.5072)
    assert one(spark, geo.haversine(paris.column(), london.column())) == pytest.approx(343_500, rel=0.01)
    square = geo.Polygon([(0, 0), (10, 0), (10, 10), (0, 10)])
    inside = lambda p: one(spark, geo.in_ring(p.column(), square.column()))
    assert inside(geo.Point(5, 5)) and not inside(geo.Point(15, 5))
    assert len(geo.radius_box(geo.Point(179.9, 0), 100_000)) == 2
    with pytest.raises(ValueError):
        geo.Point(200, 0)
    with pytest.raises(ValueError):
        geo.Polygon([(0, 0), (1, 1)])
