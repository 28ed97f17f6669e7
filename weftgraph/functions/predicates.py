"""Predicates on values: P, TextP and geographic ones. Each gives a two-valued Column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.functions import geo
from weftgraph.functions import values as V


class P:
    """A test of one value; combine with ``and_``, ``or_`` and ``negate``."""

    def __init__(self, name: str, *args):
        self.name, self.args = name, args

    def __repr__(self):
        return f"{self.name}({', '.join(map(repr, self.args))})"

    def and_(self, other: P) -> P:
        return P("and", self, other)

    def or_(self, other: P) -> P:
        return P("or", self, other)

    def negate(self) -> P:
        return P("not", self)

    __and__, __or__, __invert__ = and_, or_, negate

    @staticmethod
    def eq(v):
        return P("eq", v)

    @staticmethod
    def neq(v):
        return P("neq", v)

    @staticmethod
    def lt(v):
        return P("lt", v)

    @staticmethod
    def lte(v):
        return P("lte", v)

    @staticmethod
    def gt(v):
        return P("gt", v)

    @staticmethod
    def gte(v):
        return P("gte", v)

    @staticmethod
    def between(a, b):
        return P("between", a, b)

    @staticmethod
    def inside(a, b):
        return P("inside", a, b)

    @staticmethod
    def outside(a, b):
        return P("outside", a, b)

    @staticmethod
    def within(*vs):
        return P("within", *(vs[0] if len(vs) == 1 and isinstance(vs[0], (list, tuple, set)) else vs))

    @staticmethod
    def without(*vs):
        return P("without", *(vs[0] if len(vs) == 1 and isinstance(vs[0], (list, tuple, set)) else vs))

    @staticmethod
    def not_(p: P):
        return p.negate()

    @staticmethod
    def geo_within_distance(point: geo.Point, metres: float):
        return P("geo_within_distance", point, float(metres))

    @staticmethod
    def geo_intersects(shape):
        return P("geo_intersects", shape)

    @staticmethod
    def geo_contained_by(polygon: geo.Polygon):
        return P("geo_contained_by", polygon)

    @staticmethod
    def geo_bbox(west, south, east, north):
        return P("geo_bbox", west, south, east, north)

    def column(self, c: Column, dtype) -> Column:
        """The test of a column of the given type."""
        a, name = self.args, self.name
        if name == "and":
            return a[0].column(c, dtype) & a[1].column(c, dtype)
        if name == "or":
            return a[0].column(c, dtype) | a[1].column(c, dtype)
        if name == "not":
            return ~a[0].column(c, dtype)
        if name == "eq":
            return V.equals(c, dtype, a[0])
        if name == "neq":
            return ~V.equals(c, dtype, a[0])
        if name in _ORDER:
            return V.compare(c, dtype, _ORDER[name], a[0])
        if name == "between":
            return V.compare(c, dtype, ">=", a[0]) & V.compare(c, dtype, "<", a[1])
        if name == "inside":
            return V.compare(c, dtype, ">", a[0]) & V.compare(c, dtype, "<", a[1])
        if name == "outside":
            return V.compare(c, dtype, "<", a[0]) | V.compare(c, dtype, ">", a[1])
        if name in ("within", "without"):
            found = _any_of(c, dtype, a)
            return found if name == "within" else ~found
        if name.startswith("geo_"):
            return self._geo(c, dtype)
        s = V.string(c, dtype)
        if s is None:
            return F.lit(False)
        base = name.removeprefix("not_")
        test = {"containing": s.contains, "starting_with": s.startswith, "ending_with": s.endswith, "regex": s.rlike}[base](a[0])
        return F.coalesce(~test if name.startswith("not_") else test, F.lit(False))

    def _geo(self, c: Column, dtype) -> Column:
        point, ring = V.kind(dtype) == "m" and "lon" in dtype.names, V.kind(dtype) == "l"
        a, name = self.args, self.name
        if not (point or ring):
            return F.lit(False)
        if name == "geo_bbox":
            if point:
                return geo.in_box(c, a)
            west, south, east, north = (F.lit(float(x)) for x in a)
            return geo.boxes_meet(geo.ring_box(c), F.struct(west.alias("west"), south.alias("south"), east.alias("east"), north.alias("north")))
        if name == "geo_within_distance":
            if not point:
                return F.lit(False)
            near = F.lit(False)
            for box in geo.radius_box(a[0], a[1]):
                near = near | geo.in_box(c, box)
            return near & F.coalesce(geo.haversine(c, a[0].column()) <= a[1], F.lit(False))
        shape = a[0]
        if name == "geo_contained_by":
            if point:
                return geo.in_box(c, shape.box()) & geo.in_ring(c, shape.column())
            return F.coalesce(F.forall(c, lambda p: geo.in_ring(p, shape.column())), F.lit(False))
        if isinstance(shape, geo.Point):
            if point:
                return F.coalesce((c["lon"] == shape.lon) & (c["lat"] == shape.lat), F.lit(False))
            return geo.meets_ring(shape.column(), c)
        if isinstance(shape, geo.Polygon):
            return geo.meets_ring(c, shape.column()) if point else geo.boxes_meet(geo.ring_box(c), geo.ring_box(shape.column()))
        return P("geo_bbox", *shape)._geo(c, dtype)


_ORDER = {"lt": "<", "lte": "<=", "gt": ">", "gte": ">="}


def _any_of(c: Column, dtype, wanted) -> Column:
    """Typed membership as one IN where the type is plain."""
    k = V.kind(dtype)
    plain = [v for v in wanted if v is not None and V.kind_of(v) == k]
    out = F.lit(False)
    if k in "ids b x" and plain:
        out = F.coalesce(c.isin(*plain), F.lit(False))
    elif k in "tlm":
        for v in wanted:
            out = out | V.equals(c, dtype, v)
    if any(v is None for v in wanted):
        out = out | c.isNull()
    return out


class TextP:
    """Tests of strings; every test of another type is false, negated ones too."""

    @staticmethod
    def containing(s):
        return P("containing", s)

    @staticmethod
    def startingWith(s):
        return P("starting_with", s)

    @staticmethod
    def endingWith(s):
        return P("ending_with", s)

    @staticmethod
    def notContaining(s):
        return P("not_containing", s)

    @staticmethod
    def notStartingWith(s):
        return P("not_starting_with", s)

    @staticmethod
    def notEndingWith(s):
        return P("not_ending_with", s)

    @staticmethod
    def regex(pattern):
        re.compile(pattern)  # a bad pattern is an error here, not in a task
        return P("regex", pattern)

    @staticmethod
    def try_regex(pattern):
        try:
            return TextP.regex(pattern)
        except re.error:
            return None
