"""Event predicates: a registry from a predicate's name to a column expression.

A predicate is false, never null, on a missing or unreadable attribute. Register predicates compare
the current event with the event bound to a register and are false while it is unbound.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions import geo

#: Attribute names of events and the columns that hold them.
RESERVED = {"EventType": "event_type", "Timestamp": "ts", "Id": "event_id"}
#: Quadrants of a compass heading; hours of the parts of a day.
HEADINGS = {"East": (45.0, 135.0), "South": (135.0, 225.0), "West": (225.0, 315.0)}
HOURS = {
    "Morning": (6, 12), "Noon": (12, 18), "Evening": (18, 24), "Night": (0, 6),
    "EarlyMorning": (6, 8), "MidMorning": (8, 10), "LateMorning": (10, 12), "EarlyNoon": (12, 14), "MidNoon": (14, 16), "LateNoon": (16, 18),
    "EarlyEvening": (18, 20), "MidEvening": (20, 22), "LateEvening": (22, 24), "EarlyNight": (0, 2), "MidNight": (2, 4), "LateNight": (4, 6),
}


def snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name).lstrip("_")


@dataclass
class Scope:
    """Where attributes are looked up: the current event's columns, and those of bound registers.

    columns: names that exist; at(name) gives the column of the current event; bound[r](name) that of
    register r. regions: named polygons. groups: named sets of ids (bounded constants).
    """

    columns: frozenset[str]
    at: Callable[[str], Column]
    bound: dict[str, Callable[[str], Column]] = field(default_factory=dict)
    regions: dict[str, geo.Ring] = field(default_factory=dict)
    groups: dict[str, list[str]] = field(default_factory=dict)

    def column(self, name: str) -> str:
        for n in (RESERVED.get(name, name), name, snake(name)):
            if n in self.columns:
                return n
        raise ValueError(f"events have no attribute {name}")

    def num(self, name: str) -> Column:
        c = self.at(self.column(name))
        return F.expr("null") if c is None else c.try_cast("double")

    def text(self, name: str) -> Column:
        return self.at(self.column(name)).cast("string")

    def reg(self, register: str, name: str, kind: str) -> Column:
        if register not in self.bound:
            raise ValueError(f"register {register} is read before an event is bound to it")
        return self.bound[register](self.column(name)).try_cast(kind)


Maker = Callable[..., Column]
REGISTRY: dict[str, Maker] = {}


def predicate(*names: str) -> Callable[[Maker], Maker]:
    """Register a predicate; also the way to add one's own: ``f(scope, *args) -> Column``."""

    def put(f: Maker) -> Maker:
        for n in names:
            REGISTRY[n] = f
        return f

    return put


def build(name: str, scope: Scope, args: list) -> Column:
    """The column of a predicate call; false where its value is unknown."""
    if name not in REGISTRY:
        raise ValueError(f"unknown predicate {name}")
    return F.coalesce(REGISTRY[name](scope, *args), F.lit(False))


def _between(x: Column, low: float, high: float) -> Column:
    return (x >= float(low)) & (x < float(high))


@predicate("IsEventTypePredicate")
def _is_type(s: Scope, t: str) -> Column:
    return s.text("EventType") == str(t)


for _name, _op in {"EQ": "__eq__", "LT": "__lt__", "LTE": "__le__", "GT": "__gt__", "GTE": "__ge__"}.items():
    REGISTRY[_name] = lambda s, a, c, _op=_op: getattr(s.num(a), _op)(float(c))
for _name, _op in {"EQAttr": "__eq__", "GTAttr": "__gt__", "LTAttr": "__lt__"}.items():
    REGISTRY[_name] = lambda s, a, r, _op=_op: getattr(s.num(a), _op)(s.reg(r, a, "double"))


@predicate("EQStr")
def _eq_str(s: Scope, a: str, c: str) -> Column:
    return s.text(a) == str(c)


@predicate("EQAttrStr")
def _eq_attr_str(s: Scope, a: str, r: str) -> Column:
    return s.text(a) == s.reg(r, a, "string")


@predicate("BT")
def _bt(s: Scope, a: str, low: float, high: float) -> Column:
    """Half open: [low, high)."""
    return _between(s.num(a), low, high)


def _distance(s: Scope, lon: float, lat: float) -> Column:
    return geo.haversine_km(s.num("lon"), s.num("lat"), float(lon), float(lat))


@predicate("WithinCirclePredicate")
def _within(s: Scope, lon: float, lat: float, r: float) -> Column:
    return _distance(s, lon, lat) < float(r)


@predicate("OutsideCirclePredicate")
def _outside(s: Scope, lon: float, lat: float, r: float) -> Column:
    return _distance(s, lon, lat) >= float(r)


@predicate("DistanceBetweenPredicate")
def _distance_between(s: Scope, lon: float, lat: float, inner: float, outer: float) -> Column:
    """Open: inner < distance < outer."""
    d = _distance(s, lon, lat)
    return (d > float(inner)) & (d < float(outer))


@predicate("HeadingTowardsPredicate")
def _heading_towards(s: Scope, region: str) -> Column:
    """Does the way of the next hour meet the region?"""
    lon, lat = s.num("lon"), s.num("lat")
    x, y = geo.project_point(lon, lat, 3600, s.num("speed"), s.num("heading"))
    return geo.segment_meets_ring((lon, lat, x, y), s.regions[region])


@predicate("TruePredicate")
def _true(s: Scope) -> Column:
    return F.lit(True)


@predicate("EpsilonPredicate")
def _epsilon(s: Scope) -> Column:
    """Consumes nothing: as a test of an event it never holds."""
    return F.lit(False)


for _name, _attr in {"SpeedBetween": "speed", "SpeedOneBetween": "speed1", "SpeedTwoBetween": "speed2", "AmountBetween": "amount", "Close": "dist"}.items():
    REGISTRY[_name] = lambda s, low, high, _attr=_attr: _between(s.num(_attr), low, high)
REGISTRY["HighSpeedPredicate"] = lambda s: s.num("speed") >= 20.0
REGISTRY["NormalSpeedPredicate"] = lambda s: s.num("speed") < 20.0
REGISTRY["MovingPredicate"] = lambda s: s.num("speed") >= 2.0
REGISTRY["StoppedPredicate"] = lambda s: s.num("speed") < 2.0


@predicate("IsHeadingPredicate")
def _is_heading(s: Scope, direction: str) -> Column:
    h = s.num("heading")
    full = {k[0]: v for k, v in HEADINGS.items()}
    if direction[0].upper() == "N":
        return (h >= 315.0) | (h < 45.0)
    return _between(h, *full[direction[0].upper()])


@predicate("IsDayPredicate")
def _is_day(s: Scope, day: float) -> Column:
    return s.num("day").cast("int") == int(float(day))


@predicate("IsHourPredicate")
def _is_hour(s: Scope, hour: float) -> Column:
    return s.num("hour").cast("int") == int(float(hour))


@predicate("IsTimePredicate")
def _is_time(s: Scope, part: str) -> Column:
    """Night is the hours from 0 to 6, so that it can hold."""
    a, b = HOURS[part]
    h = s.num("hour").cast("int")
    return (h >= a) & (h < b)


def _euclid(s: Scope) -> Column:
    return F.sqrt(F.pow(s.num("x1") - s.num("x2"), 2) + F.pow(s.num("y1") - s.num("y2"), 2))


REGISTRY["LT2D"] = lambda s, d: _euclid(s) < float(d)
REGISTRY["GTE2D"] = lambda s, d: _euclid(s) >= float(d)


def _pair_km(s: Scope) -> Column:
    return geo.haversine_km(s.num("lon1"), s.num("lat1"), s.num("lon2"), s.num("lat2"))


@predicate("VesselToVesselDistance")
def _pair_distance(s: Scope, low: float, high: float) -> Column:
    d = _pair_km(s)
    return (d > float(low)) & (d < float(high))


REGISTRY["VesselToVesselHeading"] = lambda s, low, high: _between(F.abs(s.num("heading1") - s.num("heading2")), low, high)
REGISTRY["VesselToVesselSpeed"] = lambda s, low, high: _between(F.abs(s.num("speed1") - s.num("speed2")), low, high)


@predicate("SimilarMovement")
def _similar_movement(s: Scope, km: float, knots: float, degrees: float) -> Column:
    d, a, b = _pair_km(s), s.num("speed1"), s.num("speed2")
    slow = (a > 1.2) & (a < 10.0) & (b > 1.2) & (b < 10.0)
    return slow & (d > 0.0) & (d < float(km)) & (F.abs(a - b) <= float(knots)) & (F.abs(s.num("heading1") - s.num("heading2")) <= float(degrees))


@predicate("SimilarGaze")
def _similar_gaze(s: Scope) -> Column:
    a, b = s.num("gaze1"), s.num("gaze2")
    return (a == -1) | (b == -1) | (F.abs(a - b) <= 45)


@predicate("HeadingVesselsToMeet")
def _meet(s: Scope, seconds: float) -> Column:
    way = []
    for k in "12":
        lon, lat = s.num(f"lon{k}"), s.num(f"lat{k}")
        way.append((lon, lat, *geo.project_point(lon, lat, float(seconds), s.num(f"speed{k}"), s.num(f"heading{k}"))))
    return geo.segments_meet(*way)


@predicate("DistToPolyPredicate")
def _to_polygon(s: Scope, inner: float, outer: float, region: str = "area") -> Column:
    d = geo.ring_distance(s.num("lon"), s.num("lat"), s.regions[region])
    return (d > float(inner)) & (d < float(outer))


@predicate("WithinPolygonPredicate")
def _in_polygon(s: Scope, region: str = "area") -> Column:
    return geo.in_polygon(s.num("lon"), s.num("lat"), s.regions[region])


@predicate("IsVesselType")
def _vessel_type(s: Scope, kind: str, attribute: str = "mmsi") -> Column:
    """Is the id in the named group? Groups are bounded constants; a large one is joined instead."""
    return s.text(attribute).isin(*s.groups[kind])


for _name, _attr in {"InPortPredicate": "within", "DFiveSevenPredicate": "d57", "DSevenTenPredicate": "d710"}.items():
    REGISTRY[_name] = lambda s, port, _attr=_attr: F.array_contains(F.transform(F.split(s.text(_attr), ","), lambda x: F.trim(x).try_cast("int")), int(float(port)))
for _name, _kind in {"DecGT": 2, "FlashGT": 4, "IncGT": 5}.items():
    REGISTRY[_name] = lambda s, _kind=_kind: (s.num("is_fraud") == 1) & (s.num("fraud_type") == _kind)
for _name, _attr in {"Interact": "interaction", "Join": "interaction", "Move": "interaction", "Split": "interaction", "MeetContext": "context", "MoveContext": "context"}.items():
    REGISTRY[_name] = lambda s, v=None, _attr=_attr, _name=_name: s.text(_attr) == str(v or _name.removesuffix("Context")).lower()
REGISTRY["Situation"] = lambda s, v: s.text("situation") == str(v)
REGISTRY["Context"] = lambda s, v: s.text("context") == str(v)
REGISTRY["IsConfigPredicate"] = lambda s, v: s.num("config") == float(v)


@predicate("EQML")
def _eqml(s: Scope, name: str, c: float) -> Column:
    """Numeric equality on an attribute given as a capitalised constant."""
    for n in (name[0].lower() + name[1:], snake(name)):
        if n in s.columns:
            return s.num(n) == float(c)
    raise ValueError(f"events have no attribute {name}")
