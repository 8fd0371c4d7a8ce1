"""Edits of planned routes: a log of edits applied to ordered lists, one route after the other."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import in_order

MOST_PLACES = 50  # fixed value
_OUT = "route_id bigint, kind string, i bigint, lat double, lng double, icon string, title string, leg bigint, anew boolean"
_ARROW = pa.schema([(c.split()[0], {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}[c.split()[1]]) for c in _OUT.split(", ")])
_ROW = ["n", "op", "at", "lat", "lng", "icon", "title"]


class Route:
    """A route's waypoints, the legs between them and its places. A leg is the number of the stored leg it still is, or
    None where it has to be routed anew."""

    def __init__(self) -> None:
        self.points: list[tuple] = []
        self.legs: list[int | None] = []
        self.places: list[tuple] = []

    def apply(self, op: str, at: int | None, spot: tuple, mark: tuple) -> None:
        points, legs, places = self.points, self.legs, self.places
        inside = lambda xs: at is not None and 0 <= at < len(xs)
        if op == "stored":
            points.append(spot)
            if len(points) > 1:
                legs.append(len(legs))
        elif op == "append":
            points.append(spot)
            if len(points) > 1:
                legs.append(None)
        elif op == "move" and inside(points):
            points[at] = spot
            for k in (at - 1, at):
                if 0 <= k < len(legs):
                    legs[k] = None
        elif op == "insert" and inside(legs):
            points.insert(at + 1, spot)
            legs[at : at + 1] = [None, None]
        elif op == "remove" and inside(points):
            last = at == len(points) - 1
            del points[at]
            if at and not last:
                legs[at - 1 : at + 1] = [None]
            elif legs:
                del legs[-1 if at else 0]
        elif op == "add_place" and len(places) < MOST_PLACES:
            places.append((*spot, None, ""))
        elif op == "move_place" and inside(places):
            places[at] = (*spot, *places[at][2:])
        elif op == "mark_place" and inside(places):
            places[at] = (*places[at][:2], mark[0], mark[1] or "")
        elif op == "remove_place" and inside(places):
            del places[at]

    def rows(self, route_id: int) -> list[tuple]:
        legs = [*self.legs, None]
        out = [(route_id, "waypoint", i, *p, None, None, legs[i], legs[i] is None and i < len(self.legs)) for i, p in enumerate(self.points)]
        return out + [(route_id, "place", i, *p, None, False) for i, p in enumerate(self.places)]


def edited(stored: DataFrame, edits: DataFrame) -> DataFrame:
    """Routes after their edits: (route_id, kind, i, lat, lng, icon, title, leg, anew), a row for each waypoint and place.

    stored (route_id, i, lat, lng) are the waypoints as saved. edits (route_id, n, op, at, lat, lng, icon, title) are applied
    in the order of n: append, move, insert (into leg `at`) and remove waypoints; add_place, move_place, mark_place and
    remove_place. An edit that names a position that is not there, another op, or no place where one is needed changes
    nothing, nor does a place beyond the fiftieth. A waypoint's row has the stored leg that begins there, or `anew` where
    that leg must be routed: only those next to an edit. A task holds one route's lists.
    """
    none = lambda kind: F.lit(None).cast(kind)
    s = stored.dropna(subset=["route_id", "i", "lat", "lng"]).select("route_id", F.lit(0).alias("later"), F.col("i").cast("bigint").alias("n"), F.lit("stored").alias("op"), none("bigint").alias("at"), "lat", "lng", none("string").alias("icon"), none("string").alias("title"))
    placed = F.col("op").isin("remove", "mark_place", "remove_place") | (F.col("lat").isNotNull() & F.col("lng").isNotNull())
    e = edits.dropna(subset=["route_id", "n", "op"]).where(placed & (F.col("op") != "stored"))
    rows = s.unionByName(e.select("route_id", F.lit(1).alias("later"), F.col("n").cast("bigint").alias("n"), "op", F.col("at").cast("bigint").alias("at"), "lat", "lng", "icon", "title"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, route = None, Route()
        cols = lambda out: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [()] * len(_ARROW), _ARROW)], schema=_ARROW)
        for b in batches:
            out = []
            for route_id, _, op, at, lat, lng, icon, title in zip(*[b.column(c).to_pylist() for c in ("route_id", *_ROW)]):
                if route_id != own:
                    out += route.rows(own)
                    own, route = route_id, Route()
                route.apply(op, at, (lat, lng), (icon, title))
            yield cols(out)
        yield cols(route.rows(own))

    return in_order(rows, "route_id", "later", "n").mapInArrow(run, _OUT)
