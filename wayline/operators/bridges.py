"""Paths that end just short of another way, joined to it."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import in_order
from .graph import written

_LANDS = "p bigint, edge bigint, t double, x double, y double, meters double, level int"


def landings(edges: DataFrame, reach: float = 25.0, own: float = 50.0, side: float = 64.0) -> DataFrame:
    """Where the dead ends of paths land: (p, edge, t, x, y, meters, level), p the node, t the share of the edge from a.

    edges (edge, a, b, meters, ax, ay, bx, by, path, level). A path's end that no other edge meets looks for the nearest
    point, within `reach`, of a way on its level that it does not reach along the network within `own` metres: neither
    of the way's ends may be that near. Of ways as near the one with the least name. All ends look at the network as it
    was. Each end is met by cells with the edges that lie within `own`, and a task searches one end's edges.
    """
    e = edges.dropna(subset=["a", "b", "meters", "ax", "ay", "bx", "by"]).withColumns({"level": F.coalesce("level", F.lit(0)).cast("int"), "path": F.coalesce("path", F.lit(False))})
    ends = e.select(F.col("a").alias("p"), F.col("ax").alias("px"), F.col("ay").alias("py"), "path", "level").unionByName(e.select(F.col("b").alias("p"), F.col("bx").alias("px"), F.col("by").alias("py"), "path", "level"))
    dead = ends.groupBy("p").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("px", "py", "path", "level")]).where("n = 1 AND path").drop("n", "path")
    low = lambda c: F.floor((F.col(f"p{c}") - own) / side)
    cells = lambda c: F.explode(F.sequence(low(c), F.floor((F.col(f"p{c}") + own) / side)))
    asked = dead.withColumn("cx", cells("x")).withColumn("cy", cells("y"))
    span = lambda c: F.explode(F.sequence(F.floor(F.least(f"a{c}", f"b{c}") / side), F.floor(F.greatest(f"a{c}", f"b{c}") / side)))
    there = e.withColumn("cx", span("x")).withColumn("cy", span("y")).drop("path").withColumnRenamed("level", "of_level")
    first = lambda c: F.greatest(F.floor(F.least(f"a{c}", f"b{c}") / side), low(c)) == F.col(f"c{c}")
    # of use are edges that a walk of `own` metres from the end may take, and those of its level that it may land on
    far = lambda n: F.hypot(F.col(f"{n}x") - F.col("px"), F.col(f"{n}y") - F.col("py"))
    close = lambda c: (F.col(f"p{c}") >= F.least(f"a{c}", f"b{c}") - reach * 1.001) & (F.col(f"p{c}") <= F.greatest(f"a{c}", f"b{c}") + reach * 1.001)
    walked = F.least(far("a"), far("b")) + F.col("meters") <= own * 1.001
    met = asked.join(there, ["cx", "cy"]).where(first("x") & first("y") & (walked | ((F.col("of_level") == F.col("level")) & close("x") & close("y"))))
    columns = ["p", "px", "py", "level", "edge", "a", "b", "meters", "ax", "ay", "bx", "by", "of_level"]

    def search(p: int, rows: list[tuple]) -> list[dict]:
        px, py, level = rows[0][:3]
        near: dict[int, list[tuple[int, float]]] = {}
        for _, _, _, _, a, b, meters, *_ in rows:
            near.setdefault(a, []).append((b, meters))
            near.setdefault(b, []).append((a, meters))
        seen, heap = set(), [(0.0, p)]
        while heap:
            cost, node = heapq.heappop(heap)
            if node not in seen:
                seen.add(node)
                for to, meters in near.get(node, ()):
                    if cost + meters <= own:
                        heapq.heappush(heap, (cost + meters, to))
        best = None
        for _, _, _, edge, a, b, _, ax, ay, bx, by, of_level in rows:
            if of_level != level or a in seen or b in seen:
                continue
            dx, dy = bx - ax, by - ay
            size = dx * dx + dy * dy
            t = max(0.0, min(1.0, ((px - ax) * dx + (py - ay) * dy) / size)) if size else 0.0
            x, y = ax + dx * t, ay + dy * t
            d = ((px - x) ** 2 + (py - y) ** 2) ** 0.5
            if d <= reach and (best is None or (round(d, 9), edge) < (round(best["meters"], 9), best["edge"])):
                best = {"p": p, "edge": edge, "t": t, "x": x, "y": y, "meters": d, "level": level}
        return [best] if best else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_p, held = None, []
        for b in batches:
            out = []
            for p, *row in zip(*[b.column(c).to_pylist() for c in columns]):
                if p != own_p and held:
                    out += search(own_p, held)
                    held = []
                own_p = p
                held.append(tuple(row))
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
        yield pa.RecordBatch.from_pylist(search(own_p, held) if held else [], schema=_ARROW)

    return in_order(met.select(*columns), "p", "edge").mapInArrow(run, _LANDS)


_ARROW = pa.schema([(c.split()[0], {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}[c.split()[1]]) for c in _LANDS.split(", ")])


def bridged(edges: DataFrame, reach: float = 25.0, own: float = 50.0, snap: float = 1.0, factor: float = 3.0) -> DataFrame:
    """The network with its gaps joined: (edge, piece, a, b, meters, factor, ax, ay, bx, by).

    Every landing splits the edge it lies on, unless it is within `snap` metres of an end, which it then takes;
    landings that close to one another are one place. Joins have no edge and cost `factor` times their length. Ends are
    named 2 n for node n of the input, and 2 p + 1 for the place on an edge where the join of node p lands first. Two ends
    that land on each other make one join. Edges with a null end, length or position go.
    """
    e = edges.dropna(subset=["a", "b", "meters", "ax", "ay", "bx", "by"]).select("edge", "a", "b", "meters", "ax", "ay", "bx", "by")
    land = written(landings(edges, reach, own).drop("level"))
    spot = land.withColumnRenamed("meters", "gap").join(e, "edge")
    to_a, to_b = F.hypot(F.col("x") - F.col("ax"), F.col("y") - F.col("ay")), F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by"))
    spot = spot.withColumn("node", F.when(to_a <= snap, F.col("a") * 2).when(to_b <= snap, F.col("b") * 2))
    spot = spot.withColumns({c: F.when(F.col("node") == F.col("a") * 2, F.col(f"a{c}")).when(F.col("node") == F.col("b") * 2, F.col(f"b{c}")).otherwise(F.col(c)) for c in "xy"})
    w = Window.partitionBy("edge").orderBy("t", "p")
    inner = spot.where("node IS NULL").withColumn("new", F.coalesce((F.col("t") - F.lag("t").over(w)) * F.col("meters") > snap, F.lit(True)))
    inner = inner.withColumn("place", F.sum(F.col("new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    of_place = Window.partitionBy("edge", "place").orderBy("t", "p")
    inner = inner.withColumns({"node": F.first("p").over(of_place) * 2 + 1, "at": F.first("t").over(of_place), "x": F.first("x").over(of_place), "y": F.first("y").over(of_place)})
    points = e.select("edge", F.col("a").alias("_a"), F.col("b").alias("_b"), "meters", "ax", "ay", "bx", "by")
    cuts = points.select("edge", "meters", F.explode(F.array(F.struct(F.lit(0.0).alias("at"), (F.col("_a") * 2).alias("node"), F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.lit(1.0).alias("at"), (F.col("_b") * 2).alias("node"), F.col("bx").alias("x"), F.col("by").alias("y")))).alias("c")).select("edge", "meters", "c.*")
    cuts = cuts.unionByName(inner.select("edge", "meters", "at", "node", "x", "y").distinct())
    v = Window.partitionBy("edge").orderBy("at", F.col("node") % 2 == 0)
    lead = lambda c: F.lead(c).over(v)
    pieces = cuts.select("edge", (F.row_number().over(v) - 1).cast("bigint").alias("piece"), F.col("node").alias("a"), lead("node").alias("b"), ((lead("at") - F.col("at")) * F.col("meters")).alias("meters"), F.lit(1.0).alias("factor"), F.col("x").alias("ax"), F.col("y").alias("ay"), lead("x").alias("bx"), lead("y").alias("by")).where("b IS NOT NULL")
    ends = places(e)
    joins = inner.select("p", "node", "x", "y").unionByName(spot.where("node IS NOT NULL").select("p", "node", "x", "y")).join(ends, "p").where(F.col("node") != F.col("p") * 2)
    joins = joins.select((F.col("p") * 2).alias("p"), "node", F.struct(F.col("px").alias("x"), F.col("py").alias("y")).alias("s"), F.struct("x", "y").alias("t"))
    flip = F.col("p") > F.col("node")
    joins = joins.select(F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b"), F.when(flip, F.col("t")).otherwise(F.col("s")).alias("s"), F.when(flip, F.col("s")).otherwise(F.col("t")).alias("t")).dropDuplicates(["a", "b"])
    links = joins.select(F.lit(None).cast("bigint").alias("edge"), F.lit(0).cast("bigint").alias("piece"), "a", "b", F.hypot(F.col("t.x") - F.col("s.x"), F.col("t.y") - F.col("s.y")).alias("meters"), F.lit(float(factor)).alias("factor"), F.col("s.x").alias("ax"), F.col("s.y").alias("ay"), F.col("t.x").alias("bx"), F.col("t.y").alias("by"))
    return pieces.unionByName(links)


def places(edges: DataFrame) -> DataFrame:
    """Where every node lies: (p, px, py)."""
    both = edges.select(F.col("a").alias("p"), F.col("ax").alias("px"), F.col("ay").alias("py")).unionByName(edges.select(F.col("b").alias("p"), F.col("bx").alias("px"), F.col("by").alias("py")))
    return both.groupBy("p").agg(F.min("px").alias("px"), F.min("py").alias("py"))
