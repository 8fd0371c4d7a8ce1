"""Exchange formats: GPX text, JSON backups and share links, written and read with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import escape_html

#: fixed values: the alphabet of base64url
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
_GPX_SCHEMA = "trk struct<name:string, type:string, trkseg:struct<trkpt:array<struct<_lat:string,_lon:string,ele:string,time:string>>>>"


def gpx(fixes: DataFrame) -> DataFrame:
    """(ride_id, gpx): one document per ride; heights to a tenth where known, times in UTC to the millisecond."""
    time = F.concat(F.date_format(F.timestamp_millis("t_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    ele = F.when(F.col("altitude").isNotNull(), F.concat(F.lit("<ele>"), F.round("altitude", 1), F.lit("</ele>"))).otherwise("")
    point = F.concat(F.lit('<trkpt lat="'), F.col("lat"), F.lit('" lon="'), F.col("lng"), F.lit('">'), ele, F.lit("<time>"), time, F.lit("</time></trkpt>"))
    rows = fixes.select("ride_id", F.struct("seq", point.alias("p")).alias("x")).groupBy("ride_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    body = F.array_join(F.transform("x", lambda x: x.p), "\n")
    return rows.select("ride_id", F.concat(F.lit('<gpx version="1.1"><trk><trkseg>\n'), body, F.lit("\n</trkseg></trk></gpx>")).alias("gpx"))


def read_gpx(texts: DataFrame, id_col: str = "ride_id", text_col: str = "gpx") -> DataFrame:
    """Fixes of GPX texts; points without a position are dropped, text that is no XML gives none. Missing times
    take the one before, leading ones the first known."""
    parsed = texts.select(F.col(id_col).alias("ride_id"), F.from_xml(F.col(text_col), _GPX_SCHEMA, {"mode": "PERMISSIVE"}).alias("g"))
    p = parsed.select("ride_id", F.posexplode("g.trk.trkseg.trkpt").alias("seq", "p"))
    p = p.selectExpr("ride_id", "seq", "try_cast(p._lat AS double) AS lat", "try_cast(p._lon AS double) AS lng", "try_cast(p.ele AS double) AS altitude", "p.time AS time")
    p = p.where("lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180")
    w = Window.partitionBy("ride_id").orderBy("seq")
    t = F.unix_millis(F.try_to_timestamp("time"))
    known = F.coalesce(F.last(t, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(t, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    return p.select("ride_id", F.col("seq").cast("long").alias("seq"), "lat", "lng", "altitude", known.alias("t_ms"))


def backup(rides: DataFrame, per_file: str = "shard") -> DataFrame:
    """(shard, json): versioned backups, rides of a shard as an array."""
    row = F.struct(*[c for c in rides.columns if c != per_file])
    return rides.groupBy(per_file).agg(F.to_json(F.struct(F.lit(1).alias("version"), F.collect_list(row).alias("sessions"))).alias("json"))


def read_backup(texts: DataFrame, ride_schema: str) -> DataFrame:
    """Rides of backups of version 1; others, and damaged text, give none."""
    j = texts.select(F.from_json("json", f"version int, sessions array<struct<{ride_schema}>>").alias("j"))
    return j.where("j.version = 1").select(F.inline("j.sessions"))


def encode_numbers(numbers: Column) -> Column:
    """Signed integers as text: zigzag, five bits a character, low bits first, the sixth bit says more follow."""
    zigzag = lambda n: F.when(n < 0, -n * 2 - 1).otherwise(n * 2)
    groups = lambda z: F.when(z < 32, 1).when(z < 1024, 2).when(z < 32768, 3).when(z < 1048576, 4).when(z < 33554432, 5).otherwise(6)
    char = lambda z, i, k: F.lit(ALPHABET).substr((F.floor(z / F.pow(F.lit(32.0), i)) % 32 + F.when(i < k - 1, 32).otherwise(0) + 1).cast("int"), F.lit(1))
    one = lambda z: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.when(i < groups(z), char(z, i, groups(z))).otherwise("")), "")
    return F.array_join(F.transform(numbers, lambda n: one(zigzag(n.cast("long")))), "")


def decode_numbers(text: str) -> Column:
    """The integers of a text column; null if it holds other characters, ends within a number, or a number has
    over 30 bits."""
    fold = f"""aggregate(transform(split({text}, ''), c -> instr('{ALPHABET}', c) - 1),
        named_struct('z', 0L, 'at', 0, 'bad', false, 'out', cast(array() AS array<bigint>)),
        (acc, v) -> CASE
            WHEN acc.bad OR v < 0 OR acc.at > 25 THEN named_struct('z', 0L, 'at', 0, 'bad', true, 'out', acc.out)
            WHEN v >= 32 THEN named_struct('z', acc.z + shiftleft(cast(v - 32 AS bigint), acc.at), 'at', acc.at + 5, 'bad', false, 'out', acc.out)
            ELSE named_struct('z', 0L, 'at', 0, 'bad', false, 'out', array_append(acc.out, acc.z + shiftleft(cast(v AS bigint), acc.at))) END,
        acc -> IF(acc.bad OR acc.at > 0, NULL, transform(acc.out, z -> IF(z % 2 = 0, z div 2, -(z div 2) - 1))))"""
    return F.expr(fold)


def share_text(points: DataFrame) -> DataFrame:
    """(ride_id, link): rounded positions as deltas."""
    w = Window.partitionBy("ride_id").orderBy("seq")
    r = points.select("ride_id", "seq", F.floor(F.col("lat") * 1e5 + 0.5).cast("long").alias("y"), F.floor(F.col("lng") * 1e5 + 0.5).cast("long").alias("x"))
    r = r.withColumns({"dy": F.col("y") - F.coalesce(F.lag("y").over(w), F.lit(0)), "dx": F.col("x") - F.coalesce(F.lag("x").over(w), F.lit(0))})
    g = r.groupBy("ride_id").agg(F.array_sort(F.collect_list(F.struct("seq", "dy", "dx"))).alias("d"))
    return g.select("ride_id", F.concat(F.lit("#r1="), encode_numbers(F.flatten(F.transform("d", lambda p: F.array(p.dy, p.dx))))).alias("link"))


def read_share_text(links: DataFrame) -> DataFrame:
    """(ride_id, seq, lat, lng) of links; a damaged link, or one with fewer than two or over 100 points, gives none."""
    n = links.where(F.col("link").startswith("#r1=")).select("ride_id", decode_numbers("substring(link, 5)").alias("n"))
    n = n.where("size(n) % 2 = 0 AND size(n) BETWEEN 4 AND 200")
    pairs = n.select("ride_id", "n", F.explode(F.expr("sequence(0, size(n) div 2 - 1)")).alias("seq"))
    total = lambda off: F.expr(f"aggregate(filter(slice(n, 1, 2 * seq + 2), (v, i) -> i % 2 = {off}), 0L, (s, v) -> s + v)")
    p = pairs.select("ride_id", F.col("seq").cast("long").alias("seq"), (total(0) / 1e5).alias("lat"), (total(1) / 1e5).alias("lng"))
    return p.where("lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180")


def band_features(fixes: DataFrame, band: Column) -> DataFrame:
    """(ride_id, band, feature): per ride and band one GeoJSON feature of lines, one line for each run of fixes of that
    band with the fix before it. A ride's lines are one row, as they are one layer."""
    w = Window.partitionBy("ride_id").orderBy("seq")
    f = fixes.withColumns({"band": band, "plng": F.lag("lng").over(w), "plat": F.lag("lat").over(w)}).where("plng IS NOT NULL")
    new = F.coalesce((~F.col("band").eqNullSafe(F.lag("band").over(w))).cast("int"), F.lit(1))
    f = f.withColumn("run", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda lng, lat: F.concat(F.lit("["), lng, F.lit(","), lat, F.lit("]"))
    rows = f.groupBy("ride_id", "band", "run").agg(F.array_sort(F.collect_list(F.struct("seq", at(F.col("plng"), F.col("plat")).alias("before"), at(F.col("lng"), F.col("lat")).alias("here")))).alias("x"))
    line = F.concat(F.lit("["), F.element_at("x", 1).before, F.lit(","), F.array_join(F.transform("x", lambda x: x.here), ","), F.lit("]"))
    lines = rows.groupBy("ride_id", "band").agg(F.array_sort(F.collect_list(F.struct("run", line.alias("line")))).alias("x"))
    body = F.array_join(F.transform("x", lambda x: x.line), ",")
    return lines.select("ride_id", "band", F.concat(F.lit('{"type":"Feature","properties":{"band":'), "band", F.lit('},"geometry":{"type":"MultiLineString","coordinates":['), body, F.lit("]}}")).alias("feature"))


#: fixed values: the types of turn cues in GPX texts
TURN_TYPES = ("left", "right", "slight left", "slight right", "sharp left", "sharp right", "u turn")
_ROUTE_SCHEMA = "wpt array<struct<_lat:string,_lon:string,name:string,type:string>>, rte struct<rtept:array<struct<_lat:string,_lon:string,name:string>>>, trk struct<trkseg:struct<trkpt:array<struct<_lat:string,_lon:string>>>>"


def route_gpx(points: DataFrame, marks: DataFrame) -> DataFrame:
    """(route_id, gpx): routes' points (route_id, seq, lat, lng) as one track, marks (route_id, i, lat, lng, name, type)
    as waypoints before it; six decimals. A route's text is one row."""
    place = F.concat(F.lit(' lat="'), F.format_string("%.6f", "lat"), F.lit('" lon="'), F.format_string("%.6f", "lng"), F.lit('"'))
    text = lambda tag, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"<{tag}>"), escape_html(F.col(c)), F.lit(f"</{tag}>"))).otherwise("")
    wpt = marks.select("route_id", F.lit(0).alias("o"), F.col("i").cast("long").alias("k"), F.concat(F.lit("<wpt"), place, F.lit(">"), text("name", "name"), text("type", "type"), F.lit("</wpt>")).alias("t"))
    trk = points.select("route_id", F.lit(1).alias("o"), F.col("seq").cast("long").alias("k"), F.concat(F.lit("<trkpt"), place, F.lit("></trkpt>")).alias("t"))
    rows = wpt.unionByName(trk).groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("o", "k", "t"))).alias("x"))
    part = lambda o: F.array_join(F.transform(F.filter("x", lambda x: x.o == o), lambda x: x.t), "\n")
    return rows.select("route_id", F.concat(F.lit('<gpx version="1.1" creator="wayline" xmlns="http://www.topografix.com/GPX/1/1">\n'), part(0), F.lit("\n<trk><trkseg>\n"), part(1), F.lit("\n</trkseg></trk></gpx>")).alias("gpx"))


def read_route_gpx(texts: DataFrame, id_col: str = "route_id", text_col: str = "gpx") -> DataFrame:
    """(route_id, what, i, lat, lng, name) of GPX texts: `track` points where there are two or more; `point`s of the
    route element where there are two or more, else, without a track, waypoints; `place`s, with a track: waypoints.
    Turn cues are neither. Points without a position go; text that is no XML gives no row."""
    g = texts.select(F.col(id_col).alias("route_id"), F.from_xml(F.col(text_col), _ROUTE_SCHEMA, {"mode": "PERMISSIVE"}).alias("g"))
    at = lambda c, name: F.expr(f"transform(filter(coalesce({c}, array()), x -> try_cast(x._lat AS double) BETWEEN -90 AND 90 AND try_cast(x._lon AS double) BETWEEN -180 AND 180), x -> named_struct('lat', try_cast(x._lat AS double), 'lng', try_cast(x._lon AS double), 'name', {name}))")
    cues = ", ".join(f"'{t}'" for t in TURN_TYPES)
    own = f"filter(coalesce(g.wpt, array()), x -> NOT coalesce(lower(trim(x.type)) IN ({cues}), false))"
    g = g.select("route_id", at("g.trk.trkseg.trkpt", "string(NULL)").alias("track"), at("g.rte.rtept", "x.name").alias("rte"), at(own, "x.name").alias("wpt"))
    drawn = F.size("track") >= 2
    none = F.slice("wpt", 1, 0)
    parts = {"track": F.when(drawn, F.col("track")).otherwise(none), "point": F.when(F.size("rte") >= 2, F.col("rte")).when(~drawn, F.col("wpt")).otherwise(none), "place": F.when(drawn, F.col("wpt")).otherwise(none)}
    rows = [g.select("route_id", F.lit(what).alias("what"), F.posexplode(c).alias("i", "p")).select("route_id", "what", "i", "p.*") for what, c in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
