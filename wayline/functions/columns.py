"""Column helpers: number rules of the trip model, geometry on the sphere and on the flat, labels and scales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
M_PER_MILE, M_PER_KM = 1609.344, 1000.0


def dbl(x) -> Column:
    return F.lit(float(x))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def or_default(c: Column, default: str) -> Column:
    """The default for null and empty text."""
    return F.coalesce(F.when(c != "", c), F.lit(default))


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def ratio(a: Column, b: Column, default=0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), dbl(default) if default is not None else F.lit(None).cast("double"))


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.atan2(F.sqrt(a), F.sqrt(1 - a)) * (2 * EARTH_M)


def bearing(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    d = F.radians(lng2 - lng1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, dbl(360))


def flat_distance(lat1: Column, lng1: Column, lat2: Column, lng2: Column, per_lat: float = 110574.0, per_lng: float = 111320.0) -> Column:
    return F.hypot((lat2 - lat1) * per_lat, (lng2 - lng1) * per_lng * F.cos(F.radians((lat1 + lat2) / 2)))


def flat_bearing(lat1: Column, lng1: Column, lat2: Column, lng2: Column, per_lat: float = 110574.0, per_lng: float = 111320.0) -> Column:
    return F.pmod(F.degrees(F.atan2((lng2 - lng1) * per_lng * F.cos(F.radians((lat1 + lat2) / 2)), (lat2 - lat1) * per_lat)) + 360, dbl(360))


def angle_between(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), dbl(360))
    return F.least(d, 360 - d)


def mercator(lng: Column, lat: Column, zoom: int = 14, extent: int = 4096) -> tuple[Column, Column]:
    size = float((1 << zoom) * extent)
    r = F.radians(lat)
    return (lng + 180) / 360 * size, (1 - F.ln(F.tan(r) + 1 / F.cos(r)) / dbl(3.141592653589793)) / 2 * size


def mercator_inverse(x: Column, y: Column, zoom: int = 14, extent: int = 4096) -> tuple[Column, Column]:
    size = float((1 << zoom) * extent)
    return x / size * 360 - 180, F.degrees(F.atan(F.sinh((1 - y / size * 2) * 3.141592653589793)))


def cell(lat: Column, lng: Column, meters: float) -> tuple[Column, Column]:
    """Grid cell of a side in metres, as two join keys."""
    return F.floor(lat * 110574.0 / meters), F.floor(lng * 111320.0 * F.cos(F.radians(lat)) / meters)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    u = F.greatest(dbl(0), F.least(dbl(1), ratio((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy)))
    return F.hypot(px - (ax + u * dx), py - (ay + u * dy))


def speed_band(v: Column, top: Column, bands: int = 16) -> Column:
    return F.least(F.lit(bands - 1), F.floor(F.greatest(dbl(0), F.least(dbl(1), ratio(v, top))) * bands)).cast("int")


def scale(v: Column, low: Column, high: Column) -> Column:
    """0..1 between low and high, 0.5 where they are equal."""
    return F.when(high > low, (v - low) / (high - low)).otherwise(dbl(0.5))


def duration_minutes(ms: Column) -> Column:
    m = half_up(ms / 60000)
    h, r = F.floor(m / 60), m % 60
    return F.when(m < 1, "<1m").when(h < 1, F.concat(m, F.lit("m"))).when(r == 0, F.concat(h, F.lit("h"))).otherwise(F.concat(h, F.lit("h "), r, F.lit("m")))


def clock(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    two = lambda c: F.when(c < 10, F.concat(F.lit("0"), c)).otherwise(c.cast("string"))
    h = F.floor(s / 3600)
    tail = F.concat(two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60))
    return F.when(h > 0, F.concat(two(h), F.lit(":"), tail)).otherwise(tail)


def one_decimal(x: Column) -> Column:
    """A text with one decimal, rounded from the exact binary value, ties up: ten times x as a sum of two exact terms
    and what their sum lost."""
    big, small = x * 8, x * 2
    total = big + small
    lost = (big - (total - (total - big))) + (small - (total - big))
    part = total - F.floor(total)
    tenth = F.floor(total) + F.when((part > 0.5) | ((part == 0.5) & (lost >= 0)), 1).otherwise(0)
    return F.concat(F.floor(tenth / 10).cast("string"), F.lit("."), F.pmod(tenth, F.lit(10)).cast("string"))


def guidance_distance(m: Column, imperial: bool = False) -> Column:
    """Guidance text: to 10 when close (below 100 ft or 200 m), to 50 up to 1000 as rounded, then miles or kilometres
    to a tenth below ten."""
    m = F.greatest(dbl(0), m)
    unit, fine, short, long, per_long = (m * 3.28084, 100, " ft", " mi", M_PER_MILE) if imperial else (m, 200, " m", " km", M_PER_KM)
    near = F.when(unit < fine, half_up(unit / 10) * 10).otherwise(half_up(unit / 50) * 50)
    far = m / per_long
    return F.when(near < 1000, F.concat(near.cast("long").cast("string"), F.lit(short))).when(far < 10, F.concat(one_decimal(far), F.lit(long))).otherwise(F.concat(half_up(far).cast("long").cast("string"), F.lit(long)))


#: fixed values: the slow-to-fast ramp, and the bands of a grade with their colours
PACE_STOPS = ("e05a3a", "e07a3a", "e0a63a", "c9d63a", "8fc93a", "2f9c4f")
GRADE_COLOURS = ((0.02, "#2f9c4f"), (0.05, "#a3c23a"), (0.08, "#e0a63a"), (0.12, "#e05a3a"), (float("inf"), "#8e2a5e"))


def pace_colour(t: Column) -> Column:
    """The ramp's colour at 0 (slow) .. 1 (fast), blended between two stops; what is no number is the middle."""
    t = F.when(t.isNull() | F.isnan(t) | (F.abs(t) == float("inf")), dbl(0.5)).otherwise(F.greatest(dbl(0), F.least(dbl(1), t)))
    at = t * (len(PACE_STOPS) - 1)
    i = F.least(F.lit(len(PACE_STOPS) - 2), F.floor(at)).cast("int")
    channel = lambda k: F.array(*[F.lit(int(c[2 * k : 2 * k + 2], 16)) for c in PACE_STOPS])
    blend = lambda k: half_up(F.element_at(channel(k), i + 1) + (F.element_at(channel(k), i + 2) - F.element_at(channel(k), i + 1)) * (at - i)).cast("long").cast("string")
    return F.concat(F.lit("rgb("), blend(0), F.lit(", "), blend(1), F.lit(", "), blend(2), F.lit(")"))


def grade_colour(grade: Column) -> Column:
    out = F.when(F.abs(grade) < GRADE_COLOURS[0][0], GRADE_COLOURS[0][1])
    for top, colour in GRADE_COLOURS[1:]:
        out = out.when(F.abs(grade) < top, colour)
    return out


#: fixed values: what a ride of an activity is called
NOUNS = {"bike": "ride", "walk": "walk", "hike": "hike", "kayak": "paddle"}


def ride_title(part: Column, activity: Column) -> Column:
    """"Morning walk", "All-day hike", "Ride" without a part of the day."""
    kind = F.coalesce(F.nullif(activity, F.lit("")), F.lit("bike"))
    noun = F.lit("ride")
    for k, n in NOUNS.items():
        noun = F.when(kind == k, n).otherwise(noun)
    word = F.when(part == "All day", "All-day").otherwise(part)
    return F.when(F.coalesce(word, F.lit("")) == "", F.initcap(noun)).otherwise(F.concat(word, F.lit(" "), noun))


def ride_row_title(day: Column, part: Column, activity: Column) -> Column:
    """"Aug 26 · Morning walk"; a bike ride's part of the day stands alone."""
    kind = F.coalesce(F.nullif(activity, F.lit("")), F.lit("bike"))
    tail = F.when(kind == "bike", part).otherwise(ride_title(part, kind))
    return F.concat(F.coalesce(F.date_format(day, "MMM d"), F.lit("Unknown date")), F.when(F.coalesce(tail, F.lit("")) == "", "").otherwise(F.concat(F.lit(" · "), tail)))


def escape_html(c: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def slug(c: Column) -> Column:
    """A file name's slug: whatever is no letter or digit of ASCII is a hyphen, none at the ends; "route" for nothing."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("route"))


def infer_activity(c: Column) -> Column:
    t = F.lower(F.coalesce(c, F.lit("")))
    has = lambda *words: F.greatest(*[t.contains(w) for w in words], F.lit(False))
    return F.when(t.contains("hik"), "hike").when(has("kayak", "paddle", "canoe"), "kayak").when(has("run", "walk"), "walk").otherwise("bike")


def day_part(start: Column, end: Column) -> Column:
    across = (F.to_date(start) != F.to_date(end)) | ((F.hour(start) < 12) & (F.hour(end) >= 12))
    return F.when(across, "All day").when(F.hour(start) < 12, "Morning").when(F.hour(start) < 17, "Afternoon").otherwise("Evening")
