"""Hand-encoded tiles."""

from wayline.operators import spatial
from wayline.sources import tiles


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def zigzag(n):
    return n * 2 if n >= 0 else -n * 2 - 1


def packed(*numbers):
    return b"".join(map(varint, numbers))


def tile():
    line = packed(1 << 3 | 1, zigzag(2), zigzag(3), 2 << 3 | 2, zigzag(5), zigzag(0), zigzag(0), zigzag(-4), 1 << 3 | 1, zigzag(1), zigzag(1), 1 << 3 | 2, zigzag(1), zigzag(1), 1 << 3 | 1, zigzag(9), zigzag(9))
    feature = field(2, packed(0, 1, 1, 0)) + field(3, 2) + field(4, line)
    point = field(3, 1) + field(4, packed(9, 2, 2))
    layer = field(1, b"roads") + field(2, feature) + field(2, point) + field(3, b"class") + field(3, b"lanes") + field(4, field(5, 3)) + field(4, field(1, b"path"))
    return field(3, field(1, b"water")) + field(3, layer)


def test_line_features(spark):
    rows = [(1, 2, tile()), (1, 3, b"\xff\xff"), (1, 4, None), (1, 5, b"")]
    got = tiles.decode_lines(spark.createDataFrame(rows, "x long, y long, data binary"), "roads").collect()
    assert [(r.x, r.y, r.line, [tuple(c) for c in r.coords]) for r in got] == [(1, 2, 0, [(2, 3), (7, 3), (7, -1)]), (1, 2, 1, [(8, 0), (9, 1)])]
    assert got[0].props == {"class": "path", "lanes": "3"}


def test_terrain_and_bilinear_heights(spark):
    data = b"".join(bytes([0, i, 128]) for i in range(16))
    h = tiles.terrain_heights(spark.createDataFrame([(0, 0, data), (1, 0, b"short"), (2, 0, None)], "x long, y long, data binary"), 4)
    assert h.count() == 16
    p = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 1.25), (3, 3.5, 0.0)], "id long, px double, py double")
    assert {r.id: r.height for r in spatial.bilinear(p, h).collect()} == {1: 2.5, 2: 7.0, 3: None}


def test_lines_written_and_read_back(spark, tmp_path):
    import random

    rng = random.Random(5)
    rows = []
    for x in (0, 5, 40):
        for y in range(3):
            for feature in range(rng.randrange(4)):
                props = {"class": rng.choice(["path", "minor", "tertiär"]), "lanes": str(rng.randrange(3))} if feature else {}
                rows += [(x, y, feature, line, props, [(rng.randrange(-50, 5000), rng.randrange(-50, 5000)) for _ in range(rng.randrange(2, 6))]) for line in range(rng.randrange(1, 3))]
    schema = "x long, y long, feature long, line long, props map<string,string>, coords array<struct<x:long,y:long>>"
    lines = spark.createDataFrame([*rows, (None, 1, 0, 0, {}, [(1, 1), (2, 2)])], schema)
    made = tiles.line_tiles(lines, "roads")
    plain = lambda df: sorted((r.x, r.y, r.feature, r.line, tuple(sorted(r.props.items())), tuple(map(tuple, r.coords))) for r in df.collect())
    want = sorted((*r[:4], tuple(sorted(r[4].items())), tuple(r[5])) for r in rows)
    assert plain(tiles.decode_lines(made, "roads")) == want
    assert tiles.decode_lines(made, "water").collect() == []
    for zoom in (13, 14):
        tiles.store(made, str(tmp_path), zoom)
    some = tiles.stored(spark.read.parquet(str(tmp_path)), 14, 0, 5, 1, 2)
    assert plain(tiles.decode_lines(some, "roads")) == [r for r in want if r[0] <= 5 and 1 <= r[1] <= 2]
    plan = some._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(zoom" in plan and "GreaterThanOrEqual(y," in plan


def test_heights_written_and_read_back(spark):
    h = [(x, y, (x * 7 + y * 3) % 50 / 4 - 20) for x in range(-4, 8) for y in range(4)]
    lacking = [(8, 0, 1.0), (9, 1, None), (None, 1, 1.0)]
    made = tiles.terrain_tiles(spark.createDataFrame([*h, *lacking, (0, 0, h[16][2])], "gx long, gy long, height double"), 4)
    assert sorted(tuple(r) for r in tiles.terrain_heights(made, 4).collect()) == sorted(h)


def test_lines_are_handed_on_in_parts(spark, monkeypatch):
    """A whole batch of tiles was one frame of lines; a tile of many lines is handed on in parts too."""
    monkeypatch.setattr(tiles, "LINES_AT_ONCE", 10)
    rows = [(x, y, f, 0, {"n": str(f)}, [{"x": f, "y": x}, {"x": f + 1, "y": y}]) for x in (0, 1) for y in range(5) for f in range(13)]
    df = spark.createDataFrame(rows, "x long, y long, feature long, line long, props map<string,string>, coords array<struct<x:long,y:long>>")
    stored = tiles.line_tiles(df, "roads")
    assert stored.count() == 10
    sizes = []
    whole = tiles._lines
    monkeypatch.setattr(tiles, "_lines", lambda rows: (sizes.append(len(rows)), whole(rows))[1])
    spy = type("Tiles", (), {"select": lambda self, *c: self, "mapInArrow": lambda self, run, schema: list(run(iter(stored.toArrow().to_batches())))})()
    parts = tiles.decode_lines(spy, "roads")
    assert sum(p.num_rows for p in parts) == 130 and max(sizes) <= 13 and len(sizes) > 10
    got = sorted((r.x, r.y, r.feature, r.line, r.props["n"], [tuple(c) for c in r.coords]) for r in tiles.decode_lines(stored, "roads").collect())
    assert got == sorted((x, y, f, i, p["n"], [(c["x"], c["y"]) for c in cs]) for x, y, f, i, p, cs in rows)


def test_rows_of_a_block_are_written_by_many_tasks(spark, tmp_path):
    t = spark.range(2000).selectExpr("id % 2 AS x", "id AS y", "unhex('00') AS data")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tiles.store(t, str(tmp_path / "t"), 9)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "t" / "zoom=9" / "block=0").glob("*.parquet"))) > 1
    assert tiles.stored(spark.read.parquet(str(tmp_path / "t")), 9, 0, 1, 100, 199).count() == 100
