"""Tiles written from the tables, stored by zoom and column, and read back from a box, with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import tiles as T
from ..sources.lenses import STREETS_SQL, _hash32, read, streets
from ..sources.shared import shared_dir

SIDE = 512  # metres of a tile


def vector_tiles(spark, d):
    """Streets as features of the tile that holds their first end; tiles of the western half are read."""
    e = streets(spark, d)
    cell = lambda c: F.floor(F.col(c) / SIDE)
    spot = lambda p: F.struct((F.col(f"{p}x") - cell("ax") * SIDE).cast("long").alias("x"), (F.col(f"{p}y") - cell("ay") * SIDE).cast("long").alias("y"))
    props = F.create_map(F.lit("class"), F.when(F.col("path"), "path").otherwise("minor"), F.lit("rank"), F.col("rank").cast("string"), F.lit("edge"), F.col("edge").cast("string"))
    rows = e.select((cell("ax") + 4).alias("x"), (cell("ay") + 4).alias("y"), F.col("edge").alias("feature"), F.lit(0).cast("long").alias("line"), props.alias("props"), F.array(spot("a"), spot("b")).alias("coords"))
    path = f"{shared_dir(spark)}/tiles-{uuid.uuid4().hex}"
    T.store(T.line_tiles(rows, "transportation"), path, 14)
    T.store(T.line_tiles(rows.where("x = 0"), "transportation"), path, 13)
    found = T.decode_lines(T.stored(spark.read.parquet(path), 14, 0, 3, 0, 1 << 20), "transportation")
    at = lambda i, c: F.element_at("coords", i).getField(c)
    return found.select("x", "y", F.col("props")["edge"].cast("long").alias("edge"), F.col("props")["class"].alias("class"), F.col("props")["rank"].alias("rank"), at(1, "x").alias("ax"), at(1, "y").alias("ay"), at(2, "x").alias("bx"), at(2, "y").alias("by_"))


def terrain_tiles(spark, d):
    """Orders as heights of a raster 64 wide, in tiles of 16; those of the second column of tiles are read."""
    o = read(spark, d, "orders").select((F.col("o_orderkey") % 64).alias("gx"), F.expr("o_orderkey div 64").alias("gy"), (_hash32(F.col("o_orderkey")) % 100000 / 64.0 - 500).alias("height"))
    path = f"{shared_dir(spark)}/terrain-{uuid.uuid4().hex}"
    T.store(T.terrain_tiles(o, 16), path, 12)
    return T.terrain_heights(T.stored(spark.read.parquet(path), 12, 1, 1, 0, 1 << 20), 16)


QUERIES = {
    "vector_tiles": (vector_tiles, f"WITH {STREETS_SQL} SELECT x, y, edge, class, rank, ax, ay, bx, by_ FROM (SELECT floor(ax / {SIDE})::BIGINT + 4 AS x, floor(ay / {SIDE})::BIGINT + 4 AS y, edge, CASE WHEN path THEN 'path' ELSE 'minor' END AS class, rank::VARCHAR AS rank, (ax - floor(ax / {SIDE}) * {SIDE})::BIGINT AS ax, (ay - floor(ay / {SIDE}) * {SIDE})::BIGINT AS ay, (bx - floor(ax / {SIDE}) * {SIDE})::BIGINT AS bx, (yy - floor(ay / {SIDE}) * {SIDE})::BIGINT AS by_ FROM street) WHERE x BETWEEN 0 AND 3 AND y >= 0"),
    "terrain_tiles": (terrain_tiles, "WITH g AS (SELECT o_orderkey % 64 AS gx, o_orderkey // 64 AS gy, ('0x' || left(md5(o_orderkey::VARCHAR), 8))::BIGINT % 100000 / 64::DOUBLE - 500 AS height FROM orders), full_ AS (SELECT gx // 16 AS x, gy // 16 AS y FROM g GROUP BY ALL HAVING count(*) = 256) SELECT gx, gy, height FROM g JOIN full_ ON x = gx // 16 AND y = gy // 16 WHERE x = 1"),
}
