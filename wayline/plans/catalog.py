"""All queries of the trip engine by name, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import edit_queries, follow_queries, guidance_queries, kernel_queries, label_queries, line_queries, live_queries, network_queries, ridden_queries, ride_queries, road_queries, route_queries, routing_queries, tile_queries, track_queries, turn_queries

_ALL = {**track_queries.QUERIES, **ride_queries.QUERIES, **kernel_queries.QUERIES, **line_queries.QUERIES, **network_queries.QUERIES, **route_queries.QUERIES, **follow_queries.QUERIES, **road_queries.QUERIES, **guidance_queries.QUERIES, **live_queries.QUERIES, **ridden_queries.QUERIES, **routing_queries.QUERIES, **turn_queries.QUERIES, **edit_queries.QUERIES, **tile_queries.QUERIES, **label_queries.QUERIES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track_queries.ride_totals(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
