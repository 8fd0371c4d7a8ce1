"""Graph operators as iterated joins; each round is written to the shared folder, which cuts the lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_dir


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id that each node can reach. nodes (id), edges (a, b), taken both ways.

    Labels take the least label around, then that label's own label, so long chains shrink fast. Nodes that no edge meets
    are components of their own and go through no round.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    met, labels = both.select(F.col("a").alias("id")).distinct(), nodes.select("id", F.col("id").alias("component"))
    alone = written(labels.join(met, "id", "left_anti"))
    labels = written(labels.join(met, "id", "left_semi"))
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, F.col("id") == F.col("a"), "left").select("id", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("was"))
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("via"))
        new = written(step.join(jump, "component", "left").select("id", F.least("component", F.coalesce("via", "component")).alias("component"), "was"))
        labels = new.select("id", "component")
        if new.where("component <> was").isEmpty():
            return alone.unionByName(labels)


def shortest_paths(edges: DataFrame, sources: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(source, node, cost) over directed edges (a, b, cost). Only nodes that improved are extended; raises if
    some still improve after `rounds`."""
    best = written(sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("cost")))
    front = best
    edges = edges.select("a", "b", F.col("cost").alias("step"))
    for _ in range(rounds):
        tried = front.join(edges, F.col("node") == F.col("a")).groupBy("source", F.col("b").alias("node")).agg(F.min(F.col("cost") + F.col("step")).alias("new"))
        merged = written(best.join(tried, ["source", "node"], "full").select("source", "node", F.least("cost", "new").alias("cost"), (F.col("new") < F.coalesce("cost", F.lit(float("inf")))).alias("better")))
        best = merged.select("source", "node", "cost")
        front = merged.where("better").select("source", "node", "cost")
        if front.isEmpty():
            return best
    raise RuntimeError(f"paths still improve after {rounds} rounds")


def junctions(edges: DataFrame, least: int = 3) -> DataFrame:
    """Nodes with at least `least` distinct neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy(F.col("a").alias("id")).agg(F.countDistinct("b").alias("degree")).where(F.col("degree") >= least)


def way_costs(ways: DataFrame, profile: DataFrame) -> DataFrame:
    """Ways (way_id, class, surface, oneway, access) priced by a profile table (class, factor): a closed access has
    no price, unpaved ones cost half as much again, the closed direction of a one-way five times."""
    w = ways.join(profile, "class", "left")
    ok = F.col("factor").isNotNull() & ~F.coalesce(F.col("access").isin("no", "private"), F.lit(False))
    paved = F.when(F.col("surface") == "unpaved", F.lit(1.5)).otherwise(F.lit(1.0))
    return w.select("way_id", F.when(ok, F.col("factor") * paved).alias("forward"), F.when(ok, F.col("factor") * paved * F.when(F.col("oneway"), 5.0).otherwise(1.0)).alias("backward"))
