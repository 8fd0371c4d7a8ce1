"""Display texts on ties, against printf of the query's SQL."""

import duckdb
from pyspark.sql import functions as F

from wayline.functions import display
from wayline.plans import network_queries as Q


def test_texts_of_ties_are_those_of_the_sql(spark, monkeypatch):
    rows = [(k, p) for k, p in enumerate((6250.0, 31250.0, 56250.0, 81250.0, 1234.56))]
    rides = spark.createDataFrame(rows, "id long, total double").select("id", (F.col("total") / 10).alias("total_distance"))
    monkeypatch.setattr(Q, "ride", lambda *a: rides)
    got = {r.id: r.speed for r in Q.display_texts(spark, "").collect()}
    assert got == {k: duckdb.sql(f"SELECT printf('%.1f', {p}::DOUBLE / 10 / 1000 * 3.6::DOUBLE) || ' km/h'").fetchall()[0][0] for k, p in rows}
    assert spark.range(1).select(display.fixed(F.lit(2.25), 1).alias("x")).first().x == "2.3"
