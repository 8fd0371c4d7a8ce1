"""Averages on the bound of a flat section: grades are added in the table's order, however its files are cut."""

import functools
import operator
import random

from wayline.plans import ride_queries


def _total(grades) -> float:
    return functools.reduce(operator.add, grades)  # sum() would mend what rounding loses


def _flat(grades) -> bool:
    return abs(_total(grades) / len(grades)) <= 0.002


def test_flat_twins_add_grades_in_the_order_of_the_table(spark, tmp_path):
    rng, laps = random.Random(5), []
    while len(laps) < 40:
        cents = [rng.randint(0, 10) for _ in range(10)]
        grades = [c / 100 - 0.05 for c in cents]
        if _flat(grades) != (abs((_total(grades[:5]) + _total(grades[5:])) / 10) <= 0.002):  # the order decides
            laps.append(cents)
    for half in (0, 1):  # two files, each with half of every section's laps
        rows = [(1000 - s, cents[i] / 100, s * 10 + i) for i in range(5 * half, 5 * half + 5) for s, cents in enumerate(laps)]
        part = spark.createDataFrame(rows, "l_partkey long, l_discount double, l_orderkey long").selectExpr("*", "'O' AS l_linestatus", "4D AS l_quantity")
        part.coalesce(1).write.mode("append" if half else "overwrite").parquet(f"{tmp_path}/part{half}")
        for f in (tmp_path / f"part{half}").glob("*.parquet"):
            (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
            (tmp_path / "lineitem.parquet" / f"{half}.parquet").write_bytes(f.read_bytes())
    spark.range(400).selectExpr("id AS o_orderkey", "timestamp'2000-01-01' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(1001).selectExpr("id AS p_partkey", "1 AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.section_id: r.twin for r in ride_queries.flat_twin_merge(spark, str(tmp_path)).collect()}
    assert got == {1000 - s: "both" if _flat([c / 100 - 0.05 for c in cents]) else "O" for s, cents in enumerate(laps)}
