"""Display texts: numbers with a fixed count of decimals, rounded from the exact binary value, ties up unless told otherwise."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import M_PER_KM, M_PER_MILE


def fixed(c: Column, digits: int, ties_even: bool = False) -> Column:
    step, ties = Decimal(1).scaleb(-digits), ROUND_HALF_EVEN if ties_even else ROUND_HALF_UP

    @F.pandas_udf("string")
    def to_text(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v != v or v in (float("inf"), float("-inf")) else str(Decimal(v).quantize(step, ties)), na_action="ignore")

    return to_text(c.cast("double"))


def distance_text(meters: Column, imperial: bool, ties_even: bool = False) -> Column:
    return F.concat(fixed(meters / (M_PER_MILE if imperial else M_PER_KM), 2, ties_even), F.lit(" mi" if imperial else " km"))


def speed_text(mps: Column, imperial: bool, ties_even: bool = False) -> Column:
    return F.concat(fixed(mps * (2.236936 if imperial else 3.6), 1, ties_even), F.lit(" mph" if imperial else " km/h"))


def elevation_text(meters: Column, imperial: bool, ties_even: bool = False) -> Column:
    return F.concat(fixed(meters * (3.28084 if imperial else 1.0), 0, ties_even), F.lit(" ft" if imperial else " m"))


def plural(n: Column, one: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" " + one), F.when(n == 1, "").otherwise("s"))


def rescaled(chart: Column, recorded: Column, chart_total: Column) -> Column:
    """Chart distance in the terms of the recorded total, where there is one."""
    return F.when(recorded > 0, F.coalesce(F.try_divide(chart * recorded, chart_total), chart)).otherwise(chart)
