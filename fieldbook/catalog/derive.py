"""Columns the driver's tables lack (coordinates, shapes), derived by the same rule in Spark and in the oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.functions import geo


def with_coordinates(df: DataFrame, key: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    k = F.col(key)
    return df.withColumns({lat: F.lit(29.0) + F.pmod(k * 7919, F.lit(4001)) / 1000.0,
                           lon: F.lit(-94.0) + F.pmod(k * 6271, F.lit(5987)) / 1000.0})


def sql_coordinates(key: str, lat: str = "lat", lon: str = "lon") -> str:
    return (f"(29.0::DOUBLE + (({key} * 7919) % 4001) / 1000.0::DOUBLE) AS {lat}, "
            f"(-94.0::DOUBLE + (({key} * 6271) % 5987) / 1000.0::DOUBLE) AS {lon}")


def sql_haversine(a, b, c, d, radius=geo.RADIUS_MI) -> str:
    return (f"(2 * {radius} * asin(sqrt(least(1.0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * "
            f"cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))))")


def diamond(x: Column, y: Column, half: Column) -> Column:
    """Rings of a diamond around (x, y) with a square hole of a quarter of its half width."""
    q = half / 4.0
    pt = lambda a, b: F.array(a, b)
    outer = F.array(pt(x - half, y), pt(x, y + half), pt(x + half, y), pt(x, y - half))
    hole = F.array(pt(x - q, y - q), pt(x + q, y - q), pt(x + q, y + q), pt(x - q, y + q))
    return F.array(outer, hole)


def sql_in_diamond(px, py, x, y, half) -> str:
    """Closed form of the diamond with a hole, independent of the even-odd test."""
    return (f"(abs({px} - {x}) + abs({py} - {y}) < {half} AND NOT (abs({px} - {x}) < {half} / 4 "
            f"AND abs({py} - {y}) < {half} / 4))")
