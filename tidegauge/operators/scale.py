"""Scaling per signal and its inverse; missing values are ignored and kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.series import Series


def with_scaler(s: Series, method: str) -> Series:
    """Columns center and width, so that scaled = (value - center) / width."""
    v = F.col("value")
    if method == "none":
        return s.on(s.df.withColumn("center", F.lit(0.0)).withColumn("width", F.lit(1.0)))
    if method == "standard":
        s = s.stats({"center": F.avg("value"), "width": F.stddev_pop("value")})
    elif method == "minmax":
        s = s.stats({"center": F.min("value"), "_max": F.max("value")})
        s = s.on(s.df.withColumn("width", F.col("_max") - F.col("center")).drop("_max"))
    elif method == "robust":
        s = s.stats(quantiles={"center": (v, 0.5), "_q1": (v, 0.25), "_q3": (v, 0.75)})
        s = s.on(s.df.withColumn("width", F.col("_q3") - F.col("_q1")).drop("_q1", "_q3"))
    else:
        raise ValueError(f"unknown scaling method {method!r}")
    return s.with_column("width", F.when(F.col("width") == 0, 1.0).otherwise(F.col("width")))


def scaled(c: Column) -> Column:
    return (c - F.col("center")) / F.col("width")


def restored(c: Column) -> Column:
    return c * F.col("width") + F.col("center")


def scale(s: Series, method: str) -> Series:
    """Value replaced by the scaled value; center and width are kept for the way back."""
    return with_scaler(s, method).with_column("value", scaled(F.col("value")))


def scaler_table(s: Series) -> DataFrame:
    """center and width of every series that went through with_scaler."""
    return s.summary({"center": F.max("center"), "width": F.max("width")})
