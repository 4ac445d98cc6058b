"""Data-quality jobs: each gives the rows that break a rule; no row means all is well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STATUSES = ("yes", "partial", "no", "unknown")


def station_faults(stations: DataFrame) -> DataFrame:
    """DQ-4. stations: (slug, status): slug pattern, slug unique, status in the vocabulary; the first rule broken."""
    x = stations.withColumn("n", F.count("*").over(W.partitionBy("slug")))
    rule = F.when(~F.col("slug").rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), "slug").when(F.col("n") > 1, "slug twice").when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "status")
    return x.withColumn("rule", rule).filter("rule IS NOT NULL").select("slug", "status", "rule")


def too_few(stations: DataFrame, least: int) -> DataFrame:
    """DQ-4. One row if there are fewer stations than expected."""
    return stations.agg(F.count("*").alias("n")).filter(F.col("n") < least)


def unknown_destinations(entries: DataFrame, stations: DataFrame) -> DataFrame:
    """DQ-4. Destinations that are no station, and pram results at stations that are not at least partly step-free."""
    a = entries.join(stations.select(F.col("code").alias("dest")), "dest", "left_anti").select("origin", "dest", "profile", F.lit("unknown destination").alias("rule"))
    open_ = stations.filter(F.col("status").isin("yes", "partial")).select(F.col("code").alias("dest"))
    b = entries.filter("profile = 'stroller'").join(open_, "dest", "left_anti").select("origin", "dest", "profile", F.lit("pram at closed station").alias("rule"))
    return a.unionByName(b)


def wrong_answers(entries: DataFrame, known: DataFrame) -> DataFrame:
    """DQ-6. known: (origin, dest, p, t, k, most, least): cells that are missing, slower than most minutes in the median, or with
    less than least departures per hour. entries: (origin, dest, p, t, k, median, per_hour, ...) of one kind of day."""
    cell = ["origin", "dest", "p", "t", "k"]
    x = known.join(entries.select(*cell, "median", "per_hour"), cell, "left")
    return x.filter("median IS NULL OR median > most OR per_hour < least").select(*cell, "most", "least", "median", "per_hour")
