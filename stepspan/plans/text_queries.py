"""Name queries: part names and nations stand for station names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from . import adapters as ad
from .registry import query


def typed(spark: SparkSession, sf: str) -> DataFrame:
    """What customers type: their nation's name, cut, with letters swapped or left out, by their key."""
    c = ad.table(spark, sf, "customer").join(ad.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    n, at = F.col("n_name"), (F.col("c_custkey") % 5 + 1).cast("int")
    swap = F.concat(F.substring(n, F.lit(1), at - 1), F.substring(n, at + 1, F.lit(1)), F.substring(n, at, F.lit(1)), F.substring(n, at + 2, F.lit(100)))
    gone = F.concat(F.substring(n, F.lit(1), at - 1), F.substring(n, at + 1, F.lit(100)))
    k = F.col("c_custkey") % 4
    return c.select(F.when(k == 0, n).when(k == 1, swap).when(k == 2, gone).otherwise(F.substring(n, F.lit(1), at + 1)).alias("query"))


def places(spark: SparkSession, sf: str) -> DataFrame:
    n = ad.table(spark, sf, "nation")
    return n.select(F.format_string("N%02d", "n_nationkey").alias("code"), F.col("n_name").alias("name"), F.array(F.concat_ws(" ", F.lit("old"), "n_name")).alias("aliases"), (F.col("n_nationkey") % 7).alias("trains"))


@query()
def txt1_to_txt5_link_names(spark: SparkSession, sf: str) -> DataFrame:
    """TXT-1 to TXT-5: tested against a plain search over all pairs."""
    return names.link(typed(spark, sf), places(spark, sf))


@query("SELECT p_partkey AS id, CASE WHEN length(p_brand) < 3 THEN 0 ELSE damerau_levenshtein(p_brand, substr(p_brand, 2, 1) || substr(p_brand, 1, 1) || substr(p_brand, 3)) END AS swapped FROM part")
def txt2_swap_distance(spark: SparkSession, sf: str) -> DataFrame:
    b = F.col("p_brand")
    swapped = F.concat(F.substring(b, 2, 1), F.substring(b, 1, 1), F.substring(b, 3, 100))
    return ad.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), names.osa_distance(b, swapped, F.lit(3)).cast("long").alias("swapped"))
