"""64-bit perceptual descriptors: band index, pairs within a Hamming radius, clusters, contact sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inventra.functions.bits import bands, distance
from inventra.operators.graph import components


def band_index(descriptors: DataFrame, radius: int = 8) -> DataFrame:
    """(vec_id, band, value): radius + 1 bands, so two descriptors within the radius agree in one."""
    return descriptors.select("vec_id", F.explode(bands("bits", radius + 1)).alias("x")).select("vec_id", "x.*")


def pairs(descriptors: DataFrame, radius: int = 8) -> DataFrame:
    """(a, b, distance, confidence). Equal descriptors are joined as one and their copies linked to the first, so copies make no pairs of pairs;
    the distance is tested in the join itself."""
    distinct = descriptors.groupBy("bits").agg(F.min("vec_id").alias("vec_id"))
    index = distinct.select("vec_id", "bits", F.explode(bands("bits", radius + 1)).alias("x")).select("vec_id", "bits", "x.*")
    l, r = index.select("band", "value", F.col("vec_id").alias("a"), F.col("bits").alias("ba")), index.select("band", "value", F.col("vec_id").alias("b"), F.col("bits").alias("bb"))
    near = l.join(r, (l["band"] == r["band"]) & (l["value"] == r["value"]) & (F.col("a") < F.col("b")) & (distance("ba", "bb") <= radius)).select("a", "b", distance("ba", "bb").alias("distance")).distinct()
    copies = descriptors.join(distinct.select("bits", F.col("vec_id").alias("a")), "bits").where("vec_id <> a").select("a", F.col("vec_id").alias("b"), F.lit(0).alias("distance"))
    return near.unionByName(copies).withColumn("confidence", 1 - F.col("distance") / 64)


def clusters(descriptors: DataFrame, radius: int = 8) -> DataFrame:
    """(vec_id, cluster, members): components of the pairs, named by their smallest member."""
    found = components(pairs(descriptors, radius).select("a", "b"))
    sizes = found.groupBy("root").agg(F.count("*").alias("members"))
    return found.join(sizes, "root").select(F.col("node").alias("vec_id"), F.col("root").alias("cluster"), "members")


def contact_sheets(members: DataFrame, most: int = 36) -> DataFrame:
    """The first members of each cluster in order, and whether others were left out."""
    w = W.partitionBy("cluster").orderBy("vec_id")
    return members.withColumn("cell", F.row_number().over(w) - 1).where(F.col("cell") < most).select("cluster", "vec_id", "cell", (F.col("members") > most).alias("truncated"))
