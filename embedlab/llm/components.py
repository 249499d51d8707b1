"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlab.llm.rows import kept


def _state(links: DataFrame) -> tuple:
    return tuple(
        links.agg(F.count("*"), F.sum(F.xxhash64("_a", "_b").cast("decimal(20,0)"))).first()
    )


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("_a", "_b").unionByName(links.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
    least = both.groupBy("_a").agg(F.min("_b").alias("_m")).withColumn("_m", F.least("_a", "_m"))
    return both.join(least, "_a").where("_b > _a").select(F.col("_b").alias("_a"), F.col("_m").alias("_b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("_a", "_b").alias("_a"), F.least("_a", "_b").alias("_b"))
    least = down.groupBy("_a").agg(F.min("_b").alias("_m"))
    tops = least.select("_a", F.col("_m").alias("_b"))
    return down.join(least, "_a").where("_b <> _m").select(
        F.col("_b").alias("_a"), F.col("_m").alias("_b")
    ).unionByName(tops)


def connected_components(links: DataFrame) -> DataFrame:
    """``_node``, ``_root`` (the smallest node of the component) of all nodes but the roots.

    ``links`` has ``_a``, ``_b``. The number of rounds grows with the logarithm of the size; links
    stay in tables, and only a count and a checksum reach the driver.
    """

    current = kept(links.where("_a <> _b").select("_a", "_b").distinct(), "links")
    state = _state(current)
    while True:
        current = kept(_small_star(_large_star(current).distinct()).distinct(), "links")
        now = _state(current)
        if now == state:
            return current.select(F.col("_a").alias("_node"), F.col("_b").alias("_root"))
        state = now
