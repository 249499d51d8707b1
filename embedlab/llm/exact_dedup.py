"""Exact deduplication: heavy hitters are settled by a broadcast, the rest by an ordinary shuffle.

Only DataFrame functions. ``freqItems`` keeps Misra-Gries counters per partition and merges them, so
every digest above the support is among at most ``1 / support`` candidates. Their exact counts are
then taken, and the verified winners, bounded by the same number, are broadcast.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embedlab.llm.rows import free_name, kept, prepare

SUPPORT = 0.001


def text_digest(text_column: str = "text") -> Column:
    """SHA-256 of the text with A-Z lower-cased; a null text counts as empty."""

    folded = F.translate(F.coalesce(F.col(text_column), F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.sha2(folded.cast("binary"), 256)


def frequent_digests(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``_digest, _hot_id, _hot_size`` of the digests with at least ``support`` of all rows.

    At most ``1 / support`` rows. ``digests`` (``_digest``, ``_id``) is read three times.
    """

    candidates = digests.stat.freqItems(["_digest"], support).select(
        F.explode("_digest_freqItems").alias("_digest")
    )
    counted = (
        digests.join(F.broadcast(candidates), "_digest")
        .groupBy("_digest")
        .agg(F.max("_id").alias("_hot_id"), F.count("*").alias("_hot_size"))
    )
    total = digests.agg(F.count("*").alias("_total"))
    return counted.join(F.broadcast(total), F.col("_hot_size") >= F.col("_total") * F.lit(support)).drop(
        "_total"
    )


def exact_duplicates(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of the rows with equal normalised text the one with the largest id stays. Null ids rank below
    all others; if all are null, keep_id is null. Among rows equal in id and text one stays. Other
    columns are ignored; an empty table gives an empty result.
    """

    prepare(docs.sparkSession)
    rows = kept(
        docs.select(
            F.col("doc_id").cast("long").alias("_id"),
            text_digest().alias("_digest"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "digests",
    )
    winners = kept(frequent_digests(rows.select("_digest", "_id"), support), "winners")
    marked = rows.join(F.broadcast(winners), "_digest", "left")
    hot = marked.where("_hot_size is not null")
    ties = (
        hot.where(F.col("_id").eqNullSafe(F.col("_hot_id")))
        .groupBy("_digest")
        .agg(F.max("_row").alias("_hot_row"))
    )
    hot_result = hot.join(F.broadcast(ties), "_digest").select(
        F.col("_id").alias("doc_id"),
        F.col("_hot_id").alias("keep_id"),
        F.col("_hot_size").alias("group_size"),
        (F.col("_row") == F.col("_hot_row")).alias("kept"),
        F.col("_digest").alias("text_sha256"),
    )
    group = Window.partitionBy("_digest")
    rest = (
        rows.join(F.broadcast(winners), "_digest", "left_anti")
        .withColumn("_nth", F.row_number().over(group.orderBy(F.desc_nulls_last("_id"), F.desc("_row"))))
        .select(
            F.col("_id").alias("doc_id"),
            F.max("_id").over(group).alias("keep_id"),
            F.count("*").over(group).alias("group_size"),
            (F.col("_nth") == 1).alias("kept"),
            F.col("_digest").alias("text_sha256"),
        )
    )
    return hot_result.unionByName(rest)


def drop_exact_duplicates(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with their own columns.

    Copies of a frequent text are dropped where they are read. Of the others, each task passes on
    its best row per digest only.
    """

    digest, number = free_name(docs, "_digest"), free_name(docs, "_id")
    rows = docs.withColumns({digest: text_digest(), number: F.col("doc_id").cast("long")})
    digests = kept(rows.select(F.col(digest).alias("_digest"), F.col(number).alias("_id")), "digests")
    winners = kept(frequent_digests(digests, support), "winners")
    best = winners.select(
        F.col("_digest").alias(digest), F.col("_hot_id").alias("_best"), F.lit(True).alias("_hot")
    )
    first = Window.partitionBy(digest).orderBy(F.desc_nulls_last(number))
    nth, hot, wanted = (free_name(rows, name) for name in ("_nth", "_hot", "_best"))
    best = best.withColumnsRenamed({"_hot": hot, "_best": wanted})
    return (
        rows.join(F.broadcast(best), digest, "left")
        .where(F.col(hot).isNull() | F.col(number).eqNullSafe(F.col(wanted)))
        .withColumn(nth, F.row_number().over(first))
        .where(F.col(nth) == 1)
        .select(*docs.columns)
    )
