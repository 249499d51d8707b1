"""What five quality filters remove, alone and in every order.

A counting Bloom filter over text hashes clears the texts that occur once; only possible repeats
shuffle, to find the smallest id of every full text. Each document then is a mask of failed filters,
and everything asked about orders is a sum over counts of masks.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedlab.llm.rows import NO_ID, kept, prepare
from embedlab.llm.sketch import MAX_CELLS, at_least, cells_for, counting_filter

FILTERS = "ABCDE"
MIN_WORDS = 200
COPY_BIT = 16
_WORD = r"[^\x20\x09-\x0D]+"


def text_mask(text: Column) -> Column:
    """Failed filters that one text decides: A few words, B repeated words, C capitals, D symbols."""

    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    tests = [
        F.size(words) < MIN_WORDS,
        F.lit(100) * F.size(F.array_distinct(words)) < F.lit(50) * F.size(words),
        F.lit(100).cast("long") * F.regexp_count(text, F.lit("[A-Z]")) > F.lit(3).cast("long") * F.length(text),
        text.rlike(r"[#$%&*|]"),
    ]
    bits = [F.when(test, 1 << i).otherwise(0) for i, test in enumerate(tests)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def _hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("_h1"), F.xxhash64(text, F.lit(13)).alias("_h2")]


def mask_counts(docs: DataFrame, labels: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """``part, mask, good, toxic, n``: documents per part, set of failed filters and label.

    ``mask`` adds 1, 2, 4, 8, 16 for the filters A to E. At most 128 rows per part.
    """

    prepare(docs.sparkSession)
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    number = F.col("doc_id").cast("long")
    rank = F.coalesce(number, F.lit(NO_ID))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    judged = docs.select(
        number.alias("_id"),
        rank.alias("_rank"),
        F.coalesce(F.col("lang"), F.lit("")).alias("part"),
        text_mask(text).alias("mask"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("_digest"),
        *_hashes(text),
    )
    rows = kept(
        judged.join(known, "_id", "left").select(
            "_rank", "part", "mask", "_digest", "_h1", "_h2",
            *(F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")),
        ),
        "audit-rows",
    )
    counters = spark.sparkContext.broadcast(counting_filter(rows, cells_for(rows.count(), max_cells)))
    repeats = at_least(counters, 2)
    group = ["part", "mask", "good", "toxic"]
    single = rows.where(~repeats("_h1", "_h2")).groupBy(*group).agg(F.count("*").alias("n"))

    # only possible repeats carry their text into a shuffle, once per task and text
    least = (
        docs.select(text.alias("_text"), rank.alias("_rank"), *_hashes(text))
        .where(repeats("_h1", "_h2"))
        .groupBy("_text")
        .agg(F.min("_rank").alias("_least"))
        .groupBy(F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("_digest"))
        .agg(F.min("_least").alias("_least"), F.count("*").alias("_texts"))
    )
    clash = F.raise_error(F.lit("two texts share a SHA-256")).cast("long")
    least = least.select("_digest", F.when(F.col("_texts") == 1, F.col("_least")).otherwise(clash).alias("_least"))
    # first per id, which spreads hot texts, then per text: no text has more rows than parts and labels
    copies = (
        rows.where(repeats("_h1", "_h2"))
        .groupBy("_digest", *group, "_rank")
        .agg(F.count("*").alias("_n"))
        .groupBy("_digest", *group)
        .agg(F.sum("_n").alias("_n"), F.min(F.struct("_rank", "_n")).alias("_first"))
        .join(least, "_digest")
        .withColumn("_own", F.when(F.col("_first._rank") == F.col("_least"), F.col("_first._n")).otherwise(0))
    )
    firsts = copies.select(*group, F.col("_own").alias("n"))
    later = copies.select(
        "part", (F.col("mask") + COPY_BIT).alias("mask"), "good", "toxic", (F.col("_n") - F.col("_own")).alias("n")
    )
    everything = single.unionByName(firsts).unionByName(later).where("n > 0")
    return everything.groupBy(*group).agg(F.sum("n").alias("n"))


def _ladder() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, bit, bits of the earlier filters) of every step of every order."""

    rows = []
    for order in permutations(FILTERS):
        earlier = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            rows.append(("".join(order), step, bit, earlier))
            earlier |= bit
    return rows


def audit_filters(docs: DataFrame, labels: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """One row per part, filter order and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley.

    A null text counts as empty, a null ``lang`` as the empty part. A null id ranks after every other
    and equal ids do not precede each other, so rows equal in id and text are no copies of one another. A document counts as good or
    toxic if any label row of its id says so; labels of null ids are not used. An empty table gives no
    rows. Other columns are ignored.
    """

    spark = docs.sparkSession
    counts = kept(mask_counts(docs, labels, max_cells), "mask-counts")
    ladder = _ladder()
    pairs = sorted({(bit, earlier) for _, _, bit, earlier in ladder})
    # in how many orders exactly these filters come before this one
    orders = {earlier: factorial(earlier.bit_count()) * factorial(4 - earlier.bit_count()) for _, earlier in pairs}
    cases = F.array(
        *[F.struct(F.lit(b).alias("bit"), F.lit(e).alias("earlier"), F.lit(orders[e]).alias("orders")) for b, e in pairs]
    )
    cell = counts.withColumn("_case", F.explode(cases)).select(*counts.columns, "_case.*")
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    before = F.col("mask").bitwiseAND(F.col("earlier")) != 0

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0).cast("long")))

    reports = kept(
        cell.groupBy("part", "bit", "earlier", "orders").agg(
            total(~fails & ~before).alias("kept"),
            total(fails & ~before).alias("removed"),
            total(fails & before).alias("redundant"),
            total(F.col("mask") == F.col("bit")).alias("unique_fails"),
            total(fails & ~before & F.col("good")).alias("good_lost"),
            total(fails & ~before & F.col("toxic")).alias("toxic_lost"),
        ),
        "audit-cells",
    )
    shapley = reports.groupBy("part", "bit").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    steps = spark.createDataFrame(ladder, "filter_order string, step int, bit int, earlier int")
    return (
        reports.join(shapley, ["part", "bit"])
        .join(F.broadcast(steps), ["bit", "earlier"])
        .select(
            "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
            "toxic_lost", "shapley",
        )
    )
