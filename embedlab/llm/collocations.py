"""Phrases of two to four words that stick together, by best-first branch and bound.

A phrase is grown word by word. Its count ``a`` and the counts of its beginnings bound what any longer
phrase with this beginning can score: at a cut after ``k`` words the first part occurs ``l`` times and
the rest at least ``a`` times, so the score is at most ``2000000 a / (l + a)``, and ``a`` only falls
with more words. Each round grows the phrases of the highest bounds, by one word on either side (the left side
shows what covers a phrase), in one pass over the texts. It ends when no phrase whose bound reaches the
lowest score of the report is left to grow.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embedlab.llm.phrase_tokens import (
    BLOCK_BYTES,
    COUNT_SCHEMA,
    LONGEST,
    growth_counter,
    pair_counter,
    phrase_hash,
    word_counter,
)
from embedlab.llm.rows import kept, prepare
from embedlab.llm.sketch import cells_for, counting_filter, least_count

TOP = 2000
MIN_COUNT = 30
COVER_PERCENT = 80
ROUND = 16_000
GROWTH = 4
ROUND_BOUND = 1 << 20
NO_LANGUAGE = "und"


def _ratio(a: str, below: str) -> Column:
    """floor(2000000 a / below), exact beyond 64 bits."""

    return F.expr(f"cast(2000000 * cast({a} as decimal(20,0)) div cast({below} as decimal(20,0)) as long)")


def _counted(texts: DataFrame, counter, min_count: int, label: str) -> DataFrame:
    counts = texts.mapInArrow(counter, COUNT_SCHEMA).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    size = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    return kept(counts.where((F.col("f") >= min_count) | (F.col("phrase") == "")).withColumn("m", size), label)


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _frequent_words(words: DataFrame):
    """A test of word hashes that passes all words of the table, by a bounded filter."""

    spark = words.sparkSession
    hashes = words.where("m = 1").select(
        F.xxhash64(F.concat("lang", F.lit("\x00"), "phrase")).alias("_h1")
    ).withColumn("_h2", F.shiftrightunsigned("_h1", 32))
    packed = spark.sparkContext.broadcast(counting_filter(hashes, cells_for(hashes.count())))

    def frequent(values: np.ndarray) -> np.ndarray:
        signed = values.view(np.int64)
        return least_count(packed.value, signed, (values >> np.uint64(32)).view(np.int64)) > 0

    return frequent


def _scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """``lang, phrase, m, a, bound, score, l, r, missing``: the lowest-scoring cut of every phrase, and
    the parts whose counts are not known yet (then ``score`` is a bound)."""

    words = F.split("phrase", " ")
    cuts = phrases.select(
        "lang", "phrase", "m", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("_k")
    ).select(
        "*",
        F.array_join(F.slice(words, F.lit(1), F.col("_k")), " ").alias("_left"),
        F.array_join(F.slice(words, F.col("_k") + 1, F.col("m") - F.col("_k")), " ").alias("_right"),
    )
    part = counts.where("m > 0")
    cuts = cuts.join(part.selectExpr("lang", "phrase AS _left", "f AS l"), ["lang", "_left"], "left").join(
        part.selectExpr("lang", "phrase AS _right", "f AS r"), ["lang", "_right"], "left"
    )
    cuts = cuts.withColumns(
        {
            "_score": F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), _ratio("a", "l + r")),
            "_bound": F.when(F.col("l").isNotNull(), _ratio("a", "l + a")),
            "_missing": F.array_compact(
                F.array(F.when(F.col("l").isNull(), F.col("_left")), F.when(F.col("r").isNull(), F.col("_right")))
            ),
        }
    )
    lowest = F.min(F.when(F.col("_score").isNotNull(), F.struct("_score", "_k", "l", "r")))
    return (
        cuts.groupBy("lang", "phrase", "m", "a")
        .agg(F.min("_bound").alias("bound"), lowest.alias("_low"), F.flatten(F.collect_list("_missing")).alias("missing"))
        .select("lang", "phrase", "m", "a", "bound", F.col("_low._score").alias("score"), "_low.l", "_low.r", "missing")
    )


def _covers(phrases: DataFrame) -> DataFrame:
    """Each phrase of three or four words as a cover of its two longest parts."""

    words = F.split("phrase", " ")
    inner = F.array(
        F.array_join(F.slice(words, F.lit(1), F.col("m") - 1), " "),
        F.array_join(F.slice(words, F.lit(2), F.col("m") - 1), " "),
    )
    return phrases.where("m > 2").select("lang", F.explode(inner).alias("phrase"), F.col("f").alias("cover"))


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, hash): 0 grown pair, 1 grown triple, 2 triple asked for, 3 the first two words of a triple."""

    for batch in batches:
        kinds, hashes = [], []
        for lang, phrase, asked in zip(*(c.to_pylist() for c in batch.columns)):
            words = phrase.split(" ")
            kinds.append(2 if asked else len(words) - 2)
            hashes.append(phrase_hash(lang, phrase))
            if len(words) > 2:
                kinds.append(3)
                hashes.append(phrase_hash(lang, " ".join(words[:2])))
        columns = [pa.array(kinds, pa.int32()), pa.array(np.array(hashes, np.uint64).view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["_kind", "_h"])


def _hash_sets(front: DataFrame, asked: DataFrame):
    """Broadcast hashes of what one round grows: two numbers at most for each of ``round_bound`` phrases, and
    for the parts that their phrases of four words miss."""

    phrases = front.withColumn("_asked", F.lit(False)).unionByName(asked.withColumn("_asked", F.lit(True)))
    rows = phrases.select("lang", "phrase", "_asked").mapInArrow(_hash_rows, "_kind int, _h long").toArrow()
    kind, hashes = (rows.column(c).to_numpy() for c in ("_kind", "_h"))
    sets = [np.unique(hashes[kind == k]).view(np.uint64) for k in range(4)]
    return front.sparkSession.sparkContext.broadcast(sets)


def _best(table: DataFrame, order: list[Column], limit: int, name: str = "_nth") -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return table.withColumn(name, nth.cast("long")).where(F.col(name) <= limit)


def collocations(
    docs: DataFrame,
    top: int = TOP,
    min_count: int = MIN_COUNT,
    cover_percent: int = COVER_PERCENT,
    block_bytes: int = BLOCK_BYTES,
    round_size: int = ROUND,
    round_bound: int = ROUND_BOUND,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the best ``top`` phrases of each language.

    Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line ends; phrases do not cross
    pieces. A phrase needs ``min_count`` occurrences, scores as at its worst cut (ties: the first), and
    is dropped if a phrase one word longer that contains it has ``cover_percent`` of its count: a still longer
    one cannot have more. Ties of the score go to the count, then to the phrase in byte order.

    A null language counts as ``und``, a null text as empty; repeated rows count again; ids and other
    columns are not used. A language without phrases gives no rows. A piece of any length is
    worked through in blocks of ``block_bytes`` that share three words. ``round_size`` and
    ``round_bound`` only set how many phrases a pass grows.
    """

    prepare(docs.sparkSession)
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), F.col("text").cast("binary").alias("text"))
    words = _counted(texts, word_counter(block_bytes), min_count, "words")
    pairs = _counted(texts, pair_counter(_frequent_words(words), block_bytes), min_count, "pairs")
    totals = words.where("m = 0").select("lang", F.col("f").alias("n"))
    languages = totals.count()
    counts, scored, grown = [words, pairs], [kept(_scored(pairs, words), "scored")], []
    covers: list[DataFrame] = []
    best_first = [F.desc("bound"), F.desc_nulls_last("score"), F.desc("a"), F.asc("phrase")]
    while True:
        candidates = _union(scored)
        settled = candidates.where((F.col("m") == LONGEST) & (F.size("missing") == 0))
        if grown:
            # one row per (lang, phrase) on the right, so nothing is multiplied
            cover = _union(covers).groupBy("lang", "phrase").agg(F.max("cover").alias("cover"))
            short = (
                candidates.where(F.col("m") < LONGEST)
                .join(_union(grown), ["lang", "phrase"], "left_semi")
                .join(cover, ["lang", "phrase"], "left")
            )
            hidden = F.expr(f"cast(cover as decimal(20,0)) * 100 >= cast(a as decimal(20,0)) * {cover_percent}")
            settled = settled.unionByName(short.where(~F.coalesce(hidden, F.lit(False))).drop("cover"))
        ranked = _best(
            settled.select("lang", "phrase", "a", "l", "r", "score"),
            [F.desc("score"), F.desc("a"), F.asc("phrase")],
            top,
            "rank",
        )
        ranked = kept(ranked, "ranked")
        limit = ranked.where(F.col("rank") == top).select("lang", F.col("score").alias("_least"))
        open_ = candidates.join(limit, "lang", "left").where(
            F.col("_least").isNull() | (F.coalesce(F.least("bound", "score"), F.col("bound")) >= F.col("_least"))
            | (F.col("bound") >= F.col("_least")) & (F.col("m") < LONGEST)
        )
        front = open_.where(F.col("m") < LONGEST)
        if grown:
            front = front.join(_union(grown), ["lang", "phrase"], "left_anti")
        per_language = max(1, min(round_size, round_bound // max(languages, 1)))
        front = kept(_best(front, best_first, per_language).select("lang", "phrase"), "front")
        asked = kept(
            open_.where(F.size("missing") > 0).select("lang", F.explode("missing").alias("phrase")).distinct(), "asked"
        )
        if front.isEmpty() and asked.isEmpty():
            return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
        found = _counted(texts, growth_counter(_hash_sets(front, asked), block_bytes), min_count, "grown")
        known = _union(counts[1:])
        new = kept(found.join(known, ["lang", "phrase"], "left_anti"), "new")
        counts.append(new)
        grown.append(front)
        covers.append(kept(_covers(new), "covers"))
        # what waited for a count is scored again with the new phrases
        waiting = candidates.where(F.size("missing") > 0)
        ready = candidates.where(F.size("missing") == 0)
        again = new.unionByName(waiting.select("lang", "phrase", "m", F.col("a").alias("f")))
        scored = [kept(ready.unionByName(_scored(again, _union(counts))), "scored")]
        round_size *= GROWTH
