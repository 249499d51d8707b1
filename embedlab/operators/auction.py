"""Unit matching for wide populations: an auction with epsilon scaling.

Targets bid for sources. A pass over the cost rows, spread over all tasks, lists for each bidder its best
sources at the current prices and a bound on the value of all others. Prices only rise, so a list and
its bound stay valid: bidding goes on among the lists alone, round by round (the two best values of every free
bidder, the highest bid per source), until every bidder has a source or the free ones have run out of
listed sources. Then all bidders get new lists: a pass costs the same for one of them, and fresh bounds
last longer. One task holds the lists of a group, ``width`` cells per unit, never its cost matrix.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embedlab.session import join_summary, materialize

WIDTH = 256
SCALING = 6.0
TOLERANCE = 1e-9

_STATE = "prices array<double>, owner array<int>, eps double, done boolean"


def best_and_bound(values: np.ndarray, prices: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``width`` items worth most at these prices, their values, and the best worth of the others."""

    worth = values - prices
    if len(worth) <= width:
        return np.arange(len(worth)), values, -np.inf
    order = np.argpartition(-worth, width)
    return order[:width], values[order[:width]], float(worth[order[width:]].max())


class Auction:
    """Bidding of one group over short lists. ``owner`` gives the bidder of each item, or -1."""

    def __init__(self, items: np.ndarray, values: np.ndarray, bound: np.ndarray, prices: np.ndarray, owner: np.ndarray):
        self.items, self.values, self.bound, self.prices, self.owner = items, values, bound, prices, owner
        self.place = np.full(len(items), -1)
        held = np.flatnonzero(owner >= 0)
        self.place[owner[held]] = held

    def free(self) -> np.ndarray:
        return np.flatnonzero(self.place < 0)

    def release(self) -> None:
        self.owner[:] = -1
        self.place[:] = -1

    def bid(self, eps: float) -> np.ndarray:
        """Bid until nobody with a usable list is free; returns the free bidders that need a new list."""

        spent = np.zeros(len(self.items), bool)
        waiting = self.free()
        while len(waiting):
            worth = self.values[waiting] - self.prices[self.items[waiting]]
            rows = np.arange(len(waiting))
            column = worth.argmax(axis=1)
            best = worth[rows, column]
            worth[rows, column] = -np.inf
            second = np.maximum(worth.max(axis=1), self.bound[waiting])
            short = best < self.bound[waiting]
            spent[waiting[short]] = True
            ready = np.flatnonzero(~short)
            if len(ready) == 0:
                break
            bidder, item = waiting[ready], self.items[waiting[ready], column[ready]]
            raised = np.where(np.isfinite(second[ready]), best[ready] - second[ready], 0.0) + eps
            offer = self.prices[item] + raised
            # highest offer per item, ties to the smaller bidder
            order = np.lexsort((bidder, -offer, item))
            first = order[np.concatenate(([True], item[order][1:] != item[order][:-1]))]
            item, bidder = item[first], bidder[first]
            previous = self.owner[item]
            self.place[previous[previous >= 0]] = -1
            self.owner[item], self.place[bidder], self.prices[item] = bidder, item, offer[first]
            waiting = np.flatnonzero((self.place < 0) & ~spent)
        return self.free()


def _lists(slots: int, width: int, keys: list[str]):
    """Arrow function from cost rows with the prices of their group to lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs, prices = batch.column("costs"), batch.column("prices")
            out = []
            for i in range(batch.num_rows):
                value = costs[i].values.to_numpy()
                if not np.isfinite(value).all():
                    raise ValueError("the cost table has NaN or infinite cells")
                # a shift of a whole target changes no plan and keeps small differences of large costs
                value = value.min() - value
                out.append(best_and_bound(np.repeat(value, slots), prices[i].values.to_numpy(), width))
            columns = [batch.column(k) for k in [*keys, "tgt"]]
            columns += [
                pa.array([o[0].astype(np.int32) for o in out], pa.list_(pa.int32())),
                pa.array([o[1] for o in out], pa.list_(pa.float64())),
                pa.array([o[2] for o in out], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "tgt", "items", "values", "bound"])

    return run


def _rounds(keys: list[str], tolerance: float):
    """Pandas function of one group's lists and state: bid, phase after phase, as far as the lists go."""

    def run(key: tuple, lists: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        now = state.iloc[0]
        lists = lists.sort_values("tgt")
        items, values = np.stack(lists["items"].to_list()), np.stack(lists["values"].to_list())
        auction = Auction(
            items, values, lists["bound"].to_numpy(float), np.array(now["prices"]), np.array(now["owner"], np.int64)
        )
        # equal costs have no spread, but bids must still rise
        last = tolerance * (float(now["spread"]) or 1.0)
        eps = now["eps"] if now["eps"] >= 0 else max(float(now["spread"]) / 4, last)
        while True:
            needy = auction.bid(eps)
            if len(needy) or eps <= last:
                break
            eps = max(eps / SCALING, last)
            auction.release()
        row = {k: [v] for k, v in zip(keys, key)}
        row |= {"prices": [auction.prices], "owner": [auction.owner], "eps": [eps]}
        return pd.DataFrame(row | {"done": [len(needy) == 0], "spread": [now["spread"]]})

    return run


def auction_plan(
    cost_rows: DataFrame, by: Sequence[str] = (), width: int = WIDTH, tolerance: float = TOLERANCE
) -> DataFrame:
    """``(by..., src, tgt, mass)``: each target takes its whole mass from one source, at least cost.

    For as many targets as sources or a whole multiple of them (each source is used equally often); other
    proportions are left to ``integral_plan``. The cost is within ``tolerance`` times the
    range of costs, per target, of the least. For equal sides this is an optimal barycentric plan as well. Groups
    may differ in content but not in size; holes, NaN cells and other proportions are errors. Without cost rows
    the plan is empty.
    """

    keys = list(by) or ["_all"]
    cells = cost_rows if by else cost_rows.withColumn("_all", F.lit(0))
    order = F.array_sort(F.collect_list(F.struct("src", "cost")))
    rows = materialize(
        cells.groupBy(*keys, "tgt").agg(order.alias("_o"))
        .select(*keys, "tgt", F.col("_o.cost").alias("costs"), F.col("_o.src").alias("_src"))
    )
    spans = rows.groupBy(*keys).agg(
        F.count("*").alias("targets"), F.max("tgt").alias("last"), F.min(F.size("costs")).alias("least"),
        F.max(F.size("costs")).alias("most"), F.max(F.array_max("_src")).alias("top"),
        F.min(F.size(F.array_distinct("_src"))).alias("distinct"),
        F.max(F.array_max("costs") - F.array_min("costs")).alias("spread"),
    )
    sizes = spans.select(
        F.min("targets").alias("a"), F.max("targets").alias("b"), F.min("least").alias("c"), F.max("most").alias("d"),
        F.max("top").alias("top"), F.max("last").alias("last"), F.min("distinct").alias("distinct"),
    ).first()
    fields = T.StructType(
        [cells.schema[k] for k in keys]
        + [T.StructField("src", T.IntegerType()), T.StructField("tgt", T.IntegerType()), T.StructField("mass", T.DoubleType())]
    )
    if sizes["a"] is None:
        return cost_rows.sparkSession.createDataFrame([], fields).select(*by, "src", "tgt", "mass")
    targets, sources = sizes["b"], sizes["d"]
    found = [sizes[name] for name in ("a", "c", "distinct", "top", "last")]
    if found != [targets, sources, sources, sources - 1, targets - 1]:
        raise ValueError("the cost table has holes, or its groups differ in size")
    if targets % sources:
        raise ValueError(f"{targets} targets are no multiple of {sources} sources; use integral_plan")
    slots = targets // sources
    count = sources * slots
    state = spans.select(
        *keys,
        F.array_repeat(F.lit(0.0), count).alias("prices"),
        F.array_repeat(F.lit(-1), count).alias("owner"),
        F.lit(-1.0).alias("eps"),
        F.lit(False).alias("done"),
        "spread",
    )
    key_fields = ", ".join(f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys)
    while True:
        state = materialize(state)
        running = state.filter("not done")
        if running.isEmpty():
            break
        # one row of unit-sized arrays per group
        wanted = join_summary(rows, running.select(*keys, "prices"), keys, row_bytes=8 * count)
        wanted = wanted.select(*keys, "tgt", "costs", "prices")
        lists = wanted.mapInArrow(
            _lists(slots, min(width, count), keys), f"{key_fields}, tgt int, items array<int>, values array<double>, bound double"
        )
        moved = (
            lists.groupBy(*keys)
            .cogroup(running.groupBy(*keys))
            .applyInPandas(_rounds(keys, tolerance), f"{key_fields}, {_STATE}, spread double")
        )
        state = state.filter("done").unionByName(moved.select(*state.columns))
    held = state.select(*keys, F.posexplode("owner").alias("_item", "tgt")).filter("tgt >= 0")
    return held.select(
        *by,
        F.floor(F.col("_item") / slots).cast("int").alias("src"),
        F.col("tgt").cast("int").alias("tgt"),
        F.lit(1.0 / targets).alias("mass"),
    )
