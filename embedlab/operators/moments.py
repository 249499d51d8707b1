"""Mergeable first and second moments of paired vectors.

Long layout ``(by..., kind, i, j, v)`` with kinds

    n     row count, at (0, 0)
    sx    sum of x_i, at (i, 0)            sy   sum of y_i, at (i, 0)
    sxx   sum of x_i * x_j                 sxy  sum of x_i * y_j
    syy   sum of y_i * y_j; only i = j unless ``full_yy``

Every kind is a plain sum, so tables merge with :func:`merge_moments` in any order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embedlab.operators.arrow import matrix

NATIVE_CELLS = 160
ACCUMULATOR_BYTES = 256 << 20


def moments(
    pairs: DataFrame,
    by: Sequence[str] = (),
    x: str = "x",
    y: str = "y",
    full_yy: bool = False,
    widths: tuple[int, int] | None = None,
    max_partials: int | None = None,
) -> DataFrame:
    """One pass over ``pairs``.

    With known small ``widths`` the sums are ordinary aggregate expressions. Otherwise each
    input partition is reduced by matrix products on Arrow batches, and only the reduced
    arrays are shuffled: about 3 d^2 cells per input partition and group, added up in the shuffle's
    reducers. For wide vectors make input partitions large (``spark.sql.files.maxPartitionBytes``), or
    give ``max_partials`` to pack them; it also bounds the number of tasks of the pass.
    """

    if widths is not None:
        dx, dy = widths
        cells = dx * (dx + 1) // 2 + dx * dy + (dy * (dy + 1) // 2 if full_yy else dy)
        if cells <= NATIVE_CELLS:
            return _native_moments(pairs, by, x, y, full_yy, dx, dy)
    return _arrow_moments(pairs, by, x, y, full_yy, max_partials)


def _native_moments(pairs, by, x, y, full_yy, dx, dy) -> DataFrame:
    cells: list[tuple[str, int, int, str]] = [("n", 0, 0, "c_n")]
    sums = ["cast(count(1) as double) AS c_n"]

    # SQL text: one parse instead of thousands of small column objects
    def put(kind: str, i: int, j: int, value: str, mirrored: bool = False) -> None:
        name = f"c_{kind}_{i}_{j}"
        sums.append(f"sum({value}) AS {name}")
        cells.append((kind, i, j, name))
        if mirrored and i != j:
            cells.append((kind, j, i, name))

    for i in range(dx):
        put("sx", i, 0, f"`{x}`[{i}]")
        for j in range(i, dx):
            put("sxx", i, j, f"`{x}`[{i}] * `{x}`[{j}]", mirrored=True)
        for j in range(dy):
            put("sxy", i, j, f"`{x}`[{i}] * `{y}`[{j}]")
    for i in range(dy):
        put("sy", i, 0, f"`{y}`[{i}]")
        for j in range(i, dy if full_yy else i + 1):
            put("syy", i, j, f"`{y}`[{i}] * `{y}`[{j}]", mirrored=True)

    reduced = pairs.groupBy(*by).agg(*[F.expr(text) for text in sums])
    rows = ", ".join(
        f"named_struct('kind', '{kind}', 'i', {i}, 'j', {j}, 'v', {name})"
        for kind, i, j, name in cells
    )
    return reduced.select(*by, F.expr(f"inline(array({rows}))"))


PARTIAL_FIELDS = [
    T.StructField("kind", T.StringType()),
    T.StructField("i", T.IntegerType()),
    T.StructField("row", T.ArrayType(T.DoubleType())),
]


class PartialSums:
    """Running sums of one group inside one input partition."""

    def __init__(self, dx: int, dy: int, full_yy: bool):
        self.n = 0
        self.sx, self.sy = np.zeros(dx), np.zeros(dy)
        self.sxx, self.sxy = np.zeros((dx, dx)), np.zeros((dx, dy))
        self.syy = np.zeros((dy, dy)) if full_yy else np.zeros(dy)

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        self.n += len(x)
        self.sx += x.sum(axis=0)
        self.sy += y.sum(axis=0)
        self.sxx += x.T @ x
        self.sxy += x.T @ y
        self.syy += y.T @ y if self.syy.ndim == 2 else np.square(y).sum(axis=0)

    def rows(self) -> Iterator[tuple[str, int, np.ndarray]]:
        yield "n", 0, np.array([float(self.n)])
        # a single sum per unit is stored down the first column
        yield "sx", -1, self.sx
        yield "sy", -1, self.sy
        for i, row in enumerate(self.sxx):
            yield "sxx", i, row
        for i, row in enumerate(self.sxy):
            yield "sxy", i, row
        if self.syy.ndim == 2:
            for i, row in enumerate(self.syy):
                yield "syy", i, row
        else:
            yield "syy", -2, self.syy


    @staticmethod
    def batch(groups: dict, by_types: list[pa.DataType], by: Sequence[str]) -> pa.RecordBatch:
        """One array row per (group, kind, i)."""

        keys, kinds, index, values = [], [], [], []
        for key, sums in groups.items():
            for kind, i, row in sums.rows():
                keys.append(key)
                kinds.append(kind)
                index.append(i)
                values.append(row)
        columns = [pa.array([k[p] for k in keys], by_types[p]) for p in range(len(by))]
        offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
        columns += [
            pa.array(kinds, pa.string()),
            pa.array(index, pa.int32()),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values))),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[*by, "kind", "i", "row"])


def partial_moments(
    pairs: DataFrame,
    by: Sequence[str] = (),
    x: str = "x",
    y: str = "y",
    full_yy: bool = False,
) -> DataFrame:
    """Per input partition: one array row per (group, kind, i). Works on streams too."""

    by = list(by)
    fields = [pairs.schema[name] for name in by]
    schema = T.StructType(fields + PARTIAL_FIELDS)

    def reduce_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, PartialSums] = {}
        types: list[pa.DataType] = []
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.schema.field(name).type for name in by]
            left, right = matrix(batch.column(x)), matrix(batch.column(y))
            if by:
                frame = pa.Table.from_batches([batch.select(by)]).to_pandas()
                members = frame.groupby(by, sort=False, dropna=False).indices
            else:
                members = {(): slice(None)}
            for key, rows in members.items():
                key = key if isinstance(key, tuple) else (key,)
                if key not in groups:
                    sums = PartialSums(left.shape[1], right.shape[1], full_yy)
                    groups[key] = sums
                    held += 8 * (sums.sxx.size + sums.sxy.size + sums.syy.size)
                groups[key].add(left[rows], right[rows])
            if held > ACCUMULATOR_BYTES and len(groups) > 1:
                # many groups: hand over what we have, the final sum puts it together
                yield PartialSums.batch(groups, types, by)
                groups, held = {}, 0
        if groups:
            yield PartialSums.batch(groups, types, by)

    return pairs.select(*by, x, y).mapInArrow(reduce_partition, schema)


def _arrow_moments(pairs, by, x, y, full_yy, max_partials) -> DataFrame:
    source = pairs if max_partials is None else pairs.coalesce(max_partials)
    partial = partial_moments(source, by, x, y, full_yy)
    # arrays are shuffled whole; the cell sums below reuse this partitioning
    rows = partial.repartition(*by, "kind", "i")
    return sum_cells(rows, by)


def sum_cells(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Array rows to summed cells ``(by..., kind, i, j, v)``.

    Input partitions that saw vectors of different widths fail here.
    """

    cells = rows.select(*by, "kind", "i", F.size("row").alias("_w"), F.posexplode("row").alias("j", "v"))
    summed = cells.groupBy(*by, "kind", "i", "j").agg(
        F.sum("v").alias("v"), F.min("_w").alias("_narrow"), F.max("_w").alias("_wide")
    )
    uneven = F.raise_error(F.lit("vector widths differ between partitions")).cast("boolean")
    same = F.when(F.col("_narrow") == F.col("_wide"), F.lit(True)).otherwise(uneven)
    summed = summed.filter(same)
    down = F.col("i") < 0
    return summed.select(
        *by,
        "kind",
        F.when(down, F.col("j")).otherwise(F.col("i")).alias("i"),
        F.when(F.col("i") == -1, F.lit(0)).otherwise(F.col("j")).alias("j"),
        "v",
    )


def merge_moments(*tables: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    merged = tables[0]
    for table in tables[1:]:
        merged = merged.unionByName(table)
    return merged.groupBy(*by, "kind", "i", "j").agg(F.sum("v").alias("v"))


class MomentMatrices:
    """The d x d view of one group's moments, for work that is not proportional to rows."""

    def __init__(self, frame: pd.DataFrame):
        parts = {kind: part for kind, part in frame.groupby("kind")}
        self.n = float(parts["n"]["v"].iloc[0])
        self.sx = self._vector(parts["sx"])
        self.sy = self._vector(parts["sy"])
        self.dx, self.dy = len(self.sx), len(self.sy)
        self.sxx = self._square(parts["sxx"], self.dx, self.dx)
        self.sxy = self._square(parts["sxy"], self.dx, self.dy)
        self.syy = self._square(parts["syy"], self.dy, self.dy)

    @staticmethod
    def _vector(part: pd.DataFrame) -> np.ndarray:
        out = np.zeros(int(part["i"].max()) + 1)
        out[part["i"].to_numpy()] = part["v"].to_numpy()
        return out

    @staticmethod
    def _square(part: pd.DataFrame, rows: int, columns: int) -> np.ndarray:
        out = np.zeros((rows, columns))
        out[part["i"].to_numpy(), part["j"].to_numpy()] = part["v"].to_numpy()
        return out

    def centered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Population covariances and the two means."""

        mx, my = self.sx / self.n, self.sy / self.n
        return self.sxx / self.n - np.outer(mx, mx), self.sxy / self.n - np.outer(mx, my), mx, my


def per_group(moment_rows: DataFrame, by: Sequence[str], build, schema: str) -> DataFrame:
    """Run ``build(MomentMatrices) -> DataFrame`` once per group, groups in parallel.

    A group here is at most 3*d*d rows whatever the number of pair rows behind it.
    """

    by = list(by)
    fields = [moment_rows.schema[name] for name in by]
    full = T.StructType(fields + list(T._parse_datatype_string(schema).fields))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = build(MomentMatrices(frame))
        for position, name in enumerate(by):
            out.insert(position, name, [key[position]] * len(out))
        return out

    source = moment_rows if by else moment_rows.withColumn("_all", F.lit(0))
    return source.groupBy(*(by or ["_all"])).applyInPandas(run, full)


def centered(moment_rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Population covariances ``(by..., i, j, cxx, cxy)``."""

    def build(m: MomentMatrices) -> pd.DataFrame:
        cxx, cxy, _, _ = m.centered()
        wide = max(m.dx, m.dy)
        i, j = np.meshgrid(np.arange(m.dx), np.arange(wide), indexing="ij")
        full_xx = np.full((m.dx, wide), np.nan)
        full_xy = np.full((m.dx, wide), np.nan)
        full_xx[:, : m.dx], full_xy[:, : m.dy] = cxx, cxy
        return pd.DataFrame(
            {"i": i.ravel(), "j": j.ravel(), "cxx": full_xx.ravel(), "cxy": full_xy.ravel()}
        )

    return per_group(moment_rows, by, build, "i int, j int, cxx double, cxy double")

