"""Signals in long form ``(clip, t, v)``: filters, frames, spectra, normalisation.

``t`` counts samples from zero without gaps. Filters run over blocks with a copied left
edge, so a clip of any length is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embedlab.functions import vectors as V
from embedlab.operators.arrow import list_array, matrix
from embedlab.operators.ordering import DEFAULT_BLOCK, over_left_context
from embedlab.session import join_summary

# Fixed values of the feature front end.
PREEMPHASIS = 0.97
N_FFT, WINDOW, HOP = 512, 400, 160
LOG_FLOOR = 2.0**-24
STD_FLOOR = 1e-5

SEGMENT_FRAMES = 256
BATCH_FRAMES = 4096


def preemphasis(signal: DataFrame, factor: float = PREEMPHASIS, block: int = DEFAULT_BLOCK) -> DataFrame:
    """``v[t] - factor * v[t-1]``; the first sample stays."""

    def build(window) -> Column:
        return F.coalesce(F.col("v") - factor * F.lag("v").over(window), F.col("v"))

    return over_left_context(signal, ["clip"], "t", 1, {"out": build}, block).select(
        "clip", "t", F.col("out").alias("v")
    )


def causal_fir(signal: DataFrame, kernel: Sequence[float], block: int = DEFAULT_BLOCK) -> DataFrame:
    """``sum_i kernel[i] * v[t-i]`` with zeros before the start and nothing after the end."""

    def build(window) -> Column:
        terms = [
            F.lit(float(c)) * F.coalesce(F.lag("v", i).over(window) if i else F.col("v"), F.lit(0.0))
            for i, c in enumerate(kernel)
        ]
        return reduce(lambda a, b: a + b, terms)

    left = len(kernel) - 1
    return over_left_context(signal, ["clip"], "t", left, {"out": build}, block).select(
        "clip", "t", F.col("out").alias("v")
    )


def left_context(
    signal: DataFrame, left: int, aggregate=F.avg, block: int = DEFAULT_BLOCK
) -> DataFrame:
    """An aggregate of the current sample and ``left`` earlier ones."""

    def build(window) -> Column:
        return aggregate("v").over(window.rowsBetween(-left, Window.currentRow))

    return over_left_context(signal, ["clip"], "t", left, {"out": build}, block).select(
        "clip", "t", F.col("out").alias("v")
    )


def mel_frame_count(samples: Column, n_fft: int = N_FFT, hop: int = HOP) -> Column:
    return F.floor((samples + 2 * (n_fft // 2) - n_fft) / hop) + 1


def frames_out(samples: Column, n_fft: int = N_FFT, hop: int = HOP) -> Column:
    """Frames left after three halvings, each ``n // 2 + 1``."""

    frames = mel_frame_count(samples, n_fft, hop)
    for _ in range(3):
        frames = F.floor(frames / 2) + 1
    return frames


def segments(
    signal: DataFrame,
    n_fft: int = N_FFT,
    window: int = WINDOW,
    hop: int = HOP,
    before: int = 0,
    frames_per_segment: int = SEGMENT_FRAMES,
) -> DataFrame:
    """``(clip, first, count, at, v)``: the samples of ``frames_per_segment`` frames together.

    A sample goes to the one or two segments whose frames cover it (and to the one after if
    ``before`` earlier samples are wanted), so the data is shuffled once and a long clip is
    spread over many bounded groups. ``at`` counts from the segment's first sample. A clip
    shorter than one frame fails the job.
    """

    pad, lead = n_fft // 2, (n_fft - window) // 2
    sizes = signal.groupBy("clip").agg((F.max("t") + 1).alias("_n"))
    count = mel_frame_count(F.col("_n"), n_fft, hop)
    sizes = sizes.select(
        "clip",
        F.when(count > 0, count)
        .otherwise(F.raise_error(F.lit("clip shorter than one frame")).cast("bigint"))
        .alias("_frames"),
    )
    placed = join_summary(signal, sizes, ["clip"]).withColumn("_p", F.col("t") + pad - lead)
    low = F.greatest(F.ceil((F.col("_p") - window + 1) / hop), F.lit(0))
    high = F.least(F.floor((F.col("_p") + before) / hop), F.col("_frames") - 1)
    span = placed.withColumn("_low", low).withColumn("_high", high).filter("_low <= _high")
    spread = span.withColumn(
        "_seg",
        F.explode(
            F.sequence(
                F.floor(F.col("_low") / frames_per_segment), F.floor(F.col("_high") / frames_per_segment)
            )
        ),
    )
    first = F.col("_seg") * frames_per_segment
    at = F.col("_p") + before - first * hop
    gathered = spread.groupBy("clip", "_seg").agg(
        F.collect_list(F.struct(at.alias("at"), "v")).alias("_s"), F.max("_frames").alias("_frames")
    )
    return gathered.select(
        "clip",
        first.alias("first"),
        F.least(F.lit(frames_per_segment), F.col("_frames") - first).alias("count"),
        F.col("_s.at").alias("at"),
        F.col("_s.v").alias("v"),
    )


def _cut(at, values, count: int, window: int, hop: int, before: int, factor: float) -> np.ndarray:
    """``(count, window)`` frames of one segment; positions without a sample are zero."""

    length = (count - 1) * hop + window + before
    inside = (at >= 0) & (at < length)
    buffer, real = np.zeros(length), np.zeros(length, dtype=bool)
    buffer[at[inside]] = values[inside]
    real[at[inside]] = True
    if before:
        buffer = np.where(real, buffer - factor * np.concatenate([[0.0], buffer[:-1]]), 0.0)[before:]
    return np.lib.stride_tricks.sliding_window_view(buffer, window)[::hop]


def _per_segment(
    parts: DataFrame, name: str, window: int, hop: int, compute, before: int = 0, factor: float = 0.0
) -> DataFrame:
    """``(clip, frame, name)`` from segments; ``compute`` turns frames into rows."""

    schema = T.StructType(
        [
            parts.schema["clip"],
            T.StructField("frame", T.LongType()),
            T.StructField(name, T.ArrayType(T.DoubleType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("clip").type
            clips, numbers, rows, held = [], [], [], 0

            def flush() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [
                        pa.array(clips, kind),
                        pa.array(np.concatenate(numbers)),
                        list_array(np.concatenate(rows)),
                    ],
                    names=["clip", "frame", name],
                )

            for row in range(batch.num_rows):
                first, count = batch["first"][row].as_py(), batch["count"][row].as_py()
                at = batch["at"][row].values.to_numpy()
                values = batch["v"][row].values.to_numpy()
                rows.append(compute(_cut(at, values, count, window, hop, before, factor)))
                numbers.append(np.arange(first, first + count))
                clips += [batch["clip"][row].as_py()] * count
                held += count
                if held >= BATCH_FRAMES:
                    yield flush()
                    clips, numbers, rows, held = [], [], [], 0
            if held:
                yield flush()

    return parts.mapInArrow(run, schema)


def frame_signal(
    signal: DataFrame, n_fft: int = N_FFT, window: int = WINDOW, hop: int = HOP
) -> DataFrame:
    """``(clip, frame, samples)`` with ``samples`` a zero-filled buffer of ``n_fft``."""

    lead = (n_fft - window) // 2
    edges = ((0, 0), (lead, n_fft - window - lead))
    return _per_segment(
        segments(signal, n_fft, window, hop), "samples", window, hop, lambda f: np.pad(f, edges)
    )


def _power(frames: np.ndarray) -> np.ndarray:
    bins = np.fft.rfft(frames, axis=1)
    return np.square(bins.real) + np.square(bins.imag)


def _per_frame(frames: DataFrame, name: str, compute) -> DataFrame:
    schema = T.StructType(
        [frames.schema["clip"], frames.schema["frame"], T.StructField(name, T.ArrayType(T.DoubleType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("clip"), batch.column("frame"), list_array(compute(batch))],
                    names=["clip", "frame", name],
                )

    return frames.mapInArrow(run, schema)


def power_spectrum(frames: DataFrame, window: np.ndarray) -> DataFrame:
    """``(clip, frame, power)``: squared modulus of the windowed real FFT of each buffer."""

    def compute(batch: pa.RecordBatch) -> np.ndarray:
        samples = matrix(batch.column("samples"))
        lead = (samples.shape[1] - len(window)) // 2
        shape = np.zeros(samples.shape[1])
        shape[lead : lead + len(window)] = window
        return _power(samples * shape)

    return _per_frame(frames, "power", compute)


def log_mel(
    signal: DataFrame, filters: np.ndarray, window: np.ndarray, n_fft: int = N_FFT, hop: int = HOP
) -> DataFrame:
    """Waveform to log-mel frames: pre-emphasis, framing, spectrum and filter bank in one pass.

    Each segment brings one sample more, so pre-emphasis needs no shuffle of its own.
    """

    size = len(window)
    lead = (n_fft - size) // 2
    edges = ((0, 0), (lead, n_fft - size - lead))

    def compute(frames: np.ndarray) -> np.ndarray:
        return np.log(_power(np.pad(frames * window, edges)) @ filters.T + LOG_FLOOR)

    parts = segments(signal, n_fft, size, hop, before=1)
    return _per_segment(parts, "mel", size, hop, compute, 1, PREEMPHASIS)


def per_feature_normalize(values: DataFrame, keys: Sequence[str] = ("clip", "bin")) -> DataFrame:
    """``(v - mean) / (sample std + 1e-5)`` per key, for values in long form."""

    keys = list(keys)
    stats = values.groupBy(*keys).agg(F.avg("v").alias("_mean"), F.stddev_samp("v").alias("_std"))
    scaled = (F.col("v") - F.col("_mean")) / (F.col("_std") + STD_FLOOR)
    return join_summary(values, stats, keys).withColumn("v", scaled).drop("_mean", "_std")


def normalize_channels(frames: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The same for frames kept as arrays, every channel at once and nothing exploded."""

    keys = list(keys)
    summary = Summarizer.metrics("mean", "variance").summary(array_to_vector(column))
    stats = frames.groupBy(*keys).agg(summary.alias("_s")).select(
        *keys,
        vector_to_array("_s.mean").alias("_mean"),
        F.transform(vector_to_array("_s.variance"), lambda v: F.sqrt(v) + STD_FLOOR).alias("_std"),
    )
    shifted = V.subtract(F.col(column), F.col("_mean"))
    scaled = F.zip_with(shifted, "_std", lambda v, s: v / s)
    return join_summary(frames, stats, keys, 16_384).withColumn(column, scaled).drop("_mean", "_std")


def harmonic_features(offsets: DataFrame, width: int, offset: str = "offset") -> DataFrame:
    """``(offset, k, v)``: sine in even and cosine in odd columns, frequencies 10000^(-2k/width)."""

    pair = F.col("pair").cast("double")
    theta = F.col(offset).cast("double") * F.exp(-pair * 2.0 * float(np.log(10000.0)) / width)
    spread = offsets.select(
        offset, F.explode(F.sequence(F.lit(0), F.lit(width // 2 - 1))).alias("pair")
    ).withColumn("theta", theta)
    both = F.array(
        F.struct((F.col("pair") * 2).alias("k"), F.sin("theta").alias("v")),
        F.struct((F.col("pair") * 2 + 1).alias("k"), F.cos("theta").alias("v")),
    )
    return spread.select(offset, F.inline(both))


def relative_offsets(lengths: DataFrame, length: str = "n") -> DataFrame:
    """``(n, row, offset)``: ``2n - 1`` rows counting down from ``n - 1``."""

    row = F.explode(F.sequence(F.lit(0).cast("bigint"), 2 * F.col(length) - 2))
    return lengths.select(length, row.alias("row")).withColumn(
        "offset", F.col(length) - 1 - F.col("row")
    )
