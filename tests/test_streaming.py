"""Streams give what the batch gives."""

from pathlib import Path

import pyarrow.parquet as pq
import pytest

from embedlab.operators import moments as mom
from embedlab.plans import catalogue, views
from embedlab.streaming import statistics


@pytest.fixture(scope="module")
def files(spark, folder, tmp_path_factory):
    pairs = views.pairs(spark, folder).select("grp", "x", "y")
    out = str(tmp_path_factory.mktemp("stream") / "pairs")
    pairs.repartition(4).write.parquet(out)
    return pairs, out


def as_dict(df):
    return {(r["kind"], r["i"], r["j"]): r["v"] for r in df.collect()}


def check(a, b):
    assert a.keys() == b.keys()
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_stateful_moments_equal_batch(spark, files, tmp_path):
    pairs, out = files
    stream = statistics.stream_moments(statistics.read_pair_stream(spark, out, pairs.schema, 1))
    query = (
        stream.writeStream.outputMode("complete").format("memory").queryName("live_moments")
        .option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    check(as_dict(spark.table("live_moments")), as_dict(mom.moments(pairs)))


def test_partials_survive_a_restart(spark, files, tmp_path):
    pairs, out = files
    partials, offsets = str(tmp_path / "partials"), str(tmp_path / "offsets")

    def run():
        stream = statistics.read_pair_stream(spark, out, pairs.schema, 2)
        statistics.write_partial_moments(stream, partials, offsets).awaitTermination()

    run()
    run()  # nothing new: nothing may be added twice
    check(as_dict(statistics.merged_partials(spark, partials)), as_dict(mom.moments(pairs)))


def test_cap_stops_reading(spark, files, tmp_path):
    pairs, out = files
    kept, offsets = str(tmp_path / "kept"), str(tmp_path / "offsets")
    written = statistics.write_capped(
        statistics.read_pair_stream(spark, out, pairs.schema, 1), kept, offsets, 200
    )
    assert 200 <= written < pairs.count()
    rows = statistics.capped_rows(spark, kept, 200, ["grp"])
    assert rows.count() == 200 and rows.columns == pairs.columns
    # a restart sees what is there already
    again = statistics.write_capped(
        statistics.read_pair_stream(spark, out, pairs.schema, 1), kept, offsets, 200
    )
    assert again == written


def test_files_of_a_stream_follow_the_rows(spark, folder, tmp_path, monkeypatch):
    pairs = views.lineitem_pairs(spark, folder)
    few = catalogue._pair_files(spark, pairs, 6)
    assert spark.read.parquet(few).count() == pairs.count()
    assert len(list(Path(few.removeprefix("file://")).glob("part-*"))) >= 6
    monkeypatch.setattr(catalogue, "FILE_ROWS", 100)
    many = catalogue._pair_files(spark, pairs, 6)
    sizes = [pq.read_metadata(f).num_rows for f in Path(many.removeprefix("file://")).glob("part-*")]
    assert sum(sizes) == pairs.count() and max(sizes) <= 100
    # the folder of the stream that is cut by its batches
    monkeypatch.setattr(catalogue, "fresh_path", lambda spark, label: str(tmp_path / label))
    catalogue.stream_unit_stats(spark, folder)
    sizes = [pq.read_metadata(f).num_rows for f in (tmp_path / "pairs").glob("part-*")]
    assert len(sizes) > 1 and sum(sizes) == views.pairs(spark, folder).count()
