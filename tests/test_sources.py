"""Files in, files out."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from embedlab.operators import pairing, tensors
from embedlab.sources import readers, writers


def test_recording_scan(spark, tmp_path):
    for name in ("s1/c1/u1.flac", "s2/c9/u2.flac", "s2/c9/notes.txt"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * 10)
    found = readers.scan_recordings(spark, str(tmp_path)).collect()
    assert sorted(r["path"][-7:] for r in found) == ["u1.flac", "u2.flac"]
    assert {r["length"] for r in found} == {10}
    with pytest.raises(ValueError, match="no file matching"):
        readers.scan_recordings(spark, str(tmp_path), "*.wav")


def test_take_order_is_file_order(spark, tmp_path):
    lines = [f"s{i % 50}\tz{(i * 7919) % 1000:04d}.wav" for i in range(1000)]
    (tmp_path / "dev.tsv").write_text("\n".join(lines))
    takes = readers.scan_takes(spark, str(tmp_path / "dev.tsv"), "fr")
    got = {r["sentence_id"]: (r["first_take"], r["last_take"]) for r in pairing.first_last_take(takes).collect()}
    want = {}
    for line in lines:
        sentence, name = line.split("\t")
        want.setdefault(sentence, []).append(name)
    assert got == {k: (v[0], v[-1]) for k, v in want.items()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        split = readers.scan_takes(spark, str(tmp_path / "dev.tsv"), "fr")
        assert [r["path"] for r in split.orderBy("ord").collect()] == [x.split("\t")[1] for x in lines]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_configs(spark, tmp_path):
    for i, extra in enumerate(({}, {"attention_bias": True}, {"subsampling_factor": 4})):
        body = {"hidden_size": 64, "subsampling_factor": 8, "sliding_window": 71, **extra}
        (tmp_path / f"{i}.json").write_text(json.dumps({"ckpt": i, "encoder_config": body}, indent=2))
    configs = readers.scan_configs(spark, str(tmp_path))
    got = {r["ckpt"]: r["reason"] for r in tensors.compatibility(configs).collect()}
    assert got == {0: None, 1: "has biases", 2: "subsampling_factor is 4"}


def test_debug_files(spark, tmp_path):
    (tmp_path / "a.log").write_text(
        "x\n<<a>>\nShape: [4, 2]\nfirst 16 values): 1 2\nlast 16 values): 3\n"
        "Stats: mean=0.0, std=1.0, min=-1.0, max=2.0\n<<z>>"
    )
    (tmp_path / "b.log").write_text("no block")
    got = {r["file"]: r["block"] for r in readers.scan_debug_blocks(spark, str(tmp_path), begin="<<a>>", end="<<z>>").collect()}
    assert got["a.log"]["first"] == [1.0, 2.0] and got["b.log"] is None


def test_tensor_partitions_are_pruned(spark, tmp_path):
    data = [(c, f"t{i}", 0, [float(i)]) for c in ("a", "b") for i in range(5)]
    table = spark.createDataFrame(data, "ckpt string, name string, row bigint, values array<double>")
    out = str(tmp_path / "t")
    writers.write_tensors(table, out)
    read = readers.scan_tensors(spark, out, "b", ["t3"])
    assert [tuple(r) for r in read.select("name", "values").collect()] == [("t3", [3.0])]
    plan = read._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(ckpt" in plan and "PushedFilters" in plan


def test_report_roundtrip(spark, tmp_path):
    ladder = spark.createDataFrame(
        [(1, "ridge", 0.5, 0.9, True), (0, "identity", -0.5, 0.3, None), (2, "prompt", 0.7, 0.95, False)],
        "ord int, map string, r2 double, cosine_mean double, shippable boolean",
    )
    header = spark.createDataFrame([("ridge", 10)], "map string, fit_frames bigint")
    writers.write_report(writers.build_report(header, ladder), str(tmp_path / "r"))
    row = readers.scan_report(spark, str(tmp_path / "r")).first()
    assert row["map"] == "ridge" and [m["map"] for m in row["ladder"]] == ["identity", "ridge", "prompt"]
    writers.write_report(writers.build_report(header.drop("map"), ladder), str(tmp_path / "q"))
    assert readers.scan_report(spark, str(tmp_path / "q")).first()["map"] == "?"
    writers.write_lines(writers.report_lines(ladder), str(tmp_path / "lines"))
    text = [r[0] for r in spark.read.text(str(tmp_path / "lines")).collect()]
    assert text == ["| `identity` | -0.5000 | +0.3000 |", "| `ridge` | +0.5000 | +0.9000 |"]


def test_aligned_tensors_add_names_only(spark, tmp_path):
    source = spark.createDataFrame(
        [("encoder.a", 0, [1.0]), ("decoder.b", 0, [2.0])], "name string, row bigint, values array<double>"
    )
    fb = spark.createDataFrame([("fb", 0, [5.0])], "name string, row bigint, values array<double>")
    out = tensors.aligned_tensors(
        spark, source, (np.eye(2), np.zeros(2)), fb, {"source": "up", "map": "ridge", "fit_frames": 7}, "new"
    )
    rows = out.collect()
    assert sorted({r["name"] for r in rows}) == ["encoder.a", "preprocessor.featurizer.fb", "proj.bias", "proj.weight"]
    assert {(r["derived_from"], r["alignment_map"], r["projection_dim"], r["fit_frames"]) for r in rows} == {("up", "ridge", 2, 7)}


def test_pairs_scan(spark, tmp_path):
    table = spark.createDataFrame(
        [("c", 0, "g", [1.0], [2.0])], "clip_id string, frame int, grp string, x array<double>, y array<double>"
    )
    table.write.parquet(str(tmp_path / "p"))
    plan = readers.scan_pairs(spark, str(tmp_path / "p")).select(F.col("x"))
    assert plan.first()["x"] == [1.0]
    assert "ReadSchema: struct<x:array<double>>" in plan._jdf.queryExecution().toString()
    chosen = readers.scan_pairs(spark, str(tmp_path / "p")).filter("grp = 'g'")
    assert chosen.count() == 1
    assert "PushedFilters: [IsNotNull(grp), EqualTo(grp,g)]" in chosen._jdf.queryExecution().toString()
