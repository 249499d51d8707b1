"""Operators against NumPy, brute force and stated edge cases."""

import itertools
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from embedlab.functions import quant
from embedlab.functions import vectors as V
from embedlab.functions.text import group_key, layer_index, numbers
from embedlab.operators import auction, fits, matching, pairing, parity, retrieval, sampling, scoring, signals
from embedlab.operators import moments as mom
from embedlab.operators import tensors
from embedlab.operators.ordering import boundary_key, dense_positions


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def vectors(spark, x, y, extra=None):
    data = [
        (i, "g%d" % (i % 5), [float(v) for v in a], [float(v) for v in b])
        for i, (a, b) in enumerate(zip(x, y))
    ]
    return rows(spark, data, "id bigint, grp string, x array<double>, y array<double>")


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 6)) + 2.0
    w = rng.normal(size=(6, 6))
    y = x @ w + 0.3 + 0.1 * rng.normal(size=(120, 6))
    return x, y, vectors(spark, x, y).repartition(5).cache()


# ------------------------------------------------------------ scalar functions


def test_half_precision_matches_numpy(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate(
        [
            rng.normal(size=2000) * 10.0 ** rng.integers(-9, 5, 2000),
            [0.0, -0.0, 2.0**-24, 2.0**-25, 3 * 2.0**-25, 65504.0, 65519.0, 65520.0, -1e6, 1.0, 0.1],
        ]
    )
    df = rows(spark, [(float(v),) for v in values], "v double")
    got = np.array([r[0] for r in df.select(quant.f16(F.col("v"))).collect()])
    with np.errstate(over="ignore"):
        want = values.astype(np.float16).astype(np.float64)
    assert np.array_equal(got, want)


def test_block_quantisation(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(40, 64))
    data[3, :32] = 0.0
    df = rows(spark, [(i, [float(v) for v in r]) for i, r in enumerate(data)], "i int, v array<double>")
    once = df.withColumn("q", quant.q8_0(F.col("v"))).withColumn("qq", quant.q8_0(F.col("q")))
    got = sorted(once.collect())
    q = np.array([r["q"] for r in got])
    assert np.array_equal(q, scoring.quantized(data))
    assert np.array_equal(q, np.array([r["qq"] for r in got]))
    assert (q[3, :32] == 0).all()
    with pytest.raises(Exception, match="multiple of 32"):
        rows(spark, [([0.0] * 33,)], "v array<double>").select(quant.q8_0(F.col("v"))).collect()
    with pytest.raises(ValueError):
        scoring.quantized(np.zeros((2, 33)))


def test_vector_functions(spark):
    df = rows(spark, [([1.0, 2.0, 3.0], [4.0, 5.0, 6.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = df.select(
        V.dot(a, b), V.dot(a, b, 3), V.norm(b), V.cosine(a, b), V.outer(a, b), V.diagonal(a),
        V.trace(V.outer(a, b)), V.eye(2), V.add(a, b), V.subtract(a, b), V.rms(a),
        V.apply_affine(a, [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]], [10.0, 20.0]),
    ).first()
    x, y = np.array([1.0, 2, 3]), np.array([4.0, 5, 6])
    assert got[0] == got[1] == 32.0
    assert got[2] == pytest.approx(np.linalg.norm(y))
    assert got[3] == pytest.approx(32 / np.linalg.norm(x) / np.linalg.norm(y))
    assert np.array_equal(got[4], np.outer(x, y)) and np.array_equal(got[5], np.diag(x))
    assert got[6] == 32.0 and np.array_equal(got[7], np.eye(2))
    assert got[8] == [5.0, 7.0, 9.0] and got[9] == [-3.0] * 3
    assert got[10] == pytest.approx(np.sqrt(14 / 3)) and got[11] == [14.0, 25.0]


def test_text_helpers(spark):
    df = rows(spark, [("a/b/c.flac", " 1.5 -2e-3\n7 "), ("c.flac", "")], "p string, t string")
    got = df.select(group_key(F.col("p")), numbers(F.col("t")), layer_index(F.lit("encoder.layers.12.x"))).collect()
    assert got[0][0] == "a" and got[1][0] is None
    assert got[0][1] == [1.5, -0.002, 7.0] and got[1][1] == []
    assert got[0][2] == 12


# ------------------------------------------------------------ selection


def test_halves_round_to_even():
    assert [sampling.wanted_samples(s, 1) for s in (0.5, 1.5, 2.5, 3.5)] == [0, 2, 2, 4]


def test_holdout_keeps_groups_whole(spark):
    df = rows(spark, [(f"s{i % 10}", i) for i in range(200)], "grp string, v int")
    halves = sampling.group_holdout(df, "grp")
    held = {r[0] for r in halves.filter("split = 'eval'").select("grp").distinct().collect()}
    assert held == {"s0", "s1"}
    assert not held & {r[0] for r in halves.filter("split = 'fit'").select("grp").distinct().collect()}
    with pytest.raises(ValueError):
        sampling.group_holdout(df.filter("grp = 's1'"), "grp")


def test_boundary_key(spark):
    df = rows(spark, [(f"k{i:04d}",) for i in range(500)], "k string")
    assert boundary_key(df, "k", lambda total: total // 5) == ("k0099", 100, 500)
    with pytest.raises(Exception, match="null keys"):
        boundary_key(rows(spark, [("a",), (None,)], "k string"), "k", lambda total: 1)


def test_positions_with_a_hot_group(spark):
    rng = np.random.default_rng(5)
    data = [(("hot" if rng.random() < 0.6 else f"u{rng.integers(20)}"), int(t)) for t in rng.permutation(3000)]
    placed = dense_positions(rows(spark, data, "u string, t int"), ["u"], ["t"])
    want = {}
    for u in {d[0] for d in data}:
        for position, t in enumerate(sorted(t for v, t in data if v == u)):
            want[(u, t)] = position
    assert {(r["u"], r["t"]): r["pos"] for r in placed.collect()} == want


def test_batches_are_consecutive(spark):
    df = rows(spark, [(i,) for i in range(103)], "k int")
    got = sampling.batches(df, 10, ["k"]).collect()
    assert all(r["batch_id"] == r["k"] // 10 for r in got) and len(got) == 103


def test_rate_guard(spark):
    df = rows(spark, [("a", 16000), ("b", 8000)], "path string, rate int")
    with pytest.raises(Exception, match="b: 8000 Hz"):
        sampling.require_rate(df, 16000).collect()
    assert {r["status"] for r in sampling.quarantine_rate(df, 16000).collect()} == {"ok", "rate 8000"}
    with pytest.raises(ValueError, match="nothing"):
        sampling.require_nonempty(df.limit(0), "nothing")


def test_sample_does_not_depend_on_partitioning(spark):
    df = rows(spark, [(f"p{i}", i * 10) for i in range(200)], "path string, n_samples bigint")
    a = sampling.sample_clips(df, 400, 1000, 20, 7).collect()
    b = sampling.sample_clips(df.repartition(9), 400, 1000, 20, 7).collect()
    assert sorted(a) == sorted(b) and len(a) == 20
    with pytest.raises(ValueError):
        sampling.sample_clips(df, 10_000, 1000)


def test_crop_and_frames(spark):
    df = rows(spark, [([1.0, 2.0, 3.0, 4.0],)], "v array<double>")
    assert df.select(sampling.crop_array(F.col("v"), F.lit(1), 2)).first()[0] == [2.0, 3.0]
    nested = rows(spark, [(1, [[1.0, 2.0], [3.0, 4.0]])], "b int, h array<array<double>>")
    assert [tuple(r) for r in sampling.explode_frames(nested, "h", ["b"]).collect()] == [
        (1, 0, [1.0, 2.0]), (1, 1, [3.0, 4.0]),
    ]


# ------------------------------------------------------------ joins


def test_pairing_needs_both_sides(spark):
    a = rows(spark, [("c", 0, [1.0]), ("c", 1, [2.0])], "clip string, frame int, x array<double>")
    b = rows(spark, [("c", 0, [1.0])], "clip string, frame int, y array<double>")
    with pytest.raises(Exception, match="frame on one side only: c/1"):
        pairing.pair_frames(a, b, ["clip", "frame"]).count()
    assert [tuple(r) for r in pairing.unpaired_counts(a, b, "clip").collect()] == [("c", 2, 1)]


def test_key_checks(spark):
    t = lambda names: rows(spark, [(n,) for n in names], "name string")
    tables = {"base": t("abcde"), "ancestor": t("abcde"), "descendant": t("abc")}
    assert {tuple(r) for r in pairing.key_difference(tables, "name").collect()} == {
        ("d", "descendant"), ("e", "descendant"),
    }
    with pytest.raises(ValueError, match=r"2 tensors .*\['d', 'e'\]"):
        pairing.require_same_keys(tables, "name")
    row = "name string, row int, values array<double>"
    left, right = rows(spark, [("a", 0, [1.0])], row), rows(spark, [("a", 0, [3.0]), ("z", 0, [9.0])], row)
    assert tensors.interpolate(left, right, 0.25).first()["values"] == [1.5]
    with pytest.raises(Exception, match="missing on the right: z/0"):
        tensors.interpolate(right, left, 0.25).collect()


def test_group_kinds():
    assert pairing.wanted_kinds("all") == set(pairing.GROUP_KINDS)
    assert pairing.wanted_kinds("none") == set() == pairing.wanted_kinds("")
    with pytest.raises(ValueError, match="choose from residual"):
        pairing.wanted_kinds("residual,other")


def test_band_join(spark):
    df = rows(spark, [("a" if i < 40 else "b", i % 40) for i in range(70)], "clip string, t int")
    got = {(r["clip"], r["q"], r["k"]) for r in pairing.band_join(df, df, "clip", "t", 5).collect()}
    want = {
        (c, q, k) for c, n in (("a", 40), ("b", 30)) for q in range(n) for k in range(n) if 0 <= q - k <= 5
    }
    assert got == want
    counts = {(r["clip"], r["q"]): r["n_keys"] for r in pairing.band_counts(df, "clip", "t", 5).collect()}
    assert all(v == min(q, 5) + 1 for (_, q), v in counts.items())


# ------------------------------------------------------------ moments, maps, scores


def as_dict(df, by=()):
    return {tuple(r[c] for c in [*by, "kind", "i", "j"]): r["v"] for r in df.collect()}


def close(a, b, tolerance=1e-9):
    assert a.keys() == b.keys()
    assert all(abs(a[k] - b[k]) <= tolerance * max(1.0, abs(b[k])) for k in a)


def test_moments_agree_in_every_form(spark, sample):
    x, y, df = sample
    native = as_dict(mom.moments(df, full_yy=True, widths=(6, 6)))
    arrow = as_dict(mom.moments(df, full_yy=True))
    close(native, arrow)
    close(native, as_dict(mom.moments(df.repartition(13), full_yy=True)))
    close(as_dict(mom.merge_moments(mom.moments(df, ["grp"], full_yy=True))), native)
    assert native[("sxy", 1, 2)] == pytest.approx((x[:, 1] * y[:, 2]).sum())
    assert native[("n", 0, 0)] == 120


def test_moments_hand_over_many_groups(spark, sample, monkeypatch):
    _, _, df = sample
    want = as_dict(mom.moments(df, ["id"]), ["id"])
    # the limit is read in the worker, so shrink it through the closure's module
    monkeypatch.setattr(mom, "ACCUMULATOR_BYTES", 100)
    close(as_dict(mom.moments(df, ["id"]), ["id"]), want)


def test_ragged_vectors_fail(spark):
    df = rows(spark, [([1.0, 2.0], [1.0]), ([1.0], [2.0])], "x array<double>, y array<double>")
    with pytest.raises(Exception, match="widths differ"):
        mom.moments(df.coalesce(1)).collect()


def matrices(df, by=None):
    return fits.collect_moments(mom.moments(df, [by] if by else [], full_yy=True), by)


def numpy_scores(guess, target):
    error, cos = guess - target, None
    cos = (guess * target).sum(1) / np.linalg.norm(guess, axis=1) / np.linalg.norm(target, axis=1)
    sse, sst = (error**2).sum(), ((target - target.mean(0)) ** 2).sum()
    return 1 - sse / sst, np.sqrt(sse / (target**2).sum()), cos.mean(), np.quantile(cos, 0.05)


def test_scores_match_numpy_and_moments(spark, sample):
    x, y, df = sample
    m = matrices(df)[None]
    maps = fits.fit(m, ["identity", "diagonal", "orthogonal", "ridge"], [1e-3, 1.0])
    got = {r["ord"]: r for r in scoring.score_rows(df, maps).collect()}
    for mapping in maps:
        want = numpy_scores(x @ mapping.weight + mapping.bias, y)
        row = got[mapping.ord]
        assert (row["r2"], row["relative_error"], row["cosine_mean"], row["cosine_p05"]) == pytest.approx(want)
        assert scoring.score_from_moments(mapping, m) == pytest.approx(want[0])


def test_projected_scores(spark, sample):
    x, y, df = sample
    rng = np.random.default_rng(8)
    p, pb = rng.normal(size=(64, 6)), rng.normal(size=64)
    m = matrices(df)[None]
    mapping = fits.ridge_map(m, 0.1)
    target = scoring.project(df.select("x", "y"), p, pb, "y", "y")
    row = scoring.score_rows(target, [mapping], (p, pb)).first()
    want = numpy_scores((x @ mapping.weight + mapping.bias) @ p.T + pb, y @ p.T + pb)
    assert row["r2"] == pytest.approx(want[0])
    assert scoring.projected_r2_from_moments(mapping, m, (p, pb)) == pytest.approx(want[0])
    folded = mapping.fold_into_projection(p, pb)
    assert np.allclose(x @ folded[0].T + folded[1], (x @ mapping.weight + mapping.bias) @ p.T + pb)
    with pytest.raises(ValueError, match="no projection"):
        scoring.lifted_map(mapping, 64)
    with pytest.raises(ValueError):
        mapping.fold_into_projection(rng.normal(size=(9, 9)), np.zeros(9))


def test_fit_properties(spark, sample):
    x, y, df = sample
    m = matrices(df)[None]
    r2 = {f.name: scoring.score_from_moments(f, m) for f in fits.fit(m, ["identity", "permutation", "diagonal", "orthogonal", "ridge"], [1e-10], list(range(6)))}
    assert r2["ridge"] >= r2["diagonal"] - 1e-9 and r2["ridge"] >= r2["orthogonal"] - 1e-9
    assert r2["orthogonal"] >= r2["identity"] and r2["diagonal"] >= r2["identity"]
    rotation = fits.orthogonal_map(m)
    assert np.allclose(rotation.weight.T @ rotation.weight, rotation.scale**2 * np.eye(6))
    same = matrices(vectors(spark, x, x))[None]
    assert scoring.score_from_moments(fits.identity_map(same), same) == pytest.approx(1.0)
    # reflections are allowed
    flip = matrices(vectors(spark, x, x * np.array([-1, 1, 1, 1, 1, 1])))[None]
    assert np.linalg.det(fits.orthogonal_map(flip, scaled=False).weight) == pytest.approx(-1.0)


def test_constant_channel_and_unequal_widths(spark, sample):
    x, y, _ = sample
    fixed = x.copy()
    fixed[:, 2] = 1.0
    m = matrices(vectors(spark, fixed, y))[None]
    assert np.isfinite(fits.diagonal_map(m).weight).all()
    wide = matrices(vectors(spark, x[:, :4], y))[None]
    for build in (fits.identity_map, fits.diagonal_map, fits.orthogonal_map):
        with pytest.raises(ValueError, match="equal widths"):
            build(wide)
    assert fits.ridge_map(wide, 0.1).weight.shape == (4, 6)


def test_maps_per_group_and_back(spark, sample):
    _, _, df = sample
    table = fits.fit_maps(mom.moments(df, ["grp"]), ["ridge"], ["grp"], [0.1])
    one = fits.ridge_map(matrices(df.filter("grp = 'g2'"))[None], 0.1)
    read = fits.collect_maps(table.filter("grp = 'g2'"))[0]
    assert np.allclose(read.weight, one.weight) and np.allclose(read.bias, one.bias)


def test_best_alpha_ties_and_edges(spark):
    data = [(0.1, 0.5, None), (1.0, 0.5, None), (10.0, float("nan"), None)]
    flagged = scoring.flag_best_alpha(rows(spark, data, "alpha double, r2 double, deployed_r2 double"))
    got = {r["alpha"]: (r["is_best"], r["at_edge"]) for r in flagged.collect()}
    assert got == {0.1: (True, True), 1.0: (False, False), 10.0: (False, False)}


def test_best_map_skips_report_only_rows(spark):
    data = [
        (0, "identity", 0.1, 0.2, None), (1, "prompt", 0.9, 0.95, False), (2, "ridge", 0.5, None, True),
        (3, "other", 0.4, 0.5, None),
    ]
    ladder = rows(spark, data, "ord int, map string, r2 double, deployed_r2 double, shippable boolean")
    assert scoring.best_map(ladder).first()["map"] == "ridge"


def test_quantile_bracket_is_exact(spark):
    rng = np.random.default_rng(4)
    values = {"a": rng.normal(size=5001), "b": np.round(rng.normal(size=777), 1), "c": np.ones(50)}
    values |= {f"n{n}": rng.normal(size=n) for n in (1, 2, 3, 10, 96)}
    df = rows(spark, [(k, float(v)) for k, vs in values.items() for v in vs], "g string, v double")
    for p, accuracy in itertools.product((0.05, 0.5, 0.95, 1.0), (50, scoring.SKETCH_ACCURACY)):
        got = {r["g"]: r["q"] for r in scoring.linear_quantile(df, ["g"], "v", p, accuracy=accuracy).collect()}
        for k, vs in values.items():
            if accuracy > 1000 or len(vs) > 50 or k == "c":
                assert got[k] == pytest.approx(np.quantile(vs, p), abs=1e-12)


def test_scored_quantile_against_numpy(spark, sample):
    x, y, df = sample
    maps = fits.fit(matrices(df)[None], ["identity", "diagonal"])
    for row, mapping in zip(sorted(scoring.score_rows(df, maps).collect()), maps):
        guess = x @ mapping.weight + mapping.bias
        cosines = (guess * y).sum(1) / np.linalg.norm(guess, axis=1) / np.linalg.norm(y, axis=1)
        assert row["cosine_p05"] == pytest.approx(np.quantile(cosines, 0.05))


def test_mlp(spark, sample):
    x, _, df = sample
    rng = np.random.default_rng(2)
    w1, b1, w2, b2 = rng.normal(size=(9, 6)), rng.normal(size=9), rng.normal(size=(4, 9)), rng.normal(size=4)
    got = scoring.mlp_scores(df.select("id", "x"), w1, b1, w2, b2, "x", "z").orderBy("id").collect()
    assert np.allclose([r["z"] for r in got], np.maximum(x @ w1.T + b1, 0) @ w2.T + b2)


# ------------------------------------------------------------ matching


def test_assignment_against_brute_force():
    rng = np.random.default_rng(0)
    for n, m in ((3, 3), (4, 4), (3, 5), (5, 3)):
        for _ in range(20):
            cost = rng.normal(size=(n, m))
            src, tgt = matching.assign(cost)
            square = cost if n <= m else cost.T
            best = min(
                sum(square[i, p[i]] for i in range(min(n, m)))
                for p in itertools.permutations(range(max(n, m)), min(n, m))
            )
            assert cost[src, tgt].sum() == pytest.approx(best)


def test_uneven_plans():
    rng = np.random.default_rng(1)
    cost = rng.random((4, 10))
    owner = matching.integral_assignment(cost)
    assert sorted(np.bincount(owner, minlength=4)) == [2, 2, 3, 3]
    for n, m in ((2, 3), (4, 6), (3, 4)):
        cost = rng.random((n, m))
        plan = matching.barycentric_amounts(cost)
        assert np.allclose(plan.sum(0), 1 / m) and np.allclose(plan.sum(1), 1 / n)
        k = np.lcm(n, m)
        copies = np.repeat(np.repeat(cost, k // n, 0), k // m, 1)
        src, tgt = matching.assign(copies)
        assert (cost * plan).sum() == pytest.approx(copies[src, tgt].sum() / k)


def test_costs(spark, sample):
    x, y, df = sample
    m = matrices(df)[None]
    assert np.allclose(matching.unit_distances(m, "correlation"), 1 - np.corrcoef(x.T, y.T)[:6, 6:])
    unit = lambda a: a / np.linalg.norm(a, axis=0)
    assert np.allclose(matching.unit_distances(m, "cosine"), 1 - unit(x).T @ unit(y))
    with pytest.raises(ValueError, match="choose from"):
        matching.unit_distances(m, "other")


def test_operators_on_a_barycentric_plan(spark):
    rng = np.random.default_rng(6)
    cost = rng.random((4, 6))
    plan = matching.barycentric_amounts(cost)
    data = [("g", i, j, float(cost[i, j])) for i in range(4) for j in range(6)]
    table = rows(spark, data, "group string, src int, tgt int, cost double")
    soft = matching.barycentric_plan(table, ["group"])
    ops = matching.operators_from_plan(soft, ["group"])
    analysis, synthesis = plan / plan.sum(0), plan / plan.sum(1, keepdims=True)
    mass = {r["src"]: r["self_mass"] for r in matching.self_mass(ops, ["group"]).collect()}
    assert [mass[i] for i in range(4)] == pytest.approx((analysis * synthesis).sum(1))
    best = {r["tgt"]: r["src"] for r in matching.argmax_source(ops, ["group"]).collect()}
    assert [best[j] for j in range(6)] == list(analysis.argmax(0))
    row = matching.match_summary(table, soft, ["group"]).first()
    assert row["transport_cost"] == pytest.approx((cost * plan).sum())
    assert np.isnan(row["identity_cost"]) and np.isnan(row["identity_agreement"])
    assert row["min_self_mass"] == pytest.approx((analysis * synthesis).sum(1).min())
    assert np.isnan(matching.identity_agreement(ops, ["group"]).first()["identity_agreement"])


def dense(df, weight, n, m):
    out = np.zeros((n, m))
    for r in df.collect():
        out[r["src"], r["tgt"]] += r[weight]
    return out


def test_expand_concat_identity(spark):
    ops = rows(
        spark, [(1, 0, 1.0, 1.0), (0, 1, 1.0, 1.0)], "src int, tgt int, analysis double, synthesis double"
    )
    flat = np.array([[0, 1], [1, 0]])
    assert np.array_equal(dense(matching.expand_ops(ops, 3), "analysis", 6, 6), np.kron(flat, np.eye(3)))
    both = dense(matching.concat_ops([(ops, 2, 2), (ops, 2, 2)]), "analysis", 4, 4)
    assert np.array_equal(both, np.kron(np.eye(2), flat))
    ident = matching.identity_ops(spark, 3)
    assert np.array_equal(dense(ident, "analysis", 3, 3), np.eye(3))
    assert matching.identity_agreement(ident).first()[0] == 1.0


def test_block_contributions_add_up(spark, sample):
    x, _, df = sample
    weight = np.random.default_rng(9).normal(size=(6, 5))
    parts = matching.block_contributions(df, ["id"], weight, 3).collect()
    total = np.zeros((120, 5))
    for r in parts:
        total[r["id"]] += r["v"]
    assert np.allclose(total, x @ weight)


# ------------------------------------------------------------ retrieval


def brute_ranks(v, r):
    similarity = np.array([[sum(a * b for a, b in zip(p, q)) for q in r] for p in v])
    return 1 + (similarity > np.diag(similarity)[:, None]).sum(1)


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_ranks_with_ties(spark, block_rows):
    rng = np.random.default_rng(12)
    v, r = rng.integers(-2, 3, size=(60, 4)) / 3.0, rng.integers(-2, 3, size=(60, 4)) / 3.0
    r[10:20] = r[10]  # copies: a tie is not a loss
    data = [("a", i, [float(c) for c in p], [float(c) for c in q]) for i, (p, q) in enumerate(zip(v, r))]
    df = rows(spark, data, "s string, k bigint, v array<double>, r array<double>")
    got = {x["k"]: x["rank"] for x in retrieval.rank_matched(df, ["s"], "k", block_rows=block_rows).collect()}
    assert [got[i] for i in range(60)] == list(brute_ranks(v, r))
    joined = retrieval.truth_rank(df.select("s", "k", "v"), df.select("s", "k", F.col("r").alias("v")), ["s"], "k")
    assert {x["k"]: x["rank"] for x in joined.collect()} == got
    row = retrieval.retrieval_summary(joined, ["s"]).first()
    ranks = brute_ranks(v, r)
    assert row["top1"] == (ranks == 1).mean() and row["median_rank"] == np.median(ranks)
    assert row["chance_top1"] == 1 / 60


def test_ranks_in_bounded_memory():
    p = np.random.default_rng(13).normal(size=(600, 64))
    p[:300] = p[0]  # copies: tens of thousands of ties
    r, keys = np.concatenate([p] * 25), np.arange(600)
    bar, others = retrieval._ordered_dot(p, p), np.tile(keys, 25)
    tracemalloc.start()
    got = retrieval._count_above(p, r, bar, keys, others)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6
    similarity = retrieval._ordered_dot(np.repeat(p, 600, 0), np.tile(p, (600, 1))).reshape(600, 600)
    assert list(got) == list(25 * (similarity > bar[:, None]).sum(axis=1))


def test_pooling_both_ways(spark, sample):
    x, _, df = sample
    wide = retrieval.mean_pool(df, ["grp"], ["x"]).orderBy("grp").collect()
    small = retrieval.mean_pool(df, ["grp"], ["x"], 6).orderBy("grp").collect()
    for a, b in zip(wide, small):
        assert a["x"] == pytest.approx(b["x"])
    assert wide[0]["x"] == pytest.approx(list(x[0::5].mean(0)))


def test_takes(spark):
    takes = rows(
        spark, [("en", "s1", 0, "a"), ("en", "s1", 1, "b"), ("en", "s2", 2, "c")],
        "lang string, sentence_id string, ord int, path string",
    )
    got = {r["sentence_id"]: (r["first_take"], r["last_take"]) for r in pairing.first_last_take(takes).collect()}
    assert got == {"s1": ("a", "b"), "s2": ("c", "c")}


# ------------------------------------------------------------ signals


@pytest.fixture(scope="module")
def signal(spark):
    rng = np.random.default_rng(11)
    clips = {1: rng.normal(size=1000), 2: rng.normal(size=700)}
    data = [(c, t, float(v)) for c, vs in clips.items() for t, v in enumerate(vs)]
    return clips, rows(spark, data, "clip int, t bigint, v double").repartition(4).cache()


def by_clip(df, clip, name="v"):
    return np.array([r[name] for r in df.filter(F.col("clip") == clip).orderBy("t").collect()])


@pytest.mark.parametrize("block", [16, 100_000])
def test_filters_across_block_edges(signal, block):
    clips, df = signal
    kernel = [0.5, -0.25, 0.125, 0.3]
    for c, v in clips.items():
        pre = v - 0.97 * np.concatenate([[0.0], v[:-1]])
        assert np.allclose(by_clip(signals.preemphasis(df, block=block), c), pre)
        assert np.allclose(by_clip(signals.causal_fir(df, kernel, block), c), np.convolve(v, kernel)[: len(v)])
        mean = [v[max(0, i - 5) : i + 1].mean() for i in range(len(v))]
        assert np.allclose(by_clip(signals.left_context(df, 5, block=block), c), mean)


def test_log_mel_at_full_size(signal):
    clips, df = signal
    rng = np.random.default_rng(0)
    filters, window = rng.random((8, 257)), rng.random(400)
    got = signals.log_mel(df, filters, window)
    for c, v in clips.items():
        pre = v - 0.97 * np.concatenate([[0.0], v[:-1]])
        padded = np.pad(pre, 256)
        count = (len(padded) - 512) // 160 + 1
        mine = [r["mel"] for r in got.filter(F.col("clip") == c).orderBy("frame").collect()]
        assert len(mine) == count
        for f in range(count):
            buffer = np.zeros(512)
            buffer[56:456] = padded[f * 160 + 56 : f * 160 + 456] * window
            power = np.abs(np.fft.rfft(buffer)) ** 2
            assert np.allclose(mine[f], np.log(filters @ power + 2.0**-24))


def test_segments_of_any_size_give_the_same_frames(signal, monkeypatch):
    clips, df = signal
    for size in (1, 3, 256):
        parts = signals.segments(df, 64, 48, 20, frames_per_segment=size)
        got = signals._per_segment(parts, "samples", 48, 20, lambda f: np.pad(f, ((0, 0), (8, 8))))
        for c, v in clips.items():
            padded = np.pad(v, 32)
            mine = [r["samples"] for r in got.filter(F.col("clip") == c).orderBy("frame").collect()]
            assert len(mine) == len(v) // 20 + 1
            for f, samples in enumerate(mine):
                want = np.zeros(64)
                want[8:56] = padded[f * 20 + 8 : f * 20 + 56]
                assert np.array_equal(samples, want)


def test_short_clip_fails_and_counts(spark):
    df = rows(spark, [(1000,), (96000,)], "n bigint")
    got = [tuple(r) for r in df.select(signals.mel_frame_count(F.col("n")), signals.frames_out(F.col("n"))).collect()]
    want = []
    for n in (1000, 96000):
        m = n // 160 + 1
        frames = m
        for _ in range(3):
            frames = frames // 2 + 1
        want.append((m, frames))
    assert got == want


def test_normalisation_forms_agree(spark, sample):
    x, _, df = sample
    arrays = signals.normalize_channels(df, ["grp"], "x").select("id", F.posexplode("x").alias("bin", "v"))
    long = signals.per_feature_normalize(
        df.select("id", "grp", F.posexplode("x").alias("bin", "v")), ["grp", "bin"]
    ).select("id", "bin", "v")
    a = {(r["id"], r["bin"]): r["v"] for r in arrays.collect()}
    b = {(r["id"], r["bin"]): r["v"] for r in long.collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    part = x[0::5]
    assert a[(0, 3)] == pytest.approx((part[0, 3] - part[:, 3].mean()) / (part[:, 3].std(ddof=1) + 1e-5))


def test_harmonics(spark):
    offsets = signals.relative_offsets(rows(spark, [(5,)], "n bigint"))
    assert [r["offset"] for r in offsets.orderBy("row").collect()] == list(range(4, -5, -1))
    got = {(r["offset"], r["k"]): r["v"] for r in signals.harmonic_features(offsets.select("offset"), 6).collect()}
    freq = np.exp(-np.arange(3) * 2 * np.log(10000.0) / 6)
    assert got[(3, 2)] == pytest.approx(np.sin(3 * freq[1])) and got[(-2, 5)] == pytest.approx(np.cos(2 * freq[2]))


# ------------------------------------------------------------ parity


def test_debug_blocks(spark):
    text = (
        "noise\n=== BEGIN ===\nShape: [20, 3]\nToken 0 (first 16 values): 1.0 2.0 -3e-1\n"
        "Token 0 (last 16 values): 4.0\nStats: mean=0.1, std=1.5, min=-2.0, max=3.25\n=== END ===\n=== BEGIN ===\nother"
    )
    df = rows(spark, [(text,), ("nothing here",)], "text string")
    got = parity.parse_debug_block(df).collect()
    block = got[0]["block"]
    assert (block["width"], block["frames"], block["first"], block["last"]) == (20, 3, [1.0, 2.0, -0.3], [4.0])
    assert (block["mean"], block["std"], block["min"], block["max"]) == (0.1, 1.5, -2.0, 3.25)
    assert got[1]["block"] is None
    broken = rows(spark, [("=== BEGIN ===\nShape: [20, 3]\n=== END ===",)], "text string")
    with pytest.raises(Exception, match="does not parse"):
        parity.parse_debug_block(broken).collect()


def test_parity_roundtrip(spark, sample):
    x, _, _ = sample
    wide = np.tile(x, (1, 6))
    data = [(i % 3, i // 3, [float(v) for v in r]) for i, r in enumerate(wide)]
    df = rows(spark, data, "utt int, frame int, x array<double>")
    mine = parity.describe_block(df, ["utt"], "frame")
    row = mine.filter("utt = 1").first()
    assert row["std"] == pytest.approx(wide[1::3].std()) and row["mean"] == pytest.approx(wide[1::3].mean())
    logs = mine.select("utt", parity.format_block(mine).alias("text"))
    checks = parity.parity(mine, parity.parse_debug_block(logs), ["utt"])
    assert all(r["ok"] for r in parity.parity_verdict(checks, ["utt"]).collect())
    shifted = df.withColumn("x", F.transform("x", lambda v: v + 0.2))
    verdicts = parity.parity_verdict(
        parity.parity(parity.describe_block(shifted, ["utt"], "frame"), parity.parse_debug_block(logs), ["utt"]), ["utt"]
    )
    assert not any(r["ok"] for r in verdicts.collect())


def test_vector_diff(spark, sample):
    x, y, df = sample
    row = parity.vector_diff(
        df.select("id", F.col("x").alias("v")), df.select("id", F.col("y").alias("v")), ["id"]
    ).first()
    assert row["mae"] == pytest.approx(np.abs(x - y).mean())
    assert row["max_error"] == pytest.approx(np.abs(x - y).max())
    assert row["cosine"] == pytest.approx((x * y).sum() / np.linalg.norm(x) / np.linalg.norm(y))


# ------------------------------------------------------------ tensors


def test_precision_rules(spark):
    data = [
        ("encoder.subsampling.conv_in.weight", 4, 3), ("encoder.layers.0.self_attn.q_proj.weight", 2, 64),
        ("encoder.layers.0.norm_out.weight", 1, 64), ("proj.weight", 2, 64), ("proj.bias", 1, 7),
    ]
    schema = "name string, ndim int, width int"
    got = {r["name"]: r["precision"] for r in tensors.precision_class(rows(spark, data, schema)).collect()}
    assert list(got.values()) == ["f16", "q8_0", "f32", "q8_0", "f32"]
    with pytest.raises(Exception, match="not whole blocks"):
        tensors.precision_class(rows(spark, [("proj.weight", 2, 33)], schema)).collect()


def test_names_both_ways(spark):
    names = ["encoder.pre_encode.conv.3.weight", "encoder.pre_encode.out.bias", "encoder.layers.11.self_attn.linear_pos.weight", "encoder.layers.2.norm_conv.weight", "proj.bias"]
    df = rows(spark, [(n,) for n in names], "name string")
    got = [r["new_name"] for r in tensors.to_canonical(df).collect()]
    assert got == [
        "encoder.subsampling.layers.0.pointwise_conv.weight", "encoder.subsampling.linear.bias",
        "encoder.layers.11.self_attn.relative_k_proj.weight", "encoder.layers.2.norm_conv.weight", "proj.bias",
    ]
    short = tensors.to_short(rows(spark, [(n,) for n in got], "name string"))
    assert [r["new_name"] for r in short.collect()] == [
        "a.conv1d.3.weight", "a.pre_encode.out.bias", "a.blk.11.linear_pos.weight", "a.blk.2.norm_conv.weight", "mm.a.proj.bias",
    ]


def test_layer_run_stops_at_a_gap(spark):
    data = [("a", f"encoder.layers.{i}.norm_out.weight") for i in (0, 1, 2, 4, 5)] + [("b", "proj.weight")]
    counts = tensors.count_layers(rows(spark, data, "ckpt string, name string"))
    assert {r["ckpt"]: r["n_layers"] for r in counts.collect()} == {"a": 3, "b": 0}
    with pytest.raises(Exception, match="no layers in checkpoint b"):
        tensors.require_layers(counts).collect()


def test_rebase_both_axes(spark):
    rng = np.random.default_rng(21)
    n, heads, d_head = 6, 3, 2
    q, norm = rng.normal(size=(n, n)), rng.normal(size=n)
    o, lin = rng.normal(size=(n, n)), rng.normal(size=(2 * n, n))
    residual = matching.barycentric_amounts(rng.random((n, n)))
    head = np.eye(heads)[[2, 0, 1]] / heads
    conv = np.eye(n)[rng.permutation(n)] / n

    def ops_of(group, plan):
        data = [(group, int(i), int(j), float(plan[i, j])) for i, j in zip(*np.nonzero(plan))]
        return matching.operators_from_plan(rows(spark, data, "group string, src int, tgt int, mass double"), ["group"])

    ops = ops_of("residual", residual)
    ops = ops.unionByName(tensors.head_operators(ops_of("block.0.head", head), d_head))
    conv_ops = ops_of("block.0.conv", conv)
    ops = ops.unionByName(conv_ops).unionByName(tensors.glu_operators(conv_ops, n))
    p = "encoder.layers.0."
    named = {p + "self_attn.q_proj.weight": q, p + "self_attn.o_proj.weight": o, p + "conv.pointwise_conv1.weight": lin}
    data = [(k, i, [float(v) for v in r], 2) for k, m in named.items() for i, r in enumerate(m)]
    data.append((p + "norm_out.weight", 0, [float(v) for v in norm], 1))
    data.append(("encoder.subsampling.conv_in.bias", 0, [1.0, 2.0], 1))
    moved = tensors.rebase(rows(spark, data, "name string, row int, values array<double>, ndim int"), ops)
    got = {}
    for r in moved.collect():
        got.setdefault(r["name"], {})[r["row"]] = r["values"]
    A, S = residual * n, residual * n
    H = np.kron(head * heads, np.eye(d_head))
    C = np.kron(np.eye(2), conv * n)
    stack = lambda k: np.array([got[k][i] for i in range(len(got[k]))])
    assert np.allclose(stack(p + "self_attn.q_proj.weight"), H.T @ (q @ S))
    assert np.allclose(stack(p + "self_attn.o_proj.weight"), A.T @ (o @ H))
    assert np.allclose(stack(p + "conv.pointwise_conv1.weight"), C.T @ (lin @ S))
    assert np.allclose(got[p + "norm_out.weight"][0], norm @ A)
    assert got["encoder.subsampling.conv_in.bias"][0] == [1.0, 2.0]
    cells = tensors.tensor_cells(rows(spark, [(p + "x", i, [float(v) for v in r]) for i, r in enumerate(q)], "name string, row int, values array<double>"))
    out = np.zeros((n, n))
    for r in tensors.apply_operator(cells, ops_of("r", residual), "row", "analysis").collect():
        out[r["row"], r["i"]] = r["v"]
    assert np.allclose(out, A.T @ q)
    wide = rows(spark, [(p + "norm_out.weight", 0, [0.0] * (n + 1), 1)], "name string, row int, values array<double>, ndim int")
    with pytest.raises(Exception, match="differ in size"):
        tensors.rebase(wide, ops).collect()


# ------------------------------------------------------------ nothing is lost silently


def _tensor(spark, *cells):
    return rows(spark, list(cells), "name string, row bigint, values array<double>")


def test_arithmetic_refuses_missing_rows_names_and_widths(spark):
    whole = _tensor(spark, ("a", 0, [1.0, 2.0]), ("a", 1, [3.0, 4.0]), ("b", 0, [5.0, 6.0]))
    assert tensors.task_arithmetic(whole, whole, whole, 0.5).count() == 3
    for broken, message in (
        (_tensor(spark, ("a", 0, [1.0, 2.0]), ("b", 0, [5.0, 6.0])), "missing from"),
        (_tensor(spark, ("a", 0, [1.0, 2.0]), ("a", 1, [3.0, 4.0])), "missing from"),
        (_tensor(spark, ("a", 0, [1.0, 2.0]), ("a", 1, [3.0]), ("b", 0, [5.0, 6.0])), "widths differ"),
    ):
        for tables in ((broken, whole, whole), (whole, broken, whole), (whole, whole, broken)):
            with pytest.raises(Exception, match=message):
                tensors.task_arithmetic(*tables, 0.5).collect()
            with pytest.raises(Exception, match=message):
                tensors.lambda_sweep(*tables, [0.5]).collect()
        drift = whole.withColumn("ckpt", F.lit("x")).unionByName(broken.withColumn("ckpt", F.lit("y")))
        with pytest.raises(Exception, match=message):
            tensors.weight_drift(drift, [("x", "y")]).collect()
    narrow = _tensor(spark, ("a", 0, [1.0]), ("a", 1, [3.0, 4.0]), ("b", 0, [5.0, 6.0]))
    with pytest.raises(Exception, match="widths differ"):
        tensors.interpolate(whole, narrow, 0.5).collect()


def test_vector_diff_refuses_one_sided_vectors(spark):
    a = rows(spark, [(1, "g", [1.0]), (2, "g", [2.0])], "id int, g string, v array<double>")
    b = a.filter("id = 1").drop("g")
    for by in ([], ["g"]):
        with pytest.raises(Exception, match="missing from"):
            parity.vector_diff(a, b, ["id"], by=by).collect()


def test_hook_join_refuses_a_missing_target(spark):
    a = rows(spark, [("residual.1", 0, 1.0), ("ffn", 0, 2.0)], "key string, f int, x double")
    b = rows(spark, [("residual.1", 0, 1.0), ("other", 0, 2.0)], "key string, f int, y double")
    with pytest.raises(Exception, match="missing on the right"):
        pairing.match_hook_points(a, b, ["key", "f"]).collect()
    assert pairing.match_hook_points(a.filter("key <> 'ffn'"), b, ["key", "f"]).count() == 1


def test_moments_do_not_depend_on_the_input_partitions(spark, sample):
    _, _, df = sample
    tables = [
        {(r["kind"], r["i"], r["j"]): r["v"] for r in mom.moments(df.repartition(n), full_yy=True).collect()}
        for n in (1, 7, 64)
    ]
    for table in tables[1:]:
        assert table.keys() == tables[0].keys()
        assert all(table[k] == pytest.approx(tables[0][k]) for k in table)
    assert "Coalesce" not in mom.moments(df)._jdf.queryExecution().toString()


def test_layers_without_the_anchor_do_not_count(spark):
    data = [("a", "encoder.layers.0.norm_out.weight"), ("a", "encoder.layers.1.self_attn.q_proj.weight")]
    counts = tensors.count_layers(rows(spark, data, "ckpt string, name string"))
    assert [r["n_layers"] for r in counts.collect()] == [1]


def test_wide_matching_of_many_units():
    rng = np.random.default_rng(8)
    n = 600
    order = rng.permutation(n)
    cost = rng.random((n, n)) + 1.0
    cost[order, np.arange(n)] = rng.random(n) * 0.5
    assert (matching.integral_assignment(cost) == order).all()


# ------------------------------------------------------------ auction


def _cost_table(spark, costs):
    cells = [(g, i, j, float(c[i, j])) for g, c in enumerate(costs) for i, j in np.ndindex(*c.shape)]
    return rows(spark, cells, "grp int, src int, tgt int, cost double")


@pytest.mark.parametrize("shape, width", [((24, 24), 8), ((6, 18), 256)])
def test_auction_costs_what_the_flow_costs(spark, shape, width):
    rng = np.random.default_rng(5)
    costs = [rng.random(shape), rng.integers(0, 4, shape).astype(float), np.ones(shape), 1e9 + rng.random(shape)]
    plan = auction.auction_plan(_cost_table(spark, costs), ["grp"], width=width).collect()
    for g, cost in enumerate(costs):
        cells = [(r.src, r.tgt) for r in plan if r.grp == g]
        assert sorted(t for _, t in cells) == list(range(shape[1]))
        assert set(np.bincount([s for s, _ in cells], minlength=shape[0])) == {shape[1] // shape[0]}
        want = cost[matching.integral_assignment(cost), np.arange(shape[1])].sum()
        assert sum(cost[c] for c in cells) == pytest.approx(want, rel=1e-12, abs=1e-6)


def test_auction_of_a_wide_population(spark):
    """1,024 units whose least plan is known: one cheap cell per target, hidden by a shift of every target."""

    n = 1024
    unit = spark.range(n).select(F.col("id").cast("int").alias("src"))
    cells = unit.withColumn("tgt", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(
        "cost",
        F.abs(F.xxhash64("src", "tgt")) / F.lit(2.0**63) + F.pmod(F.xxhash64("tgt"), F.lit(7))
        + F.when(F.col("src") == (F.col("tgt") * 5 + 3) % n, 0.0).otherwise(1.0),
    )
    plan = auction.auction_plan(cells).collect()
    assert len(plan) == n
    assert all(r.src == (r.tgt * 5 + 3) % n and r.mass == 1 / n for r in plan)


def test_auction_edges(spark):
    one = np.ones((2, 2))
    assert auction.auction_plan(_cost_table(spark, [one]).limit(0), ["grp"]).count() == 0
    assert auction.auction_plan(_cost_table(spark, [np.ones((1, 1))]), ["grp"]).count() == 1
    for broken in ("src < 1 or tgt < 1", "grp < 1 or tgt < 1"):
        with pytest.raises(ValueError, match="holes"):
            auction.auction_plan(_cost_table(spark, [one, one]).filter(broken), ["grp"])
    with pytest.raises(ValueError, match="multiple"):
        auction.auction_plan(_cost_table(spark, [np.ones((3, 2))]), ["grp"])
    with pytest.raises(Exception, match="NaN or infinite"):
        auction.auction_plan(_cost_table(spark, [np.array([[1.0, np.nan], [1.0, 2.0]])]), ["grp"])
