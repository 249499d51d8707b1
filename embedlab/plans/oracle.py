"""SQL that computes the registered queries independently, for a DuckDB check."""

from __future__ import annotations

import re

from embedlab.plans import views


def r(expression: str, digits: int = 6) -> str:
    """Rounded, negative zero folded into zero."""

    rounded = f"round({expression}, {digits})"
    return f"(CASE WHEN {rounded} = 0 THEN 0.0::DOUBLE ELSE {rounded} END)"


PROJECTION = (
    "list_transform(range(96), lambda pr: list_transform(range(64), "
    "lambda pc: (((pr*31 + pc*17) % 97) - 48)::DOUBLE / 384::DOUBLE))"
)
PROJECTION_BIAS = "list_transform(range(96), lambda pr: pr::DOUBLE / 100::DOUBLE)"
BLOCK_WEIGHT_COLUMNS = (
    "list_transform(range(64), lambda bc: list_transform(range(64), "
    "lambda br: (((br*13 + bc*7) % 61) - 30)::DOUBLE / 240::DOUBLE))"
)
EYE = (
    "list_transform(range(64), lambda ec: list_transform(range(64), "
    "lambda er: CASE WHEN er = ec THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END))"
)
ZEROS = "list_transform(range(64), lambda z: 0.0::DOUBLE)"


def sql_list(items) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]"


def f16(v: str) -> str:
    step = f"power(2.0::DOUBLE, greatest(floor(log2(abs({v}))), -14) - 10)"
    return (
        f"(CASE WHEN {v} = 0 THEN 0.0::DOUBLE ELSE round_even({v} / {step}, 0) * {step} END)"
    )


CTE: dict[str, str] = {
    # ---------------------------------------------------------- pairs
    "pairs0": "SELECT vec_id, label::VARCHAR AS grp, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings",
    "pairs": """SELECT vec_id, grp, x, list_transform(range(64), lambda j:
        (0.8::DOUBLE * (1::DOUBLE + 0.01::DOUBLE * j)) * x[((j + 1) % 64) + 1] + 0.1::DOUBLE * x[j + 1]
        + 0.002::DOUBLE * ((((vec_id * 31 + j * 17) % 97) - 48)::DOUBLE / 48::DOUBLE) + 0.01::DOUBLE * j) AS y
        FROM pairs0""",
    "cells": "SELECT vec_id, grp, unnest(range(64)) AS j, unnest(x) AS xv, unnest(y) AS yv FROM pairs",
    "lp0": """SELECT (l_suppkey % 20)::VARCHAR AS grp, l_quantity / 50::DOUBLE AS x0, l_extendedprice / 100000::DOUBLE AS x1,
        l_discount * 10::DOUBLE AS x2, l_tax * 10::DOUBLE AS x3 FROM lineitem""",
    "lp": """SELECT row_number() OVER () AS rid, grp, [x0, x1, x2, x3] AS x,
        [0.9::DOUBLE * x0 + 0.2::DOUBLE * x2, 1.1::DOUBLE * x1 - 0.1::DOUBLE * x3 + 0.05::DOUBLE, x3 - 0.3::DOUBLE * x0,
         0.5::DOUBLE * x2 + 0.25::DOUBLE * x1 * x0] AS y FROM lp0""",
    "lpcost": """SELECT grp, i AS src, j AS tgt, 1 - corr(x[i + 1], y[j + 1]) AS cost FROM lp,
        (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j) GROUP BY 1, 2, 3""",
    # ---------------------------------------------------------- hold-out on pairs
    "heldk": """SELECT grp FROM (SELECT grp, row_number() OVER (ORDER BY grp) AS rn, count(*) OVER () AS n
        FROM (SELECT DISTINCT grp FROM pairs)) WHERE rn <= greatest(1, round_even(n * 0.2, 0))""",
    "split": "SELECT p.*, p.grp IN (SELECT grp FROM heldk) AS held FROM pairs p",
    "lng": "SELECT vec_id, held, unnest(range(64)) AS j, unnest(x) AS xv, unnest(y) AS yv FROM split",
    "fitmom": """SELECT a.j AS i, b.j AS j, covar_pop(a.xv, b.xv) AS cxx, covar_pop(a.xv, b.yv) AS cxy,
        corr(a.xv, b.yv) AS rho FROM lng a JOIN lng b USING (vec_id) WHERE NOT a.held GROUP BY 1, 2""",
    "fitmean": "SELECT list(mx ORDER BY j) AS mx, list(my ORDER BY j) AS my FROM (SELECT j, avg(xv) AS mx, avg(yv) AS my FROM lng WHERE NOT held GROUP BY j)",
    "fitmat": """SELECT list(rx ORDER BY i) AS cxx, list(ry ORDER BY i) AS cxy, sum(dg) / 64 AS meanvar FROM
        (SELECT i, list(cxx ORDER BY j) AS rx, list(cxy ORDER BY j) AS ry, sum(CASE WHEN i = j THEN cxx ELSE 0 END) AS dg FROM fitmom GROUP BY i)""",
    "m_identity": f"SELECT 0 AS ord, 'identity' AS map, NULL::DOUBLE AS alpha, {EYE} AS wt, {ZEROS} AS b",
    "m_permutation": f"""SELECT 1 AS ord, 'permutation' AS map, NULL::DOUBLE AS alpha, list(w ORDER BY j) AS wt, {ZEROS} AS b FROM
        (SELECT j, list_transform(range(64), lambda r: CASE WHEN r = best THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS w FROM
         (SELECT j, arg_max(i, rho) AS best FROM fitmom GROUP BY j))""",
    "diagc": """SELECT j, regr_slope(yv, xv) AS s, avg(yv) - regr_slope(yv, xv) * avg(xv) AS b FROM lng WHERE NOT held GROUP BY j""",
    "m_diagonal": """SELECT 2 AS ord, 'diagonal' AS map, NULL::DOUBLE AS alpha,
        list(list_transform(range(64), lambda r: CASE WHEN r = j THEN s ELSE 0.0::DOUBLE END) ORDER BY j) AS wt, list(b ORDER BY j) AS b FROM diagc""",
    # polar factor by the cubic Newton-Schulz iteration, 40 steps
    "ns": """SELECT 0 AS k, list_transform(cxy, lambda row: list_transform(row, lambda v: v / nrm)) AS m FROM
        (SELECT cxy, sqrt(list_sum(list_transform(cxy, lambda row: list_dot_product(row, row)))) AS nrm FROM fitmat)
        UNION ALL
        SELECT k + 1, list_transform(list_zip(m, g), lambda z: list_transform(list_zip(z[1], t), lambda q: 1.5::DOUBLE * q[1] - 0.5::DOUBLE * list_dot_product(z[2], q[2])))
        FROM (SELECT k, m, list_transform(m, lambda a: list_transform(m, lambda c: list_dot_product(a, c))) AS g,
              list_transform(range(1, 65), lambda j: list_transform(m, lambda row: row[j])) AS t FROM ns WHERE k < 40)""",
    "m_orthogonal": """SELECT 3 AS ord, 'orthogonal' AS map, NULL::DOUBLE AS alpha, wt,
        list_transform(range(1, 65), lambda j: my[j] - list_dot_product(mx, wt[j])) AS b FROM
        (SELECT my, mx, list_transform(range(1, 65), lambda j: list_transform(m, lambda row: row[j] * f)) AS wt FROM
         (SELECT m, my, mx, list_sum(list_transform(list_zip(m, cxy), lambda z: list_dot_product(z[1], z[2]))) / (64 * meanvar) AS f
          FROM ns, fitmat, fitmean WHERE k = 40))""",
    "alphas": "SELECT unnest([1e-4, 1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0, 1000.0]::DOUBLE[]) AS alpha",
    # Gauss-Jordan elimination on the augmented rows, one pivot per step
    "gj": """SELECT alpha, 0 AS k, list_transform(list_zip(cxx, cxy), lambda z, i: list_concat(
            list_transform(z[1], lambda v, c: CASE WHEN c = i THEN v + alpha * meanvar ELSE v END), z[2])) AS m FROM alphas, fitmat
        UNION ALL
        SELECT alpha, k + 1, list_transform(m, lambda row, i: CASE WHEN i = k + 1 THEN piv ELSE
            list_transform(list_zip(row, piv), lambda z: z[1] - row[k + 1] * z[2]) END)
        FROM (SELECT alpha, k, m, list_transform(m[k + 1], lambda v: v / m[k + 1][k + 1]) AS piv FROM gj WHERE k < 64)""",
    "m_ridge": """SELECT 3 + row_number() OVER (ORDER BY alpha) AS ord, 'ridge' AS map, alpha, wt,
        list_transform(range(1, 65), lambda j: my[j] - list_dot_product(mx, wt[j])) AS b FROM
        (SELECT alpha, my, mx, list_transform(range(65, 129), lambda j: list_transform(m, lambda row: row[j])) AS wt FROM gj, fitmean WHERE k = 64)""",
    # ---------------------------------------------------------- projection
    "proj": f"SELECT {PROJECTION} AS p, {PROJECTION_BIAS} AS pb",
    "ev": """SELECT vec_id, x, list_transform(list_zip(p, pb), lambda z: list_dot_product(z[1], y) + z[2]) AS t FROM split, proj WHERE held""",
    # ---------------------------------------------------------- recordings, takes, utterances, signals
    "recordings": "SELECT source || '/' || lang || '/' || doc_id || '.flac' AS path, source AS grp, n_chars AS n_samples FROM documents",
    "takes": "SELECT role AS lang, conv_id AS sentence_id, turn AS ord, conv_id || '_' || turn || '.wav' AS path FROM conversations",
    "utterances": "SELECT vec_id // 4 AS utt, (vec_id // 4) % 3 AS lang, vec_id % 4 AS frame, x, y FROM pairs",
    "signals": "SELECT user_id AS clip, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS v FROM events",
    # ---------------------------------------------------------- retrieval
    "bcells": "SELECT vec_id, unnest(range(64)) AS j, unnest(x) AS xv, unnest(y) AS yv FROM pairs",
    "bmom": """SELECT a.j AS i, b.j AS j, covar_pop(a.yv, b.yv) AS cxx, covar_pop(a.yv, b.xv) AS cxy FROM bcells a JOIN bcells b USING (vec_id) GROUP BY 1, 2""",
    "bmean": "SELECT list(mx ORDER BY j) AS mx, list(my ORDER BY j) AS my FROM (SELECT j, avg(yv) AS mx, avg(xv) AS my FROM bcells GROUP BY j)",
    "bmat": """SELECT list(rx ORDER BY i) AS cxx, list(ry ORDER BY i) AS cxy, sum(dg) / 64 AS meanvar FROM
        (SELECT i, list(cxx ORDER BY j) AS rx, list(cxy ORDER BY j) AS ry, sum(CASE WHEN i = j THEN cxx ELSE 0 END) AS dg FROM bmom GROUP BY i)""",
    "bgj": """SELECT 0 AS k, list_transform(list_zip(cxx, cxy), lambda z, i: list_concat(
            list_transform(z[1], lambda v, c: CASE WHEN c = i THEN v + 0.01::DOUBLE * meanvar ELSE v END), z[2])) AS m FROM bmat
        UNION ALL
        SELECT k + 1, list_transform(m, lambda row, i: CASE WHEN i = k + 1 THEN piv ELSE
            list_transform(list_zip(row, piv), lambda z: z[1] - row[k + 1] * z[2]) END)
        FROM (SELECT k, m, list_transform(m[k + 1], lambda v: v / m[k + 1][k + 1]) AS piv FROM bgj WHERE k < 64)""",
    "bmap": """SELECT wt, list_transform(range(1, 65), lambda j: my[j] - list_dot_product(mx, wt[j])) AS b FROM
        (SELECT my, mx, list_transform(range(65, 129), lambda j: list_transform(m, lambda row: row[j])) AS wt FROM bgj, bmean WHERE k = 64)""",
    "ucells": "SELECT lang, utt, unnest(range(64)) AS j, unnest(x) AS xv, unnest(y) AS yv FROM utterances",
    "pooled": """SELECT lang, utt, list(xm ORDER BY j) AS x, list(ym ORDER BY j) AS y FROM
        (SELECT lang, utt, j, avg(xv) AS xm, avg(yv) AS ym FROM ucells GROUP BY lang, utt, j) GROUP BY lang, utt""",
    "sets": """SELECT lang, utt, 'raw' AS probe, y AS v, x AS r FROM pooled
        UNION ALL SELECT lang, utt, 'same', x, x FROM pooled
        UNION ALL SELECT lang, utt, 'map', list_transform(list_zip(wt, b), lambda z: list_dot_product(y, z[1]) + z[2]), x FROM pooled, bmap""",
    "setmeans": """SELECT lang, probe, list(vm ORDER BY j) AS vm, list(rm ORDER BY j) AS rm FROM
        (SELECT lang, probe, j, avg(vv) AS vm, avg(rv) AS rm FROM
         (SELECT lang, probe, unnest(range(64)) AS j, unnest(v) AS vv, unnest(r) AS rv FROM sets) GROUP BY lang, probe, j) GROUP BY lang, probe""",
    "shifted": """SELECT lang, probe, utt, list_transform(list_zip(v, vm), lambda z: z[1] - z[2]) AS v,
        list_transform(list_zip(r, rm), lambda z: z[1] - z[2]) AS r FROM sets JOIN setmeans USING (lang, probe)""",
    "unit": """SELECT lang, probe, utt, list_transform(v, lambda a: a / nv) AS v, list_transform(r, lambda a: a / nr) AS r FROM
        (SELECT *, greatest(sqrt(list_dot_product(v, v)), 1e-12) AS nv, greatest(sqrt(list_dot_product(r, r)), 1e-12) AS nr FROM shifted)""",
    "ranks": """SELECT a.lang AS language, a.probe, a.utt,
        1 + sum(CASE WHEN b.utt <> a.utt AND list_dot_product(a.v, b.r) > list_dot_product(a.v, a.r) THEN 1 ELSE 0 END)::BIGINT AS rank
        FROM unit a JOIN unit b USING (lang, probe) GROUP BY 1, 2, 3""",
    "rettab": f"""SELECT language, probe, count(*) AS n, {r("avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END)")} AS top1,
        {r("avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END)")} AS top5, {r("median(rank)::DOUBLE")} AS median_rank,
        {r("1.0::DOUBLE / count(*)")} AS chance_top1 FROM ranks GROUP BY 1, 2""",
    # ---------------------------------------------------------- matching
    "cost": "SELECT 'residual' AS \"group\", a.j AS src, b.j AS tgt, 1 - corr(a.xv, b.yv) AS cost FROM cells a JOIN cells b USING (vec_id) GROUP BY a.j, b.j",
    "plan": "SELECT \"group\", arg_min(src, cost) AS src, tgt, 1.0::DOUBLE / 64 AS mass FROM cost GROUP BY \"group\", tgt",
    # ---------------------------------------------------------- signals, N = 16
    "sizes": "SELECT clip, max(t) + 1 AS n, (max(t) + 1 + 16 - 16) // 4 + 1 AS nf FROM signals GROUP BY clip",
    "pre": "SELECT clip, t, v - coalesce(0.97::DOUBLE * lag(v) OVER (PARTITION BY clip ORDER BY t), 0) AS v FROM signals",
    "grid": "SELECT clip, unnest(range(nf)) AS frame FROM sizes",
    "slots": "SELECT clip, frame, unnest(range(16)) AS pos FROM grid",
    "filled": """SELECT s.clip, s.frame, s.pos, CASE WHEN s.pos >= 2 AND s.pos < 14 THEN coalesce(g.v, 0) ELSE 0 END AS v
        FROM slots s LEFT JOIN signals g ON g.clip = s.clip AND g.t = s.frame * 4 + s.pos - 8""",
    "filledpre": """SELECT s.clip, s.frame, s.pos, CASE WHEN s.pos >= 2 AND s.pos < 14 THEN coalesce(g.v, 0) ELSE 0 END AS v
        FROM slots s LEFT JOIN pre g ON g.clip = s.clip AND g.t = s.frame * 4 + s.pos - 8""",
}


def _dft(source: str) -> str:
    turn = "2 * pi() * bin * pos / 16"
    return f"""SELECT clip, frame, bin, power(sum(w * cos({turn})), 2) + power(sum(w * sin({turn})), 2) AS p FROM
        (SELECT clip, frame, pos, v * ((pos - 1)::DOUBLE / 12) AS w FROM {source} WHERE pos >= 2 AND pos < 14),
        (SELECT unnest(range(9)) AS bin) GROUP BY clip, frame, bin"""


CTE["power"] = _dft("filled")
CTE["powerpre"] = _dft("filledpre")
CTE["mel"] = """SELECT clip, frame, f AS bin, ln(sum(p * ((((f + 1) * (bin + 1)) % 5)::DOUBLE / 4)) + power(2.0::DOUBLE, -24)) AS v
    FROM powerpre, (SELECT unnest(range(4)) AS f) GROUP BY clip, frame, f"""

# ---------------------------------------------------------------- blocks and tensors
CTE["blockcells"] = "SELECT utt, frame, unnest(x) AS xv, unnest(y) AS yv, CASE WHEN utt % 2 = 0 THEN unnest(x) ELSE unnest(y) END AS zv FROM utterances"
CTE["ends"] = """SELECT utt, arg_min(x, frame) AS x0, arg_min(CASE WHEN utt % 2 = 0 THEN x ELSE y END, frame) AS z0, count(*) AS frames
    FROM utterances GROUP BY utt"""
CTE["blockstats"] = """SELECT utt, avg(xv) AS mean, stddev_pop(xv) AS std, min(xv) AS lo, max(xv) AS hi, sum(xv) AS total,
    avg(zv) AS zmean, stddev_pop(zv) AS zstd, min(zv) AS zlo, max(zv) AS zhi FROM blockcells GROUP BY utt"""
_six = lambda e: f"printf('%.6f', {e})::DOUBLE"
_worst = lambda a, b: (
    f"list_max(list_transform(list_zip(x0[{a}:{b}], z0[{a}:{b}]), lambda z: abs(z[1] - {_six('z[2]')}))) / greatest(std, 1e-9)"
)
CTE["checks"] = "\nUNION ALL ".join(
    [f"SELECT utt, '{name}' AS \"check\", 0.0::DOUBLE AS delta, true AS ok FROM ends" for name in ("block", "shape")]
    + [
        f"SELECT utt, '{name}', {delta}, {delta} < 0.05 FROM blockstats JOIN ends USING (utt)"
        for name, delta in {
            "first": _worst(1, 16),
            "last": _worst(49, 64),
            "mean": f"abs(mean - {_six('zmean')}) / greatest(std, 1e-9)",
            "std": f"abs(std - {_six('zstd')}) / greatest(std, 1e-9)",
            "min": f"abs(lo - {_six('zlo')}) / greatest(std, 1e-9)",
            "max": f"abs(hi - {_six('zhi')}) / greatest(std, 1e-9)",
        }.items()
    ]
)
CTE["tensors"] = """SELECT 'base' AS ckpt, 'encoder.layers.' || grp || '.self_attn.q_proj.weight' AS name, vec_id AS row, x AS vals FROM pairs
    UNION ALL SELECT 'descendant', 'encoder.layers.' || grp || '.self_attn.q_proj.weight', vec_id, y FROM pairs
    UNION ALL SELECT 'ancestor', 'encoder.layers.' || grp || '.self_attn.q_proj.weight', vec_id, list_transform(x, lambda v: v * 0.5::DOUBLE) FROM pairs"""
CTE["catalog"] = f"""SELECT ckpt, name, CASE WHEN name LIKE '%bias' OR name LIKE '%bias_u' OR regexp_matches(name, '(norm|norm_out)\\.weight$') THEN 1 ELSE 2 END AS ndim,
    q AS rows, q * 32 AS width FROM (SELECT l_orderkey AS ckpt,
      CASE WHEN l_partkey % 5 = 0 THEN {sql_list(views.CATALOG_TOP)}[(l_suppkey % 4) + 1]
      ELSE 'encoder.layers.' || (l_linenumber - 1) || '.' || {sql_list(views.CATALOG_SUFFIXES)}[(l_partkey % 8) + 1] END AS name,
      max(l_quantity::BIGINT) AS q FROM lineitem GROUP BY 1, 2)"""


# Fixed values, written out here so that a wrong entry in the engine's own tables is noticed: the names
# that occur in the catalogue view, their short forms, and which of them are kept at which precision.
CHECKED_NAMES = {
    "self_attn.linear_k.weight": "self_attn.k_proj.weight",
    "conv.batch_norm.weight": "conv.norm.weight",
}
CHECKED_SHORT_NAMES = {
    "self_attn.q_proj.weight": "attn_q.weight",
    "self_attn.k_proj.weight": "attn_k.weight",
    "self_attn.bias_u": "pos_bias_u",
    "norm_out.weight": "ln2.weight",
    "feed_forward1.linear1.weight": "ffn_up.weight",
    "conv.pointwise_conv1.weight": "conv_pw1.weight",
    "conv.depthwise_conv.weight": "conv_dw.weight",
    "conv.norm.weight": "conv_norm.weight",
}
CHECKED_F16 = ["conv.pointwise_conv1.weight"]
CHECKED_Q8 = ["self_attn.q_proj.weight", "feed_forward1.linear1.weight", "proj.weight"]
CHECKED_COMPANIONS = ["proj.weight", "proj.bias", "preprocessor.featurizer.fb", "preprocessor.featurizer.window"]


def _renamed(source: str) -> str:
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in CHECKED_NAMES.items())
    return f"""SELECT ckpt, name, ndim, rows, width, CASE WHEN regexp_matches(name, '^encoder\\.layers\\.\\d+\\.')
        THEN regexp_extract(name, '^encoder\\.layers\\.\\d+\\.') || (CASE regexp_replace(name, '^encoder\\.layers\\.\\d+\\.', '') {cases}
            ELSE regexp_replace(name, '^encoder\\.layers\\.\\d+\\.', '') END) ELSE name END AS new_name FROM {source}"""


CTE["canon"] = _renamed("catalog")
_short = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in CHECKED_SHORT_NAMES.items())
CTE["short"] = f"""SELECT ckpt, new_name AS name, CASE WHEN regexp_matches(new_name, '^encoder\\.layers\\.\\d+\\.')
    THEN 'a.blk.' || regexp_extract(new_name, '^encoder\\.layers\\.(\\d+)\\.', 1) || '.' ||
        (CASE regexp_replace(new_name, '^encoder\\.layers\\.\\d+\\.', '') {_short} END)
    ELSE CASE new_name WHEN 'proj.weight' THEN 'mm.a.proj.weight' WHEN 'proj.bias' THEN 'mm.a.proj.bias'
        WHEN 'preprocessor.featurizer.fb' THEN 'a.mel_filters' WHEN 'preprocessor.featurizer.window' THEN 'a.window' END END AS new_name FROM canon"""
_ends = lambda column, names: "(" + " OR ".join(f"ends_with({column}, '{s}')" for s in names) + ")"
CTE["classes"] = f"""SELECT ckpt, name, CASE WHEN {_ends("name", CHECKED_F16)} THEN 'f16'
    WHEN ndim = 2 AND {_ends("name", CHECKED_Q8)} THEN 'q8_0' ELSE 'f32' END AS precision FROM catalog"""


def q(body: str) -> str:
    """The body with the views it uses, directly or through other views, in front."""

    needed: set[str] = set()
    queue = [body]
    while queue:
        text = queue.pop()
        for name in CTE:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                queue.append(CTE[name])
    parts = [f"{name} AS ({CTE[name]})" for name in _ordered(needed)]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body


def _ordered(needed: set[str]) -> list[str]:
    out: list[str] = []

    def visit(name: str) -> None:
        if name in out:
            return
        for other in CTE:
            if other != name and other in needed and re.search(rf"\b{other}\b", CTE[name]):
                visit(other)
        out.append(name)

    for name in CTE:
        if name in needed:
            visit(name)
    return out


# ---------------------------------------------------------------- scoring


def _score(maps: str, target: str = "plain", columns: str = "", digits: int = 6, prefix: str = "") -> str:
    """Scores per map. ``maps`` is a query of (ord, map, alpha, wt, b), wt by output column."""

    rows = (
        "SELECT vec_id, x, y AS t FROM split WHERE held" if target == "plain" else "SELECT vec_id, x, t FROM ev"
    )
    return f"""
      SELECT ord, map, alpha, 1 - sse / greatest(sst, 1e-12) AS r2, sqrt(sse / greatest(energy, 1e-12)) AS relative_error,
             cosine_mean, cosine_p05
      FROM (SELECT ord, map, alpha, sum(err) AS sse, avg(cos) AS cosine_mean, quantile_cont(cos, 0.05) AS cosine_p05 FROM
        (SELECT ord, map, alpha, list_sum(list_transform(list_zip(g, t), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS err,
                list_dot_product(g, t) / (greatest(sqrt(list_dot_product(g, g)), 1e-8) * greatest(sqrt(list_dot_product(t, t)), 1e-8)) AS cos
         FROM (SELECT ord, map, alpha, t, list_transform(list_zip(wt, b), lambda z: list_dot_product(x, z[1]) + z[2]) AS g
               FROM ({rows}) AS er, ({maps}) AS ms)) GROUP BY ord, map, alpha) AS s,
      (SELECT sum(vp * n) AS sst, sum(sq) AS energy FROM (SELECT u, var_pop(tv) AS vp, count(*) AS n, sum(tv * tv) AS sq
         FROM (SELECT unnest(range(len(t))) AS u, unnest(t) AS tv FROM ({rows})) GROUP BY u)) AS spread"""


def _lift(maps: str) -> str:
    """Maps composed with the projection: columns of P W' as output columns."""

    return f"""SELECT ord, map, alpha, list_transform(p, lambda prow: list_transform(wr, lambda wrow: list_dot_product(prow, wrow))) AS wt,
        list_transform(list_zip(p, pb), lambda z: list_dot_product(z[1], b) + z[2]) AS b FROM
        (SELECT ord, map, alpha, b, list_transform(range(1, 65), lambda i: list_transform(wt, lambda col: col[i])) AS wr FROM ({maps})), proj"""


def _quantised(maps: str) -> str:
    """Each output row of a lifted map in blocks of 32, quantised and restored."""

    peak = "list_max(list_transform(blk, lambda a: abs(a)))"
    return f"""SELECT ord, map, alpha, list(wq ORDER BY o) AS wt, any_value(b) AS b FROM
        (SELECT ord, map, alpha, o, any_value(b) AS b, flatten(list(vals ORDER BY half)) AS wq FROM
          (SELECT ord, map, alpha, o, b, half, list_transform(blk, lambda v: CASE WHEN amax > 0
              THEN greatest(-128, least(127, round_even(v / (amax / 127), 0))) ELSE 0 END * sc) AS vals FROM
            (SELECT *, {f16("(amax / 127)")} AS sc FROM
              (SELECT *, {peak} AS amax FROM
                (SELECT ord, map, alpha, o, b, half, w[half * 32 + 1 : half * 32 + 32] AS blk FROM
                  (SELECT ord, map, alpha, b, unnest(range(96)) AS o, unnest(wt) AS w FROM ({_lift(maps)})), (SELECT unnest([0, 1]) AS half)))))
         GROUP BY ord, map, alpha, o) GROUP BY ord, map, alpha"""


_METRICS = ["r2", "relative_error", "cosine_mean", "cosine_p05"]


def _plain_scores(maps: str) -> str:
    listed = ", ".join(f"{r(m)} AS {m}" for m in _METRICS)
    return q(f"SELECT map, {listed} FROM ({_score(maps)})")


def _named(*names: str) -> str:
    return " UNION ALL ".join(f"SELECT ord, map, alpha, wt, b FROM m_{n}" for n in names)


def _flag(source: str, criterion: str) -> str:
    return f"""SELECT *, row_number() OVER (ORDER BY {criterion} DESC, alpha) = 1 AS is_best,
        row_number() OVER (ORDER BY {criterion} DESC, alpha) = 1 AND (alpha = min(alpha) OVER () OR alpha = max(alpha) OVER ()) AS at_edge FROM ({source})"""


def _both(maps: str) -> str:
    return f"""SELECT a.*, d.r2 AS deployed_r2, d.cosine_mean AS deployed_cosine_mean
        FROM ({_score(_lift(maps), "projected")}) a JOIN ({_score(_quantised(maps), "projected")}) d ON a.ord = d.ord"""


_LADDER = f"""SELECT * FROM ({_both(_named("identity", "permutation", "diagonal", "orthogonal", "ridge"))})
    QUALIFY map <> 'ridge' OR row_number() OVER (PARTITION BY map ORDER BY deployed_r2 DESC, alpha) = 1"""
_LADDER_COLUMNS = ["r2", "relative_error", "cosine_mean", "cosine_p05", "deployed_r2", "deployed_cosine_mean"]

# ---------------------------------------------------------------- moments in SQL


def _moment_rows(source: str, width: int, key: str, by: str = "", full: bool = True, digits: int = 6) -> str:
    """Long moments of a pairs view by joining its cells."""

    b = f"{by}, " if by else ""
    g = f"GROUP BY {by}" if by else ""
    long = f"SELECT {key} AS rid, {b}unnest(range({width})) AS j, unnest(x) AS xv, unnest(y) AS yv FROM {source}"
    both = f"FROM ({long}) a JOIN ({long}) c USING (rid)"
    ab = f"a.{by} AS {by}, " if by else ""
    yy = "" if full else " WHERE a.j = c.j"
    return f"""SELECT {b}kind, i, j, {r("v", digits)} AS v FROM (
        SELECT {b}'n' AS kind, 0::BIGINT AS i, 0::BIGINT AS j, count(*)::DOUBLE AS v FROM {source} {g}
        UNION ALL SELECT {b}'sx', j, 0, sum(xv) FROM ({long}) GROUP BY {b}j
        UNION ALL SELECT {b}'sy', j, 0, sum(yv) FROM ({long}) GROUP BY {b}j
        UNION ALL SELECT {ab}'sxx', a.j, c.j, sum(a.xv * c.xv) {both} GROUP BY ALL
        UNION ALL SELECT {ab}'sxy', a.j, c.j, sum(a.xv * c.yv) {both} GROUP BY ALL
        UNION ALL SELECT {ab}'syy', a.j, c.j, sum(a.yv * c.yv) {both}{yy} GROUP BY ALL)"""


def _r2_from_lines(slope: str, offset: str) -> str:
    """R2 summed over the channels of line items, a line per channel."""

    return f"""1 - sum(CASE WHEN half = 'eval' THEN sse ELSE 0 END) / sum(CASE WHEN half = 'eval' THEN sst ELSE 0 END)"""


_FLIPPED = """SELECT normalized, grp, vec_id, j, xv, yv, grp IN (SELECT grp FROM heldk) AS held FROM
   (SELECT false AS normalized, grp, vec_id, j, xv, yv FROM cells
    UNION ALL SELECT true, grp, vec_id, j, (xv - avg(xv) OVER w) / (stddev_samp(xv) OVER w + 1e-5), yv FROM cells
    WINDOW w AS (PARTITION BY grp, j))"""


def _channel_r2(source: str, keys: str, maps: tuple[str, ...] = ("identity", "diagonal")) -> str:
    """R2 of the identity and the per-channel line for cells (keys, j, xv, yv, held)."""

    lines = f"SELECT {keys}, j, regr_slope(yv, xv) AS s, avg(yv) - regr_slope(yv, xv) * avg(xv) AS b FROM ({source}) WHERE NOT held GROUP BY {keys}, j"
    spread = f"SELECT {keys}, sum(vp) AS sst FROM (SELECT {keys}, j, var_pop(yv) * count(*) AS vp FROM ({source}) WHERE held GROUP BY {keys}, j) GROUP BY {keys}"
    parts = []
    if "identity" in maps:
        parts.append(f"SELECT {keys}, 'identity' AS map, sum((xv - yv) * (xv - yv)) AS sse FROM ({source}) WHERE held GROUP BY {keys}")
    if "diagonal" in maps:
        parts.append(
            f"SELECT {keys}, 'diagonal' AS map, sum((xv * s + b - yv) * (xv * s + b - yv)) AS sse FROM ({source}) JOIN ({lines}) USING ({keys}, j) WHERE held GROUP BY {keys}"
        )
    return f"SELECT {keys}, map, 1 - sse / sst AS r2 FROM ({' UNION ALL '.join(parts)}) JOIN ({spread}) USING ({keys})"


def _ridge_small() -> str:
    """Ridge on four channels per supplier group."""

    return f"""SELECT grp, i - 1 AS i, j - 1 AS j, {r("w")} AS w FROM
      (SELECT grp, unnest(range(1, 5)) AS i, m, 0 AS z FROM gj4 WHERE k = 4) AS s, LATERAL (SELECT unnest(range(1, 5)) AS j) AS l, LATERAL (SELECT m[i][4 + j] AS w)
      UNION ALL
      SELECT grp, -1, j - 1, {r("my[j] - (mx[1] * m[1][4 + j] + mx[2] * m[2][4 + j] + mx[3] * m[3][4 + j] + mx[4] * m[4][4 + j])")} AS w
      FROM gj4 JOIN mean4 USING (grp), LATERAL (SELECT unnest(range(1, 5)) AS j) AS l WHERE k = 4"""


CTE["lpcells"] = "SELECT rid, grp, unnest(range(4)) AS j, unnest(x) AS xv, unnest(y) AS yv FROM lp"
CTE["mean4"] = "SELECT grp, list(mx ORDER BY j) AS mx, list(my ORDER BY j) AS my FROM (SELECT grp, j, avg(xv) AS mx, avg(yv) AS my FROM lpcells GROUP BY grp, j) GROUP BY grp"
CTE["mom4"] = "SELECT a.grp, a.j AS i, b.j AS j, covar_pop(a.xv, b.xv) AS cxx, covar_pop(a.xv, b.yv) AS cxy FROM lpcells a JOIN lpcells b USING (rid) GROUP BY 1, 2, 3"
CTE["mat4"] = """SELECT grp, list(rx ORDER BY i) AS cxx, list(ry ORDER BY i) AS cxy, sum(dg) / 4 AS meanvar FROM
    (SELECT grp, i, list(cxx ORDER BY j) AS rx, list(cxy ORDER BY j) AS ry, sum(CASE WHEN i = j THEN cxx ELSE 0 END) AS dg FROM mom4 GROUP BY grp, i) GROUP BY grp"""
CTE["gj4"] = """SELECT grp, 0 AS k, list_transform(list_zip(cxx, cxy), lambda z, i: list_concat(
        list_transform(z[1], lambda v, c: CASE WHEN c = i THEN v + 0.1::DOUBLE * meanvar ELSE v END), z[2])) AS m FROM mat4
    UNION ALL
    SELECT grp, k + 1, list_transform(m, lambda row, i: CASE WHEN i = k + 1 THEN piv ELSE
        list_transform(list_zip(row, piv), lambda z: z[1] - row[k + 1] * z[2]) END)
    FROM (SELECT grp, k, m, list_transform(m[k + 1], lambda v: v / m[k + 1][k + 1]) AS piv FROM gj4 WHERE k < 4)"""

# maps fitted on all rows
CTE["allmom"] = """SELECT a.j AS i, b.j AS j, covar_pop(a.xv, b.xv) AS cxx, covar_pop(a.xv, b.yv) AS cxy FROM cells a JOIN cells b USING (vec_id) GROUP BY 1, 2"""
CTE["allmean"] = "SELECT list(mx ORDER BY j) AS mx, list(my ORDER BY j) AS my FROM (SELECT j, avg(xv) AS mx, avg(yv) AS my FROM cells GROUP BY j)"
CTE["allmat"] = """SELECT list(ry ORDER BY i) AS cxy, sum(dg) AS tr FROM
    (SELECT i, list(cxy ORDER BY j) AS ry, sum(CASE WHEN i = j THEN cxx ELSE 0 END) AS dg FROM allmom GROUP BY i)"""
CTE["allns"] = CTE["ns"].replace("fitmat", "allmat").replace("FROM ns WHERE", "FROM allns WHERE")
CTE["allorth"] = """SELECT wt, list_transform(range(1, 65), lambda j: my[j] - list_dot_product(mx, wt[j])) AS b FROM
    (SELECT my, mx, list_transform(range(1, 65), lambda j: list_transform(m, lambda row: row[j] * f)) AS wt FROM
     (SELECT m, my, mx, list_sum(list_transform(list_zip(m, cxy), lambda z: list_dot_product(z[1], z[2]))) / tr AS f
      FROM allns, allmat, allmean WHERE k = 40))"""
CTE["allline"] = "SELECT j, regr_slope(yv, xv) AS s, avg(yv) - regr_slope(yv, xv) * avg(xv) AS b FROM cells GROUP BY j"

_IJ = "SELECT i, j FROM (SELECT unnest(range(64)) AS i), (SELECT unnest(range(64)) AS j)"

# ---------------------------------------------------------------- the checks

ORACLE: dict[str, str] = {
    "pairs_checksum": q(f"SELECT grp, count(*) AS n, {r('sum(list_sum(x))')} AS sum_x, {r('sum(list_sum(y))')} AS sum_y FROM pairs GROUP BY grp"),
    "recording_sample": q("SELECT path, least(n_samples - 400, 250)::BIGINT AS offset, 0.4::DOUBLE AS seconds FROM recordings WHERE n_samples >= 400 ORDER BY md5('0' || path), path LIMIT 100"),
    "recording_groups": q(f"SELECT grp, count(*) AS n, {r('sum(n_samples / 1000::DOUBLE)', 3)} AS seconds, sum(round_even(n_samples / 8::DOUBLE, 0)::BIGINT)::BIGINT AS eighths FROM recordings WHERE n_samples >= 400 GROUP BY grp"),
    "holdout_counts": q("""SELECT CASE WHEN rn <= greatest(1, round_even(g * 0.2, 0)) THEN 'eval' ELSE 'fit' END AS split, count(*) AS n_groups, sum(n)::BIGINT AS n_rows FROM
        (SELECT grp, count(*) AS n, row_number() OVER (ORDER BY grp) AS rn, count(*) OVER () AS g FROM recordings GROUP BY grp) GROUP BY 1"""),
    "crop_text": "SELECT source || '/' || lang || '/' || doc_id || '.flac' AS path, substring(text, least(n_chars - 400, 250) + 1, 400) AS crop FROM documents WHERE n_chars >= 400",
    "batch_sizes": q("""SELECT (rn - 1) // 64 AS batch_id, count(*) AS n, min(path) AS first_path, max(path) AS last_path FROM
        (SELECT path, row_number() OVER (ORDER BY path) AS rn FROM recordings) GROUP BY 1"""),
    "capped_rows": q("SELECT utt, frame FROM utterances ORDER BY utt, frame LIMIT 300"),
    "frame_units": q(f"SELECT lang, j AS unit, count(*) AS n, {r('sum(xv)')} AS total, {r('max(xv)')} AS top FROM ucells GROUP BY lang, j"),
    "rate_quarantine": q("SELECT CASE WHEN n_samples % 7 = 0 THEN 'rate 8000' ELSE 'ok' END AS status, count(*) AS n FROM recordings GROUP BY 1"),
    "downmix": f"SELECT user_id AS clip, event_id AS t, {r('value * 0.75::DOUBLE + 0.5::DOUBLE')} AS v FROM events",
    "hook_groups": q(f"""SELECT CASE WHEN grp::INT < 3 THEN 'residual' ELSE 'block.' || grp || '.ffn1' END AS grp, count(*) AS n,
        {r('sum(list_dot_product(x, y))')} AS "cross" FROM pairs WHERE grp::INT < 8 GROUP BY 1"""),
    "moments_long": q(_moment_rows("lp", 4, "rid", digits=4)),
    "merged_moments": q(_moment_rows("lp", 4, "rid", full=False, digits=4)),
    "moments_wide": q(_moment_rows("pairs", 64, "vec_id", "grp", full=False)),
    "covariance": q(f"SELECT a.j AS i, b.j AS j, {r('covar_pop(a.xv, b.xv)')} AS cxx, {r('covar_pop(a.xv, b.yv)')} AS cxy FROM lpcells a JOIN lpcells b USING (rid) GROUP BY 1, 2"),
    "diagonal_score": _plain_scores(_named("diagonal")),
    "identity_score": _plain_scores(_named("identity")),
    "permutation_score": _plain_scores(_named("permutation")),
    "orthogonal_score": _plain_scores(_named("orthogonal")),
    "ridge_score": q(f"SELECT alpha, {', '.join(f'{r(m)} AS {m}' for m in _METRICS)}, is_best, at_edge FROM ({_flag(_score(_named('ridge')), 'r2')})"),
    "ridge_sweep": q(f"SELECT alpha, {', '.join(f'{r(m, 5)} AS {m}' for m in ['r2', 'deployed_r2', 'deployed_cosine_mean'])}, is_best, at_edge FROM ({_flag(_both(_named('ridge')), 'deployed_r2')})"),
    "ridge_by_group": q(_ridge_small()),
    "map_weights": q(f"""SELECT 'identity' AS map, i, j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS w FROM ({_IJ})
        UNION ALL SELECT 'identity', -1, j, 0.0::DOUBLE FROM (SELECT unnest(range(64)) AS j)
        UNION ALL SELECT 'diagonal', i, j, CASE WHEN i = j THEN {r('s')} ELSE 0.0::DOUBLE END FROM ({_IJ}) JOIN allline USING (j)
        UNION ALL SELECT 'diagonal', -1, j, {r('b')} FROM allline
        UNION ALL SELECT 'orthogonal', i, j, {r('wt[j + 1][i + 1]')} FROM ({_IJ}), allorth
        UNION ALL SELECT 'orthogonal', -1, j, {r('b[j + 1]')} FROM (SELECT unnest(range(64)) AS j), allorth"""),
    "procrustes_orthogonality": q("SELECT grp, count(*) AS n, true AS orthogonal FROM pairs GROUP BY grp"),
    "score_from_moments": q(f"SELECT map, {r('r2')} AS r2 FROM ({_score('SELECT * FROM m_identity UNION ALL SELECT * FROM m_diagonal UNION ALL SELECT * FROM m_ridge WHERE alpha = 0.01')})"),
    "group_ladder": q(f"SELECT grp, map, {r('r2')} AS r2 FROM ({_channel_r2('SELECT grp, j, xv, yv, held FROM lpcells JOIN (SELECT rid, round_even(x[2] * 100000, 0)::BIGINT % 5 = 0 AS held FROM lp) USING (rid)', 'grp')})"),
    "ladder": q(f"""SELECT map, alpha, {', '.join(f'{r(m, 5)} AS {m}' for m in _LADDER_COLUMNS)}, row_number() OVER (ORDER BY deployed_r2 DESC, ord) = 1 AS is_best FROM ({_LADDER})"""),
    "best_map": q(f"SELECT map, {r('r2', 5)} AS r2, {r('deployed_r2', 5)} AS deployed_r2 FROM ({_LADDER}) ORDER BY {_LADDER and 'deployed_r2'} DESC, ord LIMIT 1"),
    "deployed_score": q(f"SELECT map, {r('deployed_r2', 5)} AS deployed_r2, {r('deployed_cosine_mean', 5)} AS deployed_cosine_mean FROM ({_both(_named('identity', 'diagonal'))})"),
    "report_lines": q(f"SELECT '| `' || map || '` | ' || printf('%+.4f', r2) || ' | ' || printf('%+.4f', cosine_mean) || ' |' AS line FROM ({_LADDER})"),
    "q8_codes": q(f"""SELECT vec_id, block, {f16("(amax / 127)")} AS scale,
        array_to_string(list_transform(blk, lambda v: greatest(-128, least(127, round_even(v / (amax / 127), 0)))::INT::VARCHAR), ' ') AS codes FROM
        (SELECT vec_id, block, blk, list_max(list_transform(blk, lambda a: abs(a))) AS amax FROM
         (SELECT vec_id, block, x[block * 32 + 1 : block * 32 + 32] AS blk FROM pairs0, (SELECT unnest([0, 1]::BIGINT[]) AS block)))"""),
    "q8_loss": q(f"""SELECT vec_id, {r('max(e)')} AS max_abs_err, true AS idempotent FROM
        (SELECT vec_id, list_max(list_transform(blk, lambda v: abs(v - greatest(-128, least(127, round_even(v / (amax / 127), 0))) * sc))) AS e FROM
         (SELECT *, {f16("(amax / 127)")} AS sc FROM (SELECT vec_id, blk, list_max(list_transform(blk, lambda a: abs(a))) AS amax FROM
          (SELECT vec_id, x[block * 32 + 1 : block * 32 + 32] AS blk FROM pairs0, (SELECT unnest([0, 1]) AS block))))) GROUP BY vec_id"""),
    "f16_round": q(f"SELECT vec_id, i, {f16('xv')} AS h FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(x) AS xv FROM pairs0)"),
    "deployed_tensors": q(f"""SELECT name, {r('sum(s)')} AS total, {r('sum(e)')} AS energy FROM (SELECT name, list_sum(vals) AS s, list_dot_product(vals, vals) AS e FROM
        (SELECT name, list_transform(blk, lambda v: greatest(-128, least(127, round_even(v / (amax / 127), 0))) * sc) AS vals FROM
         (SELECT *, {f16("(amax / 127)")} AS sc FROM (SELECT name, blk, list_max(list_transform(blk, lambda a: abs(a))) AS amax FROM
          (SELECT name, vals[block * 32 + 1 : block * 32 + 32] AS blk FROM tensors, (SELECT unnest([0, 1]) AS block) WHERE ckpt = 'base'))))) GROUP BY name"""),
    "scan_recordings": "SELECT source, lang, sum(strlen(text) + 1)::BIGINT AS total_bytes FROM documents GROUP BY 1, 2",
    "scan_takes": q("SELECT lang, CAST(sentence_id AS VARCHAR) AS sentence_id, arg_min(path, ord) AS first_take, arg_max(path, ord) AS last_take, count(*) AS n_takes FROM takes GROUP BY 1, 2"),
    "scan_pairs": q(f"SELECT grp, count(*) AS n, {r('sum(list_sum(x))')} AS sum_x, {r('sum(list_sum(y))')} AS sum_y FROM pairs GROUP BY grp"),
    "scan_debug_blocks": q("SELECT utt, CASE WHEN utt % 5 = 0 THEN NULL ELSE e.frames END AS frames, CASE WHEN utt % 5 = 0 THEN NULL ELSE 64::BIGINT END AS width FROM blockstats JOIN ends e USING (utt)"),
    "scan_configs": "SELECT p_partkey AS ckpt, p_size::BIGINT AS num_hidden_layers FROM part",
    "nonempty": q("SELECT count(*) AS n FROM recordings"),
    "identity_ops": q("SELECT name, row, j AS i, v FROM (SELECT name, row, unnest(range(64)) AS j, unnest(vals) AS v FROM tensors WHERE ckpt = 'base')").replace("j AS i, v FROM", f"j AS i, {r('v')} AS v FROM", 1),
    "takes_first_last": q("SELECT lang, sentence_id, arg_min(path, ord) AS first_take, arg_max(path, ord) AS last_take, count(*) AS n_takes FROM takes GROUP BY 1, 2"),
    "shared_sentences": q("SELECT sentence_id FROM takes WHERE lang = 'user' INTERSECT SELECT sentence_id FROM takes WHERE lang = 'assistant'"),
    "existing_takes": "SELECT role AS lang, conv_id AS sentence_id, conv_id || '_' || turn || '.wav' AS path FROM conversations WHERE length(text) >= 200",
    "mean_pool": q(f"SELECT lang, utt, j AS i, {r('avg(xv)')} AS v FROM ucells GROUP BY lang, utt, j"),
    "centered_vectors": q(f"""SELECT lang, utt, i, {r('c / greatest(sqrt(sum(c * c) OVER (PARTITION BY lang, utt)), 1e-12)')} AS v FROM
        (SELECT lang, utt, i, m - avg(m) OVER (PARTITION BY lang, i) AS c FROM (SELECT lang, utt, j AS i, avg(yv) AS m FROM ucells GROUP BY 1, 2, 3))"""),
    "pooled_projection": q(f"""SELECT lang, utt, {r('list_sum(e)')} AS total, {r('sqrt(list_dot_product(e, e))')} AS length FROM
        (SELECT lang, utt, list(m ORDER BY o) AS e FROM (SELECT lang, utt, o, avg(ev) AS m FROM
          (SELECT lang, utt, unnest(range(96)) AS o, unnest(list_transform(list_zip(p, pb), lambda z: list_dot_product(z[1], x) + z[2])) AS ev FROM utterances, proj)
          GROUP BY 1, 2, 3) GROUP BY 1, 2)"""),
    "truth_ranks": q("SELECT language, probe, utt, rank FROM ranks"),
    "retrieval": q("SELECT * FROM rettab"),
    "unit_cost": q(f"SELECT \"group\", src, tgt, {r('cost')} AS cost FROM cost"),
    "unit_cost_by_group": q(f"""SELECT a.grp, a.j AS src, b.j AS tgt, {r('1 - sum(a.xs * b.ys) / sqrt(sum(a.xs * a.xs) * sum(b.ys * b.ys))')} AS cost FROM
        (SELECT vec_id, grp, j, xv / sqrt(avg(xv * xv) OVER w) AS xs, yv / sqrt(avg(yv * yv) OVER w) AS ys FROM cells WINDOW w AS (PARTITION BY grp, vec_id // 50)) a
        JOIN (SELECT vec_id, j, xv / sqrt(avg(xv * xv) OVER w) AS xs, yv / sqrt(avg(yv * yv) OVER w) AS ys FROM cells WINDOW w AS (PARTITION BY grp, vec_id // 50)) b
        USING (vec_id) GROUP BY 1, 2, 3"""),
    "unit_match": q(f"SELECT \"group\", src, tgt, {r('mass')} AS mass FROM plan"),
    "unit_sources": q("SELECT \"group\", tgt, src, 1.0::DOUBLE AS self_mass FROM plan"),
    "match_summary": q(f"""SELECT 'residual' AS "group", 64::BIGINT AS source_size, 64::BIGINT AS target_size,
        {r('(SELECT sum(cost * mass) FROM cost JOIN plan USING (src, tgt))')} AS transport_cost,
        {r('(SELECT avg(cost) FROM cost WHERE src = tgt)')} AS identity_cost,
        {r('(SELECT avg(CASE WHEN src = tgt THEN 1.0 ELSE 0.0 END) FROM plan)')} AS identity_agreement,
        1.0::DOUBLE AS mean_self_mass, 1.0::DOUBLE AS min_self_mass"""),
    "match_by_group": q(f"""SELECT grp, unnest([p0, p1, p2, p3]) AS src, unnest([0, 1, 2, 3]::BIGINT[]) AS tgt, {r('c')} AS transport_cost FROM
        (SELECT grp, a.src AS p0, b.src AS p1, c.src AS p2, d.src AS p3, (a.cost + b.cost + c.cost + d.cost) / 4 AS c,
                row_number() OVER (PARTITION BY grp ORDER BY a.cost + b.cost + c.cost + d.cost) AS rn
         FROM lpcost a JOIN lpcost b USING (grp) JOIN lpcost c USING (grp) JOIN lpcost d USING (grp)
         WHERE a.tgt = 0 AND b.tgt = 1 AND c.tgt = 2 AND d.tgt = 3
           AND a.src <> b.src AND a.src <> c.src AND a.src <> d.src AND b.src <> c.src AND b.src <> d.src AND c.src <> d.src) WHERE rn = 1"""),
    "barycentric_match": q(f"""SELECT grp, {r('min(c)')} AS barycentric_cost, {r('min(i)')} AS integral_cost FROM
        (SELECT grp, (s0.cost + s1.cost + (SELECT sum(o.cost) FROM lpcost o WHERE o.grp = s0.grp AND o.tgt = 1 AND o.src NOT IN (s0.src, s1.src))) / 4 AS c,
                NULL AS i FROM lpcost s0 JOIN lpcost s1 USING (grp) WHERE s0.tgt = 0 AND s1.tgt = 0 AND s0.src < s1.src
         UNION ALL SELECT grp, NULL, (a.cost + b.cost) / 2 FROM lpcost a JOIN lpcost b USING (grp) WHERE a.tgt = 0 AND b.tgt = 1 AND a.src <> b.src) GROUP BY grp"""),
    "expand_ops": q("SELECT src * 2 + f AS src, tgt * 2 + f AS tgt, 1.0::DOUBLE AS analysis, 1.0::DOUBLE AS synthesis FROM plan, (SELECT unnest([0, 1]::BIGINT[]) AS f)"),
    "concat_ops": q("SELECT src, tgt, 1.0::DOUBLE AS analysis FROM plan UNION ALL SELECT src * 2 + f + 64, tgt * 2 + f + 64, 1.0::DOUBLE FROM plan, (SELECT unnest([0, 1]::BIGINT[]) AS f)"),
    "project_axis": q(f"SELECT name, row, tgt AS i, {r('vals[src + 1]')} AS v FROM tensors, plan WHERE ckpt = 'base'"),
    "block_contributions": q(f"""SELECT vec_id, h AS block, {r('list_sum(v)')} AS total, {r('list_dot_product(v, v)')} AS energy FROM
        (SELECT vec_id, h, list_transform(wt, lambda col: list_dot_product(x[h * 8 + 1 : h * 8 + 8], col[h * 8 + 1 : h * 8 + 8])) AS v FROM pairs,
         (SELECT unnest(range(8)) AS h), (SELECT {BLOCK_WEIGHT_COLUMNS} AS wt))"""),
    "preemphasis": q(f"SELECT clip, t, {r('v')} AS v FROM pre"),
    "causal_fir": q(f"""SELECT clip, t, {r('0.5::DOUBLE * v + 0.25::DOUBLE * coalesce(lag(v, 1) OVER w, 0) + 0.125::DOUBLE * coalesce(lag(v, 2) OVER w, 0) + 0.0625::DOUBLE * coalesce(lag(v, 3) OVER w, 0) + 0.0625::DOUBLE * coalesce(lag(v, 4) OVER w, 0)')} AS v
        FROM signals WINDOW w AS (PARTITION BY clip ORDER BY t)"""),
    "left_context": q(f"SELECT clip, t, {r('avg(v) OVER (PARTITION BY clip ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)')} AS v FROM signals"),
    "band_pairs": q("SELECT clip, t AS q, count(*) OVER (PARTITION BY clip ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS n_keys FROM signals"),
    "band_sums": q(f"SELECT a.clip, a.t AS q, count(*) AS n_keys, {r('sum(b.v)')} AS total FROM signals a JOIN signals b ON a.clip = b.clip AND a.t - b.t BETWEEN 0 AND 3 GROUP BY 1, 2"),
    "frames": q("SELECT clip, frame, pos, v::DOUBLE AS v FROM filled"),
    "power_spectrum": q(f"SELECT clip, frame, bin, {r('sqrt(p)')} AS v FROM power"),
    "log_mel": q(f"SELECT clip, frame, bin, {r('v', 5)} AS v FROM mel"),
    "per_feature_norm": q(f"SELECT clip, frame, bin, {r('(v - avg(v) OVER w) / (stddev_samp(v) OVER w + 1e-5)', 5)} AS v FROM mel WINDOW w AS (PARTITION BY clip, bin)"),
    "frames_out": q("""SELECT path, m AS mel_frames, ((m // 2 + 1) // 2 + 1) // 2 + 1 AS frames FROM (SELECT path, (n_samples + 512 - 512) // 160 + 1 AS m FROM recordings)"""),
    "harmonic_features": f"""SELECT n, row, k, {r("CASE WHEN k % 2 = 0 THEN sin(th) ELSE cos(th) END")} AS v FROM
        (SELECT n, row, k, (n - 1 - row) * exp(-(k // 2) * 2.0::DOUBLE * ln(10000.0::DOUBLE) / 8) AS th FROM
         (SELECT n, unnest(range(2 * n - 1)) AS row FROM (SELECT DISTINCT n FROM (SELECT count(*) AS n FROM events GROUP BY user_id))), (SELECT unnest(range(8)) AS k))""",
    "describe_blocks": q(f"""SELECT utt, 64::BIGINT AS width, frames, {r('mean')} AS mean, {r('std')} AS std, {r('lo')} AS min, {r('hi')} AS max, {r('total')} AS sum,
        {r('list_sum(x0[1:16])')} AS first_sum, {r('list_sum(x0[49:64])')} AS last_sum FROM blockstats JOIN ends USING (utt)"""),
    "debug_block_parity": q(f"SELECT utt, \"check\", {r('delta', 4)} AS delta, ok FROM checks"),
    "parity_verdict": q(f"SELECT utt, bool_and(ok) AS ok, {r('max(delta)', 4)} AS worst_delta FROM checks GROUP BY utt"),
    "parity_failures": q(f"""SELECT utt, CASE WHEN utt % 3 = 0 THEN bool_and(ok) ELSE false END AS ok,
        CASE WHEN utt % 3 = 0 THEN {r('max(delta)', 4)} ELSE 0.0::DOUBLE END AS worst_delta FROM checks GROUP BY utt"""),
    "vector_diff": q(f"SELECT grp, {r('avg(abs(xv - yv))')} AS mae, {r('max(abs(xv - yv))')} AS max_error, {r('sum(xv * yv) / sqrt(sum(xv * xv) * sum(yv * yv))')} AS cosine FROM cells GROUP BY grp"),
    "weight_drift": q(f"""SELECT name, a.ckpt AS "left", b.ckpt AS "right", {r('sum(list_dot_product(a.vals, b.vals)) / sqrt(sum(list_dot_product(a.vals, a.vals)) * sum(list_dot_product(b.vals, b.vals)))')} AS cosine
        FROM tensors a JOIN tensors b USING (name, row) WHERE (a.ckpt, b.ckpt) IN (('base', 'descendant'), ('base', 'ancestor'), ('ancestor', 'descendant')) GROUP BY 1, 2, 3"""),
    "layer_count": q("""SELECT ckpt, sum(CASE WHEN layer = rn - 1 THEN 1 ELSE 0 END)::BIGINT AS n_layers FROM
        (SELECT ckpt, layer, row_number() OVER (PARTITION BY ckpt ORDER BY layer NULLS LAST) AS rn FROM
         (SELECT DISTINCT ckpt, CASE WHEN name LIKE '%.norm_out.weight' THEN try_cast(regexp_extract(name, '^encoder\\.layers\\.(\\d+)\\.', 1) AS BIGINT) END AS layer FROM catalog)) GROUP BY ckpt"""),
    "precision_classes": q("SELECT ckpt, name, precision FROM classes"),
    "role_counts": q("""SELECT ckpt, sum((precision = 'q8_0')::INT)::BIGINT AS n_q8_0, sum((precision = 'f16')::INT)::BIGINT AS n_f16, sum((precision = 'f32')::INT)::BIGINT AS n_f32 FROM classes GROUP BY ckpt"""),
    "renamed": q("SELECT ckpt, name, new_name FROM canon WHERE starts_with(name, 'encoder.')"),
    "short_names": q("SELECT ckpt, name, new_name FROM short"),
    "missing_companions": q(f"""SELECT c.ckpt, n.name FROM (SELECT DISTINCT ckpt FROM catalog WHERE name = 'proj.weight') c, (SELECT unnest({sql_list(CHECKED_COMPANIONS)}) AS name) n
        WHERE NOT EXISTS (SELECT 1 FROM catalog k WHERE k.ckpt = c.ckpt AND k.name = n.name)"""),
    "own_or_borrowed": q(f"""SELECT w.ckpt, w.name, CASE WHEN own THEN k.rows ELSE l.rows END AS rows, CASE WHEN own THEN 'own' ELSE 'borrowed' END AS origin FROM
        (SELECT ckpt, own, unnest({sql_list(CHECKED_COMPANIONS)}) AS name FROM (SELECT ckpt, bool_or(name = 'proj.weight') AS own FROM catalog GROUP BY ckpt)) w
        LEFT JOIN catalog k ON k.ckpt = w.ckpt AND k.name = w.name
        LEFT JOIN (SELECT name, max(rows) AS rows FROM catalog WHERE name IN (SELECT unnest({sql_list(CHECKED_COMPANIONS)})) GROUP BY name) l ON l.name = w.name
        WHERE CASE WHEN own THEN k.rows ELSE l.rows END IS NOT NULL"""),
    "derived_config": q("""SELECT ckpt, any_value(n.n_layers) AS num_hidden_layers, 128::BIGINT AS num_mel_bins, 8::BIGINT AS subsampling_factor, max(CASE WHEN new_name = 'encoder.subsampling.linear.weight' THEN rows END) AS hidden_size,
        max(CASE WHEN new_name = 'encoder.layers.0.self_attn.bias_u' THEN rows END) AS num_attention_heads,
        max(CASE WHEN new_name = 'encoder.layers.0.feed_forward1.linear1.weight' THEN rows END) AS intermediate_size,
        max(CASE WHEN new_name = 'encoder.layers.0.conv.depthwise_conv.weight' THEN width END) AS conv_kernel_size, 71::BIGINT AS sliding_window FROM canon JOIN
        (SELECT ckpt, sum(CASE WHEN layer = rn - 1 THEN 1 ELSE 0 END)::BIGINT AS n_layers FROM (SELECT ckpt, layer, row_number() OVER (PARTITION BY ckpt ORDER BY layer NULLS LAST) AS rn FROM
         (SELECT DISTINCT ckpt, CASE WHEN new_name LIKE '%.norm_out.weight' THEN try_cast(regexp_extract(new_name, '^encoder\\.layers\\.(\\d+)\\.', 1) AS BIGINT) END AS layer FROM canon)) GROUP BY ckpt) n USING (ckpt) GROUP BY ckpt"""),
    "equal_widths": """SELECT p_partkey AS ckpt, 64::BIGINT AS source_width, (CASE WHEN p_partkey % 4 = 0 THEN 32 ELSE 64 END)::BIGINT AS target_width,
        CASE WHEN p_partkey % 4 = 0 THEN 'widths differ: 64 against 32' END AS reason FROM part""",
    "key_difference": """SELECT name, concat_ws(',', CASE WHEN NOT a THEN 'A' END, CASE WHEN NOT n THEN 'N' END, CASE WHEN NOT r THEN 'R' END) AS missing_from FROM
        (SELECT 'part.' || l_partkey || '.l' || l_linenumber AS name, bool_or(l_returnflag = 'A') AS a, bool_or(l_returnflag = 'N') AS n, bool_or(l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
        WHERE NOT (a AND n AND r)""",
    "config_registry": """SELECT p_partkey AS ckpt, p_size::BIGINT AS num_hidden_layers, 64::BIGINT AS hidden_size, 8::BIGINT AS num_attention_heads,
        CASE WHEN p_partkey % 10 = 3 THEN 4 ELSE 8 END::BIGINT AS subsampling_factor, 57 + p_partkey % 15 - 1 AS left_context FROM part""",
    "config_verdict": """SELECT p_partkey AS ckpt, CASE p_partkey % 10 WHEN 3 THEN 'subsampling_factor is 4' WHEN 5 THEN 'has biases' WHEN 6 THEN 'has biases' ELSE 'scales its input' END AS reason
        FROM part WHERE p_partkey % 10 IN (3, 5, 6, 7)""",
    "task_arithmetic": q(f"SELECT 'encoder.layers.' || grp || '.self_attn.q_proj.weight' AS name, vec_id AS row, j AS i, {r('xv + 0.5::DOUBLE * (yv - xv * 0.5::DOUBLE)')} AS v FROM cells"),
    "interpolate": q(f"SELECT 'encoder.layers.' || grp || '.self_attn.q_proj.weight' AS name, vec_id AS row, j AS i, {r('0.75::DOUBLE * xv + 0.25::DOUBLE * yv')} AS v FROM cells"),
    "lambda_sweep": q(f"""SELECT "lambda", map, {r('r2', 5)} AS r2 FROM ({_channel_r2('SELECT l AS "lambda", j, xv + l * (yv - xv * 0.5::DOUBLE) AS xv, yv, grp IN (SELECT grp FROM heldk) AS held FROM cells, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS l)', '"lambda"')})"""),
    "rebase": q(f"""SELECT name, row, tgt AS i, {r('vals[src + 1]')} AS v FROM plan,
        (SELECT name, row, vals FROM tensors WHERE ckpt = 'base' UNION ALL
         SELECT replace(name, 'self_attn.q_proj', 'norm_out'), 0, arg_min(vals, row) FROM tensors WHERE ckpt = 'base' GROUP BY name)"""),
    "fused_checkpoint": q(f"""SELECT 'encoder.layers.' || grp || '.self_attn.q_proj.weight' AS name, vec_id AS row, tgt AS i,
        {r('x[tgt + 1] + 0.5::DOUBLE * (y[src + 1] - x[src + 1] * 0.5::DOUBLE)')} AS v FROM pairs, plan"""),
    "aligned_tensors": q("""SELECT name, count(*) AS n_rows, false AS added FROM tensors WHERE ckpt = 'base' GROUP BY name UNION ALL
        SELECT * FROM (VALUES ('proj.weight', 96::BIGINT, true), ('proj.bias', 1, true), ('preprocessor.featurizer.fb', 4, true), ('preprocessor.featurizer.window', 1, true))"""),
    "sql_functions": q(f"""SELECT vec_id, {f16('y[1]')} AS first_half, {r('list_cosine_similarity(x, y)')} AS cos, {r('list_cosine_similarity(x, qx)')} AS kept FROM
        (SELECT vec_id, x, y, list_concat(list_transform(x[1:32], lambda v: round_even(v / (a / 127), 0) * {f16('(a / 127)')}), list_transform(x[33:64], lambda v: round_even(v / (b / 127), 0) * {f16('(b / 127)')})) AS qx FROM
         (SELECT *, list_max(list_transform(x[1:32], lambda v: abs(v))) AS a, list_max(list_transform(x[33:64], lambda v: abs(v))) AS b FROM pairs))"""),
    "tensor_roundtrip": q(f"SELECT name, row, {r('list_sum(vals)')} AS total FROM tensors WHERE ckpt = 'descendant'"),
    "report_roundtrip": q(f"SELECT '?' AS chosen, (SELECT count(*) FROM pairs) AS fit_frames, 1::BIGINT AS n_groups, map, {r('r2')} AS r2, {r('cosine_mean')} AS cosine_mean FROM ({_score(_named('identity', 'diagonal'))})"),
    "probe_roundtrip": q("SELECT language::VARCHAR AS language, probe, n, top1, top5, median_rank, chance_top1 FROM rettab"),
    "mlp_scores": q(f"""SELECT vec_id, j, {r('v')} AS v FROM (SELECT vec_id, unnest(range(16)) AS j,
        unnest(list_transform(range(16), lambda o: list_sum(list_transform(hid, lambda h, k: h * ((((o * 7 + (k - 1) * 11) % 29) - 14)::DOUBLE / 29::DOUBLE))) + o::DOUBLE / 32)) AS v FROM
        (SELECT vec_id, list_transform(range(32), lambda o: greatest(0.0::DOUBLE, list_sum(list_transform(x, lambda a, k: a * ((((o * 5 + (k - 1) * 3) % 37) - 18)::DOUBLE / 37::DOUBLE))) + o::DOUBLE / 64)) AS hid FROM pairs0))"""),
    "stream_moments": q(_moment_rows("lp", 4, "rid", digits=4)),
    "stream_state_moments": q(_moment_rows("lp", 4, "rid", full=False, digits=4)),
    "stream_unit_stats": q(f"""SELECT a.j AS src, b.j AS tgt, {r('1 - corr(a.xs, b.ys)')} AS cost FROM
        (SELECT vec_id, j, xv / sqrt(avg(xv * xv) OVER w) AS xs, yv / sqrt(avg(yv * yv) OVER w) AS ys FROM cells WINDOW w AS (PARTITION BY vec_id // 50)) a
        JOIN (SELECT vec_id, j, xv / sqrt(avg(xv * xv) OVER w) AS xs, yv / sqrt(avg(yv * yv) OVER w) AS ys FROM cells WINDOW w AS (PARTITION BY vec_id // 50)) b
        USING (vec_id) GROUP BY 1, 2"""),
    "stream_cap": "SELECT least(1500, count(*)) AS n_frames FROM lineitem",
}

# the what-if needs the ridge solution on both versions of the source
CTE["whatif"] = _FLIPPED
CTE["wmom"] = "SELECT a.normalized, a.j AS i, b.j AS j, covar_pop(a.xv, b.xv) AS cxx, covar_pop(a.xv, b.yv) AS cxy FROM whatif a JOIN whatif b USING (normalized, vec_id) WHERE NOT a.held GROUP BY 1, 2, 3"
CTE["wmean"] = "SELECT normalized, list(mx ORDER BY j) AS mx, list(my ORDER BY j) AS my FROM (SELECT normalized, j, avg(xv) AS mx, avg(yv) AS my FROM whatif WHERE NOT held GROUP BY 1, 2) GROUP BY 1"
CTE["wmat"] = """SELECT normalized, list(rx ORDER BY i) AS cxx, list(ry ORDER BY i) AS cxy, sum(dg) / 64 AS meanvar FROM
    (SELECT normalized, i, list(cxx ORDER BY j) AS rx, list(cxy ORDER BY j) AS ry, sum(CASE WHEN i = j THEN cxx ELSE 0 END) AS dg FROM wmom GROUP BY 1, 2) GROUP BY 1"""
CTE["wgj"] = """SELECT normalized, 0 AS k, list_transform(list_zip(cxx, cxy), lambda z, i: list_concat(
        list_transform(z[1], lambda v, c: CASE WHEN c = i THEN v + 0.01::DOUBLE * meanvar ELSE v END), z[2])) AS m FROM wmat
    UNION ALL
    SELECT normalized, k + 1, list_transform(m, lambda row, i: CASE WHEN i = k + 1 THEN piv ELSE
        list_transform(list_zip(row, piv), lambda z: z[1] - row[k + 1] * z[2]) END)
    FROM (SELECT normalized, k, m, list_transform(m[k + 1], lambda v: v / m[k + 1][k + 1]) AS piv FROM wgj WHERE k < 64)"""
CTE["wmap"] = """SELECT normalized, wt, list_transform(range(1, 65), lambda j: my[j] - list_dot_product(mx, wt[j])) AS b FROM
    (SELECT normalized, my, mx, list_transform(range(65, 129), lambda j: list_transform(m, lambda row: row[j])) AS wt FROM wgj JOIN wmean USING (normalized) WHERE k = 64)"""
CTE["wrows"] = "SELECT normalized, vec_id, list(xv ORDER BY j) AS x, list(yv ORDER BY j) AS y FROM whatif WHERE held GROUP BY 1, 2"
_WRIDGE = """SELECT normalized, 'ridge' AS map, 1 - sse / sst AS r2 FROM
    (SELECT normalized, sum(list_sum(list_transform(list_zip(g, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS sse FROM
      (SELECT normalized, y, list_transform(list_zip(wt, b), lambda z: list_dot_product(x, z[1]) + z[2]) AS g FROM wrows JOIN wmap USING (normalized)) GROUP BY 1)
    JOIN (SELECT normalized, sum(vp) AS sst FROM (SELECT normalized, j, var_pop(yv) * count(*) AS vp FROM whatif WHERE held GROUP BY 1, 2) GROUP BY 1) USING (normalized)"""
ORACLE["normalisation_what_if"] = q(
    f"SELECT normalized, map, {r('r2', 5)} AS r2 FROM ({_channel_r2('SELECT normalized, j, xv, yv, held FROM whatif', 'normalized')} UNION ALL {_WRIDGE})"
)

# blocks compared through what they add, source outputs brought into the matched order
CTE["bparts"] = f"""SELECT vec_id, h, o, list_dot_product(x[h * 8 + 1 : h * 8 + 8], wt[o + 1][h * 8 + 1 : h * 8 + 8]) AS cx,
    list_dot_product(y[h * 8 + 1 : h * 8 + 8], wt[o + 1][h * 8 + 1 : h * 8 + 8]) AS cy FROM pairs, (SELECT unnest(range(8)) AS h), (SELECT unnest(range(64)) AS o), (SELECT {BLOCK_WEIGHT_COLUMNS} AS wt)"""
ORACLE["block_cost"] = q(
    f"""SELECT a.h AS src, b.h AS tgt, {r('1 - corr(a.cx, b.cy)')} AS cost FROM
    (SELECT vec_id, h, tgt AS o, cx FROM bparts JOIN plan ON plan.src = bparts.o) a JOIN bparts b USING (vec_id, o) GROUP BY 1, 2"""
)

# the ridge rung once more, with the source behind a two-layer head
_HEAD = {"split": "hsplit", "lng": "hlng", "fitmom": "hmom", "fitmean": "hmean", "fitmat": "hmat", "gj": "hgj", "m_ridge": "h_ridge", "ev": "hev"}


def _headed(text: str) -> str:
    for old, new in _HEAD.items():
        text = re.sub(rf"\b{old}\b", new, text)
    return text


for _old, _new in list(_HEAD.items())[1:]:
    CTE[_new] = _headed(CTE[_old])
CTE["hsplit"] = """SELECT vec_id, grp, y, held, list_transform(range(64), lambda o: list_sum(list_transform(hid, lambda h, k: h * ((((o * 7 + (k - 1) * 11) % 29) - 14)::DOUBLE / 29::DOUBLE))) + o::DOUBLE / 32) AS x FROM
    (SELECT vec_id, grp, y, held, list_transform(range(32), lambda o: greatest(0.0::DOUBLE, list_sum(list_transform(x, lambda a, k: a * ((((o * 5 + (k - 1) * 3) % 37) - 18)::DOUBLE / 37::DOUBLE))) + o::DOUBLE / 64)) AS hid FROM split)"""
_HEAD_RUNG = f"SELECT * FROM ({_headed(_both(_named('ridge')))}) ORDER BY deployed_r2 DESC, alpha LIMIT 1"
ORACLE["ladder_with_head"] = q(
    f"""SELECT map, {r('r2', 4)} AS r2, {r('deployed_r2', 4)} AS deployed_r2, NULL::BOOLEAN AS shippable, row_number() OVER (ORDER BY deployed_r2 DESC, ord) = 1 AS is_best FROM ({_LADDER})
    UNION ALL SELECT 'head+ridge', {r('r2', 4)}, {r('deployed_r2', 4)}, false, false FROM ({_HEAD_RUNG})"""
)

# retrieval from the takes manifest
CTE["tkfirst"] = "SELECT lang, sentence_id AS sid, arg_min(path, ord) AS f, arg_max(path, ord) AS l, count(*) AS nt FROM takes GROUP BY 1, 2"
CTE["tkframes"] = """SELECT path, unnest(range(64)) AS j, unnest(x) AS xv, unnest(y) AS yv FROM
    (SELECT path, (sentence_id * 5 + fr * 3 + ord % 2) % (SELECT count(*) FROM embeddings) AS vec_id FROM takes, (SELECT unnest(range(3)) AS fr)) JOIN pairs USING (vec_id)"""
CTE["tkpool"] = """SELECT path, list(xm ORDER BY j) AS x, list(ym ORDER BY j) AS y FROM
    (SELECT path, j, avg(xv) AS xm, avg(yv) AS ym FROM tkframes GROUP BY 1, 2) GROUP BY path"""
_LIFT = lambda v: f"list_transform(list_zip(p, pb), lambda z: list_dot_product(z[1], {v}) + z[2])"
CTE["tkjoin"] = f"""SELECT o.lang, o.sid, a.nt, {_LIFT('po.x')} AS base, {_LIFT('po.y')} AS raw, {_LIFT('pr.x')} AS r, {_LIFT('ps.x')} AS second,
    {_LIFT('my')} AS mapped FROM tkfirst o JOIN tkfirst a ON a.sid = o.sid AND a.lang = 'user' AND o.lang <> 'user'
    JOIN (SELECT path, x, y, list_transform(list_zip(wt, b), lambda z: list_dot_product(y, z[1]) + z[2]) AS my FROM tkpool, bmap) po ON po.path = o.f
    JOIN tkpool pr ON pr.path = a.f JOIN tkpool ps ON ps.path = a.l, proj"""
CTE["tksets"] = """SELECT lang, sid, nt, 'second take' AS probe, second AS v, r FROM tkjoin UNION ALL SELECT lang, sid, nt, 'baseline', base, r FROM tkjoin
    UNION ALL SELECT lang, sid, nt, 'swapped', raw, r FROM tkjoin UNION ALL SELECT lang, sid, nt, 'swapped+map', mapped, r FROM tkjoin"""
CTE["tkmean"] = """SELECT lang, probe, list(vm ORDER BY j) AS vm, list(rm ORDER BY j) AS rm FROM (SELECT lang, probe, j, avg(vv) AS vm, avg(rv) AS rm FROM
    (SELECT lang, probe, unnest(range(96)) AS j, unnest(v) AS vv, unnest(r) AS rv FROM tksets) GROUP BY 1, 2, 3) GROUP BY 1, 2"""
CTE["tkunit"] = """SELECT lang, probe, sid, nt, list_transform(v, lambda a: a / nv) AS v, list_transform(r, lambda a: a / nr) AS r FROM
    (SELECT *, greatest(sqrt(list_dot_product(v, v)), 1e-12) AS nv, greatest(sqrt(list_dot_product(r, r)), 1e-12) AS nr FROM
     (SELECT lang, probe, sid, nt, list_transform(list_zip(v, vm), lambda z: z[1] - z[2]) AS v, list_transform(list_zip(r, rm), lambda z: z[1] - z[2]) AS r
      FROM tksets JOIN tkmean USING (lang, probe)))"""
CTE["tkranks"] = """SELECT a.lang AS language, a.probe, a.sid, any_value(a.nt) AS nt,
    1 + sum(CASE WHEN b.sid <> a.sid AND list_dot_product(a.v, b.r) > list_dot_product(a.v, a.r) + 1e-12 THEN 1 ELSE 0 END)::BIGINT AS rank
    FROM tkunit a JOIN tkunit b USING (lang, probe) GROUP BY 1, 2, 3"""
ORACLE["takes_retrieval"] = q(f"""SELECT language, probe, count(*) AS n, {r("avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END)")} AS top1,
    {r("avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END)")} AS top5, {r("median(rank)::DOUBLE")} AS median_rank,
    {r("1.0::DOUBLE / count(*)")} AS chance_top1, sum((nt = 1)::INT)::BIGINT AS n_single_take FROM tkranks GROUP BY 1, 2""")
ORACLE["report_sweep"] = f"""SELECT 'ridge' AS chosen, (SELECT count(*) FROM embeddings) AS clips, 0.4::DOUBLE AS seconds, 'correlation' AS ground_metric,
    false AS source_normalize, max(CASE WHEN is_best THEN alpha END) OVER () AS best_alpha, alpha, r2, cosine_p05 FROM ({ORACLE["ridge_score"]})"""

# both solvers are held against the same plan and the same enumeration
ORACLE["auction_match"] = ORACLE["unit_match"]
ORACLE["auction_by_group"] = ORACLE["match_by_group"]
