"""DuckDB SQL with the results of the deterministic queries of the catalogue."""

from __future__ import annotations

import math

from ..functions.geometry import CLAMP
from ..operators.affinities import HIGH, LOW, START, STEPS, TOLERANCE
from ..operators.metrics import FLOOR, GRID, SMALL
from ..operators.projection import PALETTE
from .queries import PERPLEXITY

#: The stand-ins as common tables.
VIEWS = """
u AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label::BIGINT AS label FROM embeddings),
emb2 AS (SELECT id, [vec[1], vec[2]] AS vec, label FROM u),
sph3 AS (SELECT id, [vec[1] / n, vec[2] / n, vec[3] / n] AS vec, label FROM (SELECT *, sqrt(vec[1] * vec[1] + vec[2] * vec[2] + vec[3] * vec[3]) AS n FROM u)),
hyp3 AS (SELECT id, [sqrt(1 + vec[2] * vec[2] + vec[3] * vec[3]), vec[2], vec[3]] AS vec, label FROM u)
"""
_TABLE = {"euclid": "emb2", "sphere": "sph3", "hyper": "hyp3"}
_DISTANCE = {
    "euclid": "list_distance(a.vec, b.vec)",
    "sphere": f"acos(greatest(least(list_inner_product(a.vec, b.vec), 1 - {CLAMP}), -1 + {CLAMP}))",
    "hyper": f"acosh(greatest(a.vec[1] * b.vec[1] - a.vec[2] * b.vec[2] - a.vec[3] * b.vec[3], 1 + {CLAMP}))",
}


def _pairs(name: str, table: str, distance: str) -> str:
    return f"{name} AS (SELECT a.id AS i, b.id AS j, a.label AS li, b.label AS lj, {distance} AS d FROM {table} a JOIN {table} b ON a.id <> b.id)"


def _with(*ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{VIEWS}, " + ", ".join(ctes) if ctes else f"WITH {VIEWS}"


HIGH_PAIRS = _pairs("hi", "u", _DISTANCE["euclid"])
LOW_PAIRS = _pairs("lo", "hyp3", _DISTANCE["hyper"])
FLAT_PAIRS = _pairs("fl", "hyp3", _DISTANCE["euclid"])


def _near(name: str, pairs: str, k: int) -> str:
    return f"{name} AS (SELECT * FROM (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM {pairs}) WHERE rank <= {k})"


def _coordinates(table: str, vec: str, n: int, extra: str = "") -> str:
    """id, c, x of a vector column."""
    return " UNION ALL ".join(f"SELECT id, {c}::INTEGER AS c, {vec}[{c + 1}] AS x FROM {table} {extra}" for c in range(n))


def _maps() -> dict[str, str]:
    """Tangent projections, exponential maps and transports, for curvatures 0, 1 and -1."""
    out = {}
    turn = {"euclid": "[-0.3 * vec[2], 0.3 * vec[1]]", "sphere": "[-0.3 * vec[2], 0.3 * vec[1], 0.15 * vec[3]]", "hyper": "[0.3 * vec[2], 0.3 * vec[3], -0.3 * vec[2]]"}
    lorentz = lambda a, b: f"(-{a}[1] * {b}[1] + {a}[2] * {b}[2] + {a}[3] * {b}[3])"
    dot = lambda a, b: f"({a}[1] * {b}[1] + {a}[2] * {b}[2] + {a}[3] * {b}[3])"
    mix = lambda a, x, b, y, n: "[" + ", ".join(f"({a}) * {x}[{c}] + ({b}) * {y}[{c}]" for c in range(1, n + 1)) + "]"
    for kind, table in _TABLE.items():
        n = 2 if kind == "euclid" else 3
        g = f"g AS (SELECT id, vec, {turn[kind]} AS g FROM {table})"
        if kind == "euclid":
            steps = [g, "t AS (SELECT id, vec, g AS t FROM g)", f"s AS (SELECT id, vec, t, {mix('1', 'vec', '1', 't', 2)} AS y FROM t)", "r AS (SELECT id, t AS w FROM s)"]
        elif kind == "sphere":
            steps = [
                g,
                f"t AS (SELECT id, vec, {mix('1', 'g', '-' + dot('g', 'vec'), 'vec', 3)} AS t FROM g)",
                f"n AS (SELECT id, vec, t, sqrt{dot('t', 't')} AS n FROM t)",
                f"m AS (SELECT id, vec, t, CASE WHEN n < 1e-10 THEN vec ELSE {mix('cos(n)', 'vec', 'sin(n) / greatest(n, 1e-10)', 't', 3)} END AS m FROM n)",
                f"s AS (SELECT id, vec, t, [m[1] / q, m[2] / q, m[3] / q] AS y FROM (SELECT *, sqrt{dot('m', 'm')} AS q FROM m))",
                f"p AS (SELECT id, vec, y, t, {dot('y', 't')} / greatest(1 + {dot('vec', 'y')}, 1e-8) AS f FROM s)",
                f"o AS (SELECT id, y, [t[1] - f * (vec[1] + y[1]), t[2] - f * (vec[2] + y[2]), t[3] - f * (vec[3] + y[3])] AS o FROM p)",
                f"r AS (SELECT id, {mix('1', 'o', '-' + dot('y', 'o'), 'y', 3)} AS w FROM o)",
            ]
        else:
            steps = [
                g,
                "h AS (SELECT id, vec, [-g[1], g[2], g[3]] AS h FROM g)",
                f"t AS (SELECT id, vec, {mix('1', 'h', lorentz('vec', 'h'), 'vec', 3)} AS t FROM h)",
                f"n AS (SELECT id, vec, t, least(sqrt(greatest({lorentz('t', 't')}, 1e-15)), 10) AS n FROM t)",
                f"m AS (SELECT id, vec, t, {mix('cosh(n)', 'vec', 'sinh(n) / n', 't', 3)} AS m FROM n)",
                "s AS (SELECT id, vec, t, [sqrt(1 + m[2] * m[2] + m[3] * m[3]), m[2], m[3]] AS y FROM m)",
                f"p AS (SELECT id, vec, y, t, {lorentz('y', 't')} / greatest(1 - {lorentz('vec', 'y')}, 1e-8) AS f FROM s)",
                "o AS (SELECT id, y, [t[1] + f * (vec[1] + y[1]), t[2] + f * (vec[2] + y[2]), t[3] + f * (vec[3] + y[3])] AS o FROM p)",
                f"r AS (SELECT id, {mix('1', 'o', lorentz('y', 'o'), 'y', 3)} AS w FROM o)",
            ]
        out[f"tangent_{kind}"] = _with(*steps) + _coordinates("t", "t", n)
        out[f"step_{kind}"] = _with(*steps) + _coordinates("s", "y", n)
        out[f"transport_{kind}"] = _with(*steps) + _coordinates("r", "w", n)
        if kind == "hyper":
            step = [*steps[:2], steps[2].replace(" AS t FROM h", " AS g FROM h").replace("t AS (", "t0 AS ("), "t AS (SELECT id, vec, [-0.5 * g[1], -0.5 * g[2], -0.5 * g[3]] AS t FROM t0)", *steps[3:6]]
            out["rsgd_step"] = _with(*step) + _coordinates("s", "y", n)
    return out


def _sigma(k: int, pairs: str = HIGH_PAIRS, name: str = "hi") -> list[str]:
    goal = math.log(PERPLEXITY)
    return [
        pairs, _near("nn", name, k),
        "d2 AS (SELECT i, list(j ORDER BY d, j) AS js, list(d * d ORDER BY d, j) AS d2 FROM nn GROUP BY i)",
        f"""b AS (
          SELECT i, d2, {LOW}::DOUBLE AS lo, {HIGH}::DOUBLE AS hi, {START}::DOUBLE AS s, false AS done, 0 AS it FROM d2
          UNION ALL
          SELECT i, d2, CASE WHEN NOT met AND h <= {goal} THEN s ELSE lo END, CASE WHEN NOT met AND h > {goal} THEN s ELSE hi END,
                 CASE WHEN met THEN s WHEN h > {goal} THEN (lo + s) / 2 ELSE (s + hi) / 2 END, met, it + 1
          FROM (
            SELECT *, done OR abs(h - {goal}) < {TOLERANCE} AS met FROM (
              SELECT *, -list_sum([(x / z) * ln(x / z + 1e-10) for x in e]) AS h FROM (
                SELECT *, list_sum(e) AS z FROM (SELECT *, [exp(-(x - d2[1]) / (2 * s * s)) for x in d2] AS e FROM b WHERE it < {STEPS}))))
        )""",
        f"sg AS (SELECT i, s AS sigma FROM b WHERE it = {STEPS})",
        "e AS (SELECT i, js, [exp(-(x - d2[1]) / (2 * sigma * sigma)) for x in d2] AS e FROM d2 JOIN sg USING (i))",
        "cp AS (SELECT i, unnest(js) AS j, unnest([x / list_sum(e) for x in e]) AS p FROM e)",
    ]


def _trust(near: str, high: str, k: int, n: str = "(SELECT count(*) FROM u)") -> list[str]:
    return [
        _near("tn", near, k),
        f"tr AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM {high})",
        f"tv AS (SELECT 1 - 2.0 / ({n} * {k} * (2 * {n} - 3 * {k} - 1)) * sum(greatest(r - {k}, 0)) AS value FROM tn JOIN tr USING (i, j))",
    ]


def _db(name: str, pairs: str) -> list[str]:
    return [
        f"{name}s AS (SELECT i, li AS l, sum(d) AS s FROM {pairs} WHERE li = lj GROUP BY i, li)",
        f"{name}m AS (SELECT l, arg_min(i, (s, i)) AS m, min(s) / count(*) AS scatter FROM {name}s GROUP BY l)",
        f"{name}w AS (SELECT a.l, max(CASE WHEN d >= {SMALL} THEN (a.scatter + b.scatter) / d END) AS w FROM {name}m a JOIN {name}m b ON a.l <> b.l JOIN {pairs} p ON p.i = a.m AND p.j = b.m GROUP BY a.l)",
        f"{name} AS (SELECT sum(coalesce(w, 0)) / count(*) AS value FROM {name}w)",
    ]


AFFINITIES = "af AS (SELECT i, j, sum(p) / (SELECT 2 * sum(p) FROM cp) AS v FROM (SELECT i, j, p FROM cp UNION ALL SELECT j, i, p FROM cp) GROUP BY i, j)"


def _momentum() -> str:
    """Two steps on the sphere with gradients that stay the same."""
    dot = lambda a, b: f"({a}[1] * {b}[1] + {a}[2] * {b}[2] + {a}[3] * {b}[3])"
    mix = lambda a, x, b, y: "[" + ", ".join(f"({a}) * {x}[{c}] + ({b}) * {y}[{c}]" for c in (1, 2, 3)) + "]"

    def clipped(name: str, source: str) -> str:
        return f"{name} AS (SELECT * EXCLUDE (v), [c * v[1], c * v[2], c * v[3]] AS v FROM (SELECT *, CASE WHEN s > 10 THEN 10 / s ELSE 1 END AS c FROM (SELECT *, sqrt(sum{dot('v', 'v')} OVER ()) AS s FROM {source})))"

    def moved(name: str, source: str, x: str, y: str) -> list[str]:
        step = f"CASE WHEN n < 1e-10 THEN {x} ELSE {mix('cos(n)', x, 'sin(n) / greatest(n, 1e-10)', 'v')} END"
        return [f"{name}0 AS (SELECT *, {step} AS m FROM (SELECT *, sqrt{dot('v', 'v')} AS n FROM {source}))", f"{name} AS (SELECT * EXCLUDE (m, n), [m[1] / q, m[2] / q, m[3] / q] AS {y} FROM (SELECT *, sqrt{dot('m', 'm')} AS q FROM {name}0))"]

    return _with(
        "g AS (SELECT id, vec AS x, [-0.3 * vec[2], 0.3 * vec[1], 0.15 * vec[3]] AS g FROM sph3)",
        f"a AS (SELECT *, [-0.5 * t[1], -0.5 * t[2], -0.5 * t[3]] AS v FROM (SELECT *, {mix('1', 'g', '-' + dot('g', 'x'), 'x')} AS t FROM g))",
        clipped("b", "a"), *moved("e", "(SELECT id, x, g, v FROM b)", "x", "y"),
        f"f AS (SELECT *, {dot('y', 'v')} / greatest(1 + {dot('x', 'y')}, 1e-8) AS f, {mix('1', 'g', '-' + dot('g', 'y'), 'y')} AS t FROM (SELECT id, x, g, v, y FROM e))",
        "h AS (SELECT id, y, t, [v[1] - f * (x[1] + y[1]), v[2] - f * (x[2] + y[2]), v[3] - f * (x[3] + y[3])] AS o FROM f)",
        f"i AS (SELECT id, y, {mix('0.5', 'w', '-0.5', 't')} AS v FROM (SELECT id, y, t, {mix('1', 'o', '-' + dot('y', 'o'), 'y')} AS w FROM h))",
        clipped("k", "i"), *moved("l", "(SELECT id, y, v FROM k)", "y", "z"),
    ) + _coordinates("l", "z", 3)


def _all_metrics(found: dict[str, str]) -> str:
    """Each metric's SQL over the same stand-ins; those of the plane over the disc."""
    disc = VIEWS.replace("[vec[1], vec[2]] AS vec", "[vec[2] / (1 + sqrt(1 + vec[2] * vec[2] + vec[3] * vec[3])), vec[3] / (1 + sqrt(1 + vec[2] * vec[2] + vec[3] * vec[3]))] AS vec")
    wanted = {"trustworthiness": "trustworthiness", "continuity": "continuity", "knn_overlap": "knn_overlap", "db_ratio": "db_index_ratio"}
    plane = {"area_utilisation": "area_utilisation", "radial_distribution": "radial_distribution", "class_density": "class_density_measure", "cluster_density": "cluster_density_measure"}
    parts = [f"({found[k]}) AS {name}" for k, name in wanted.items()] + [f"({found[k].replace(VIEWS, disc)}) AS {name}" for k, name in plane.items()]
    return "SELECT " + ", ".join(parts)


def _more(found: dict[str, str], k: int) -> dict[str, str]:
    """SQL that builds on that of other queries."""
    g = "acosh(greatest(vec[1], 1 + 1e-7))"
    drawn = "('0x' || substring(md5(id::VARCHAR || ':42'), 1, 8))::BIGINT"
    flat = _pairs("em", "emb2", _DISTANCE["euclid"])
    lifted = {
        -1.0: ("lf AS (SELECT id, label, [sqrt(1 + vec[1] * vec[1] + vec[2] * vec[2]), vec[1], vec[2]] AS vec FROM emb2)", _DISTANCE["hyper"]),
        0.0: ("lf AS (SELECT id, label, vec FROM emb2)", _DISTANCE["euclid"]),
        1.0: ("lf AS (SELECT id, label, [sqrt(1 - f * f * (vec[1] * vec[1] + vec[2] * vec[2])), f * vec[1], f * vec[2]] AS vec FROM (SELECT *, least(1, sqrt(1 - 1e-7) / greatest(sqrt(vec[1] * vec[1] + vec[2] * vec[2]), 1e-300)) AS f FROM emb2))", _DISTANCE["sphere"]),
    }
    distorted = [f"SELECT {c}::DOUBLE AS curvature, (" + _with(HIGH_PAIRS, lift, _pairs("ld", "lf", d)) + "SELECT avg(abs(pow(ld.d / hi.d, 2) - 1)) FROM hi JOIN ld USING (i, j) WHERE i < j) AS value" for c, (lift, d) in lifted.items()]
    trust = _with(HIGH_PAIRS, FLAT_PAIRS, *_trust("fl", "hi", 5)) + "SELECT value FROM tv", _with(HIGH_PAIRS, FLAT_PAIRS, *_trust("hi", "fl", 5)) + "SELECT value FROM tv"
    means = "SELECT 'set_' || label AS \"Dataset\", unnest([-1.0, 0.0, 1.0])::DOUBLE AS \"Curvature\", unnest([avg(vec[1]), avg(vec[2]), avg(vec[3])]) AS \"Metric\" FROM u GROUP BY label"
    return {
        "momentum_step": _momentum(),
        "all_metrics": _all_metrics(found),
        "evaluate": f"SELECT ({trust[0]}) AS trustworthiness, ({trust[1]}) AS continuity",
        "q_matrix": _with(LOW_PAIRS) + "SELECT i, j, 1e6 * k / sum(k) OVER () AS q FROM (SELECT i, j, 1 / (1 + d * d) AS k FROM lo)",
        "colored_points": f"SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, red, green, blue FROM embeddings JOIN ({found['label_colors']}) USING (label)",
        "metric_messages": "SELECT '{\"type\":\"metrics\",\"dunn\":\"' || printf('%.6f', value) || '\"}' AS value FROM (" + found["dunn"] + ")",
        "affinity_loss": _with(*_sigma(k), AFFINITIES, LOW_PAIRS, "ke AS (SELECT i, j, 1 / (1 + d * d) AS k, (sum(1 / (1 + d * d)) OVER ()) AS z FROM lo)", recursive=True) + "SELECT sum(-v * ln(k / z + 1e-12)) AS loss FROM ke JOIN af USING (i, j)",
        "exaggerated_loss": f"SELECT 12 * loss AS loss FROM ({found['kl_loss']})",
        "regularised_loss": f"SELECT a.loss + 0.1 * b.loss AS loss FROM ({found['kl_loss']}) a, ({found['scaling_rms']}) b",
        "distance_losses": _with(HIGH_PAIRS, LOW_PAIRS) + "SELECT round(sum(pow(lo.d / (hi.d + 1e-8) - 1, 2)), 6) AS gu, round(sum(pow(lo.d - hi.d, 2)), 6) AS mse FROM hi JOIN lo USING (i, j) WHERE i < j",
        "curvature_distortion": " UNION ALL ".join(distorted),
        "sql_distances": _with(*(_pairs(f"p{t[0]}", t, _DISTANCE[kind]) for kind, t in _TABLE.items())) + "SELECT i, j, e.d AS euclid, s.d AS sphere, h.d AS hyper FROM pe e JOIN ps s USING (i, j) JOIN ph h USING (i, j) WHERE j = (i + 1) % (SELECT count(*) FROM u)",
        "norm_pairs": _with(HIGH_PAIRS) + "SELECT i, j, round(d, 6) AS d FROM hi",
        "normalized_pairs": _with(flat) + "SELECT i, j, d / avg(d) OVER () AS d FROM em",
        "precomputed_affinities": _with(*_sigma(k, flat, "em"), recursive=True) + "SELECT i, j, sum(p) / (SELECT 2 * sum(p) FROM cp) AS v FROM (SELECT i, j, p FROM cp UNION ALL SELECT j, i, p FROM cp) GROUP BY i, j",
        "pair_statistics": _with(flat) + "SELECT stddev_samp(d) AS std, quantile_disc(d, 0.5) AS median, quantile_cont(d, 0.25) AS quarter FROM em",
        "poincare_lift": _with("q AS (SELECT id, vec[1] / 2 AS x, vec[2] / 2 AS y, (vec[1] * vec[1] + vec[2] * vec[2]) / 4 AS s FROM emb2)", "l AS (SELECT id, [(1 + s) / (1 - s), 2 * x / (1 - s), 2 * y / (1 - s)] AS y FROM q)") + _coordinates("l", "y", 3),
        "split_train": _with() + f"SELECT id, label FROM u WHERE {drawn} % 7 <> 0",
        "split_test": _with() + f"SELECT id, label FROM u WHERE {drawn} % 7 = 0",
        "head_points": _with() + "SELECT id, label FROM u WHERE id < 100",
        "random_points": _with() + f"SELECT id, label FROM u ORDER BY {drawn}, id LIMIT 100",
        "evaluation_sample": _with() + f"SELECT id FROM u ORDER BY {drawn}, id LIMIT 200",
        "experiment_results": _with(f"e AS ({means})") + "SELECT *, 'Set ' || substring(\"Dataset\", 5) AS \"Title\" FROM e WHERE \"Curvature\" <> 0",
        "experiment_pivot": _with() + "SELECT 'set_' || label AS \"Dataset\", avg(vec[1]) AS \"-1.0\", avg(vec[2]) AS \"0.0\", avg(vec[3]) AS \"1.0\" FROM u GROUP BY label",
        "stereographic_small_sphere": found["stereographic"],
        "poincare_curved": found["poincare"],
    }


#: Derivatives of a distance by the coordinates of its first point, and the distances up to which there are none.
_UNIT = {
    "euclid": ["(a.vec[{c}] - b.vec[{c}]) / p.d"] * 3,
    "sphere": ["-b.vec[{c}] / sqrt(1 - cos(p.d) * cos(p.d))"] * 3,
    "hyper": ["b.vec[{c}] / sqrt(cosh(p.d) * cosh(p.d) - 1)"] + ["-b.vec[{c}] / sqrt(cosh(p.d) * cosh(p.d) - 1)"] * 2,
}
_LEAST = {"euclid": 0.0, "sphere": math.acos(1 - CLAMP) * (1 + 1e-9), "hyper": math.acosh(1 + CLAMP) * (1 + 1e-9)}  # clamped pairs do not pull


def _gradient() -> dict[str, str]:
    out, unit, least = {}, _UNIT, _LEAST
    for kind, table in _TABLE.items():
        n = 2 if kind == "euclid" else 3
        ctes = [
            _pairs("p0", table, _DISTANCE[kind]),
            "nn AS (SELECT count(*) AS n FROM u)",
            "p1 AS (SELECT i, j, d, 1 / (1 + d * d) AS k, CASE WHEN j = (i + 1) % n OR i = (j + 1) % n THEN 1.0 / (2 * n) ELSE 0 END AS v FROM p0, nn)",
            "z AS (SELECT sum(k) AS z FROM p1)",
            "p2 AS (SELECT i, j, d, k, k / z AS q, v * (k / z) / (k / z + 1e-12) AS w FROM p1, z)",
            "s AS (SELECT sum(w) AS s FROM p2)",
            "p AS (SELECT i, j, d, 4 * d * k * (w - s * q) AS a FROM p2, s)",
        ]
        parts = [f"SELECT p.i AS id, {c}::INTEGER AS c, 1e3 * sum(CASE WHEN p.d > {least[kind]} THEN p.a * {unit[kind][c].format(c=c + 1)} ELSE 0 END) AS x FROM p JOIN {table} a ON a.id = p.i JOIN {table} b ON b.id = p.j GROUP BY p.i" for c in range(n)]
        out[f"gradient_{kind}"] = _with(*ctes) + " UNION ALL ".join(parts)
        if kind == "hyper":
            ctes[1:3] = ["p1 AS (SELECT i, j, d, 1 / (1 + d * d) AS k, coalesce(v, 0) AS v FROM p0 LEFT JOIN af USING (i, j))"]
            out["affinity_gradient"] = _with(*_sigma(int(3 * PERPLEXITY + 1)), AFFINITIES, *(x.replace("p AS (", "pp AS (") if x.startswith("p AS") else x for x in ctes), recursive=True) + " UNION ALL ".join(parts).replace("FROM p JOIN", "FROM pp p JOIN")
    return out


def _drawn(of: str, seed: int) -> str:
    """The share from 0 to below 1 that a number draws."""
    return f"('0x' || substring(md5({of}::VARCHAR || ':{seed}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def _uniform(name: str, batch: int | str, seed: int) -> str:
    """Uniform pairs by the number of their draw; points are numbered by id."""
    a, o = f"floor({_drawn('t', seed)} * n)::BIGINT", f"floor({_drawn('t', seed + 1)} * (n - 1))::BIGINT"
    return f"{name} AS (SELECT t AS draw, a.id AS i, b.id AS j FROM (SELECT t, {a} AS a, ({a} + 1 + {o}) % n AS b FROM range({batch}) r(t), nn) r JOIN num a ON a.number = r.a JOIN num b ON b.number = r.b)"


def _samples(batch: int = 200, seed: int = 42, k: int = 15, bins: int = 10, close: float = 3.0) -> dict[str, str]:
    numbered = ["nn AS (SELECT count(*) AS n FROM u)", "num AS (SELECT row_number() OVER (ORDER BY id) - 1 AS number, id FROM u)"]
    near = lambda n: f"SELECT nb.i, nb.j FROM (SELECT floor({_drawn('t', seed)} * n)::BIGINT AS a, floor({_drawn('t', seed + 1)} * {k})::BIGINT + 1 AS r FROM range({n}) q(t), nn) q JOIN num ON num.number = q.a JOIN nb ON nb.i = num.id AND nb.rank = q.r"
    w = [close + (1 - close) * b / (bins - 1) for b in range(bins)]
    ends = [*(sum(w[: b + 1]) / sum(w) for b in range(bins - 1)), 1.0]
    starts = [0.0, *ends[:-1]]
    edges = ", ".join(repr(b / bins) for b in range(bins + 1))
    return {
        "sample_random": _with(*numbered, _uniform("un", batch, seed)) + "SELECT i, j FROM un",
        "sample_knn": _with(*numbered, HIGH_PAIRS, _near("nb", "hi", k)) + near(batch),
        "sample_negative": _with(*numbered, HIGH_PAIRS, _near("nb", "hi", k), _uniform("un", batch - int(batch * 0.7), seed + 2)) + near(int(batch * 0.7)) + " UNION ALL SELECT i, j FROM un",
        "sample_stratified": _with(
            *numbered, HIGH_PAIRS, _uniform("sm", "(SELECT least(100000, n * (n - 1)) FROM nn)", seed + 3),
            f"ed AS (SELECT quantile_cont(d, [{edges}]) AS e FROM sm JOIN hi USING (i, j))",
            f"bn AS (SELECT b, e[b + 1] AS low, e[b + 2] AS high, {starts!r}[b + 1] AS s, {ends!r}[b + 1] AS t FROM range({bins}) x(b), ed)",
            f"wa AS (SELECT b, count(*) AS wanted FROM (SELECT {_drawn('t', seed + 7)} AS u FROM range({batch}) r(t)) d JOIN bn ON u >= s AND u < bn.t GROUP BY b)",
            _uniform("ca", 4 * batch, seed),
            f"cb AS (SELECT b, draw, i, j, row_number() OVER (PARTITION BY b ORDER BY draw) AS place FROM ca JOIN hi USING (i, j) JOIN bn ON d >= low AND (d < high OR b = {bins - 1} AND d = high))",
            "tk AS (SELECT i, j FROM cb JOIN wa USING (b) WHERE place <= wanted)",
            _uniform("un", f"(SELECT {batch} - count(*) FROM tk)", seed + 5),
        ) + "SELECT i, j FROM tk UNION ALL SELECT i, j FROM un",
    }


#: The plane coordinates lifted to each space.
_LIFTED = {
    "euclid": "SELECT id, vec FROM emb2",
    "sphere": "SELECT id, [sqrt(1 - f * f * (vec[1] * vec[1] + vec[2] * vec[2])), f * vec[1], f * vec[2]] AS vec FROM (SELECT *, least(1, sqrt(1 - 1e-7) / greatest(sqrt(vec[1] * vec[1] + vec[2] * vec[2]), 1e-300)) AS f FROM emb2)",
    "hyper": "SELECT id, [sqrt(1 + vec[1] * vec[1] + vec[2] * vec[2]), vec[1], vec[2]] AS vec FROM emb2",
}


def _loss(p: str, table: str, kind: str, factor: float) -> list[str]:
    """The loss ({p}l) of points against the affinities, and what a gradient needs ({p}a)."""
    return [
        f"{p}p AS MATERIALIZED (SELECT a.id AS i, b.id AS j, {_DISTANCE[kind]} AS d FROM {table} a JOIN {table} b ON a.id <> b.id)",
        f"{p}k AS MATERIALIZED (SELECT i, j, d, 1 / (1 + d * d) AS k, {factor}::DOUBLE * coalesce(v, 0) AS v FROM {p}p LEFT JOIN af USING (i, j))",
        f"{p}w AS MATERIALIZED (SELECT i, j, d, k, k / z AS q, v, v * (k / z) / (k / z + 1e-12) AS w FROM {p}k, (SELECT sum(k) AS z FROM {p}k))",
        f"{p}l AS (SELECT sum(-v * ln(q + 1e-12)) AS loss FROM {p}w)",
        f"{p}a AS (SELECT i, j, 4 * d * k * (w - s * q) AS a, d FROM {p}w, (SELECT sum(w) AS s FROM {p}w))",
    ]


def _fit_iteration(kind: str, factor: float = 12.0, rate: float = 50.0) -> list[str]:
    """The start ({p}x), its loss ({p}l), and the points after one step and centring ({p}y)."""
    p, n = f"{kind[0]}_", 2 if kind == "euclid" else 3
    dot = lambda a, b: "(" + " + ".join(f"{a}[{c}] * {b}[{c}]" for c in range(1, n + 1)) + ")"
    lorentz = lambda a, b: f"(-{a}[1] * {b}[1] + {a}[2] * {b}[2] + {a}[3] * {b}[3])"
    mix = lambda a, x, b, y: "[" + ", ".join(f"({a}) * {x}[{c}] + ({b}) * {y}[{c}]" for c in range(1, n + 1)) + "]"
    parts = ", ".join(f"sum(CASE WHEN p.d > {_LEAST[kind]} THEN p.a * {_UNIT[kind][c].format(c=c + 1)} ELSE 0 END)" for c in range(n))
    out = [f"{p}x AS MATERIALIZED ({_LIFTED[kind]})", *_loss(p, f"{p}x", kind, factor), f"{p}g AS MATERIALIZED (SELECT p.i AS id, any_value(a.vec) AS vec, [{parts}] AS g FROM {p}a p JOIN {p}x a ON a.id = p.i JOIN {p}x b ON b.id = p.j GROUP BY p.i)"]
    tangent = {"euclid": f"SELECT id, vec, g AS t FROM {p}g", "sphere": f"SELECT id, vec, {mix('1', 'g', '-' + dot('g', 'vec'), 'vec')} AS t FROM {p}g", "hyper": f"SELECT id, vec, {mix('1', 'h', lorentz('vec', 'h'), 'vec')} AS t FROM (SELECT id, vec, [-g[1], g[2], g[3]] AS h FROM {p}g)"}
    speed = "[" + ", ".join(f"{-rate}::DOUBLE * t[{c}]" for c in range(1, n + 1)) + "]"
    clip = "[" + ", ".join(f"v[{c}] * least(1, 10 / greatest(size, 1e-300))" for c in range(1, n + 1)) + "]"
    out += [f"{p}t AS ({tangent[kind]})", f"{p}v AS (SELECT id, vec, {clip} AS v FROM (SELECT *, sqrt(sum{dot('v', 'v')} OVER ()) AS size FROM (SELECT id, vec, {speed} AS v FROM {p}t)))"]
    if kind == "euclid":
        return [*out, f"{p}m AS (SELECT id, {mix('1', 'vec', '1', 'v')} AS y FROM {p}v)", f"{p}y AS MATERIALIZED (SELECT id, [y[1] - a, y[2] - b] AS vec FROM {p}m, (SELECT avg(y[1]) AS a, avg(y[2]) AS b FROM {p}m))"]
    if kind == "sphere":
        step = f"CASE WHEN n < 1e-10 THEN vec ELSE {mix('cos(n)', 'vec', 'sin(n) / greatest(n, 1e-10)', 'v')} END"
        return [*out, f"{p}m AS (SELECT id, {step} AS y FROM (SELECT *, sqrt{dot('v', 'v')} AS n FROM {p}v))", f"{p}y AS MATERIALIZED (SELECT id, [y[1] / q, y[2] / q, y[3] / q] AS vec FROM (SELECT *, sqrt{dot('y', 'y')} AS q FROM {p}m))"]
    return [
        *out,
        f"{p}m AS (SELECT id, {mix('cosh(n)', 'vec', 'sinh(n) / n', 'v')} AS m FROM (SELECT *, least(sqrt(greatest({lorentz('v', 'v')}, 1e-15)), 10) AS n FROM {p}v))",
        f"{p}n AS (SELECT id, [sqrt(1 + m[2] * m[2] + m[3] * m[3]), m[2], m[3]] AS y FROM {p}m)",
        f"{p}c AS (SELECT c1 / c0 AS b1, c2 / c0 AS b2, c0 AS g FROM (SELECT a / q AS c0, b / q AS c1, c / q AS c2 FROM (SELECT *, sqrt(a * a - b * b - c * c) AS q FROM (SELECT avg(y[1]) AS a, avg(y[2]) AS b, avg(y[3]) AS c FROM {p}n))))",
        f"{p}f AS (SELECT id, y, b1, b2, (g - 1) * (y[2] * b1 + y[3] * b2) / (b1 * b1 + b2 * b2) - g * y[1] AS f FROM {p}n, {p}c)",
        f"{p}y AS MATERIALIZED (SELECT id, [sqrt(1 + pow(y[2] + f * b1, 2) + pow(y[3] + f * b2, 2)), y[2] + f * b1, y[3] + f * b2] AS vec FROM {p}f)",
    ]


def _fits(k: int) -> dict[str, str]:
    """One iteration of fits that begin at the plane coordinates, and the losses before and after."""
    start = [*_sigma(k), AFFINITIES.replace("af AS (", "af AS MATERIALIZED (")]
    out = {f"fit_iteration_{kind}": _with(*start, *_fit_iteration(kind), recursive=True) + _coordinates(f"{kind[0]}_y", "vec", 2 if kind == "euclid" else 3) for kind in _TABLE}
    seen = lambda kind, *ctes: _with(*start, *_fit_iteration(kind), *ctes, recursive=True)
    largest = "pm AS (SELECT max(sqrt(x * x + y * y)) AS m FROM pr)"
    scaled = "SELECT id, x / m AS x, y / m AS y, 1 / m AS scale FROM pr, pm"
    out["reprojected_euclid"] = seen("euclid", "pr AS (SELECT id, vec[2] AS x, vec[1] AS y FROM e_y)", largest) + scaled
    out["reprojected_hyper"] = seen("hyper") + "SELECT id, vec[3] / (vec[1] + 1) AS x, vec[2] / (vec[1] + 1) AS y, 1.0::DOUBLE AS scale FROM h_y"
    out["reprojected_sphere"] = seen("sphere", "pr AS (SELECT id, vec[1] / (1 - vec[2]) AS x, vec[3] / (1 - vec[2]) AS y FROM s_y)", largest) + scaled
    theta = "acos(greatest(least(-vec[3], 1), -1)) / pi()"
    out["reprojected_sphere_south"] = seen("sphere") + f"SELECT id, {theta} * cos(atan2(vec[1], vec[2])) AS x, {theta} * sin(atan2(vec[1], vec[2])) AS y, 1.0::DOUBLE AS scale FROM s_y"
    both = lambda kind: [*_fit_iteration(kind), *_loss(f"{kind[0]}_2", f"{kind[0]}_y", kind, 1.0)]
    every = [cte for kind in ("hyper", "euclid", "sphere") for cte in both(kind)]
    swept = " UNION ALL ".join(f"SELECT {c}::DOUBLE AS curvature, {n}::BIGINT AS iteration, round(loss, 6) AS loss FROM {kind[0]}_{part}" for c, kind in ((-1.0, "hyper"), (0.0, "euclid"), (1.0, "sphere")) for n, part in ((0, "l"), (1, "2l")))
    out["curvature_sweep"] = _with(*start, *every, recursive=True) + swept
    out["sweep_pivot"] = _with(*start, *every, recursive=True) + "SELECT 'embeddings' AS \"Dataset\", (SELECT round(loss, 6) FROM h_2l) AS \"-1.0\", (SELECT round(loss, 6) FROM e_2l) AS \"0.0\", (SELECT round(loss, 6) FROM s_2l) AS \"1.0\""
    log = _with(*start, *both("hyper"), "lg AS (SELECT 0::BIGINT AS iteration, loss, 'early' AS phase FROM h_l UNION ALL SELECT 1, loss, 'main' FROM h_2l)", "lr AS (SELECT iteration, round(loss, 4) AS loss, phase FROM lg)", recursive=True)
    out["run_log"] = log + "SELECT 'run' AS run_id, iteration, loss, phase FROM lr"
    out["run_progress"] = log + "SELECT 'run' AS run_id, iteration, round(loss, 4) AS loss, round(min(loss) OVER (ORDER BY iteration), 4) AS best, phase FROM lg"
    out["update_messages"] = log + """SELECT '{"type":"update","run_id":"run","iteration":' || iteration || ',"loss":' || loss || ',"phase":"' || phase || '"}' AS value FROM lr"""
    out["status_messages"] = log + """SELECT '{"type":"status","run_id":"run","done":' || (iteration + 1) || ',"total":10,"loss":' || loss || ',"running":true}' AS value FROM lr WHERE iteration = 1"""
    chart = "SELECT iteration, 300 - (log10(loss) - (SELECT log10(min(loss)) FROM lr)) / ((SELECT log10(max(loss)) FROM lr) - (SELECT log10(min(loss)) FROM lr)) * 300 AS y FROM lr"
    out["loss_chart"] = log + f"""SELECT 'run' AS run_id, '<polyline fill="none" stroke="steelblue" points="' || string_agg(printf('%.2f,%.2f', iteration * 600.0::DOUBLE, y), ' ' ORDER BY iteration) || '"/>' AS value FROM ({chart})"""
    return out


def _given(found: dict[str, str]) -> dict[str, str]:
    """Metrics of given distances: those of all components, and of the hyperboloid."""
    silhouettes = found["silhouette"].replace(LOW_PAIRS, HIGH_PAIRS).replace("FROM lo ", "FROM hi ")
    overlap = _with(HIGH_PAIRS, LOW_PAIRS, _near("a", "hi", 10), _near("b", "lo", 10)) + "SELECT count(*) / (10.0 * (SELECT count(*) FROM u)) AS value FROM a JOIN b USING (i, j)"
    parts = {"knn_overlap": f"({overlap})", "db_index_ratio": f"({found['db_ratio']})"} | {name: f"(SELECT {name} FROM ({found['all_metrics']}))" for name in ("area_utilisation", "radial_distribution", "class_density_measure", "cluster_density_measure")}
    return {
        "given_overlap": overlap,
        "given_trustworthiness": _with(HIGH_PAIRS, LOW_PAIRS, *_trust("lo", "hi", 10)) + "SELECT value FROM tv",
        "given_silhouette": silhouettes,
        "given_davies_bouldin": _with(HIGH_PAIRS, *_db("db", "hi")) + "SELECT value FROM db",
        "given_db_ratio": found["db_ratio"],
        "given_dunn": _with(HIGH_PAIRS) + "SELECT min(CASE WHEN li <> lj THEN d END) / max(CASE WHEN li = lj THEN d END) AS value FROM hi",
        "given_metrics": "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in parts.items()),
    }


def _classes() -> str:
    cell = f"(x0 - 0.05 * (x1 - x0) + 1.1 * (x1 - x0) * (cell % {GRID}) / {GRID - 1})"
    row = f"(y0 - 0.05 * (y1 - y0) + 1.1 * (y1 - y0) * (cell // {GRID}) / {GRID - 1})"
    return _with(
        "r AS (SELECT label, vec[1] AS x, vec[2] AS y FROM emb2)",
        "box AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM r)",
        "st AS (SELECT label, count(*) AS n, var_samp(x) AS sxx, var_samp(y) AS syy, covar_samp(x, y) AS sxy FROM r GROUP BY label)",
        "iv AS (SELECT label, syy / det / h AS a, -sxy / det / h AS b, sxx / det / h AS c FROM (SELECT *, sxx * syy - sxy * sxy AS det, pow(n, -1.0 / 3) AS h FROM st))",
        f"g AS (SELECT cell, {cell} AS gx, {row} AS gy FROM range({GRID * GRID}) t(cell), box)",
        "im AS (SELECT label, cell, sum(exp(-(a * (gx - x) * (gx - x) + 2 * b * (gx - x) * (gy - y) + c * (gy - y) * (gy - y)) / 2)) AS p FROM r JOIN iv USING (label), g GROUP BY label, cell)",
        "nm AS (SELECT label, cell, p / max(p) OVER (PARTITION BY label) AS p FROM im)",
    ) + f"SELECT sum(abs(a.p - b.p)) / {GRID * GRID} AS value FROM nm a JOIN nm b ON a.cell = b.cell AND a.label < b.label"


def _centre_hyper() -> str:
    return _with(
        "m AS (SELECT avg(vec[1]) AS a, avg(vec[2]) AS b, avg(vec[3]) AS c FROM hyp3)",
        "n AS (SELECT a / q AS c0, b / q AS c1, c / q AS c2 FROM (SELECT *, sqrt(a * a - b * b - c * c) AS q FROM m))",
        "v AS (SELECT c1 / c0 AS b1, c2 / c0 AS b2, c0 AS g FROM n)",
        "f AS (SELECT id, vec, b1, b2, (g - 1) * (vec[2] * b1 + vec[3] * b2) / (b1 * b1 + b2 * b2) - g * vec[1] AS f FROM hyp3, v)",
        "s AS (SELECT id, [sqrt(1 + pow(vec[2] + f * b1, 2) + pow(vec[3] + f * b2, 2)), vec[2] + f * b1, vec[3] + f * b2] AS y FROM f)",
    ) + _coordinates("s", "y", 3)


def oracle_sql() -> dict[str, str]:
    k = int(3 * PERPLEXITY + 1)
    silhouette = [
        LOW_PAIRS,
        "ds AS (SELECT i, li, lj, avg(d) AS m FROM lo GROUP BY i, li, lj)",
        "ab AS (SELECT i, max(CASE WHEN li = lj THEN m END) AS a, min(CASE WHEN li <> lj THEN m END) AS b FROM ds GROUP BY i)",
        "si AS (SELECT avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS value FROM ab)",
    ]
    g = "acosh(greatest(vec[1], 1 + 1e-7))"
    out = _maps() | _gradient()
    out |= {f"{kind}_pairs": _with(_pairs("p", table, _DISTANCE[kind])) + "SELECT i, j, d FROM p" for kind, table in _TABLE.items()}
    out |= {
        "knn_graph": _with(HIGH_PAIRS, _near("nn", "hi", 5)) + "SELECT i, rank, j, d FROM nn",
        "kth_distance": _with(HIGH_PAIRS, _near("nn", "hi", 10)) + "SELECT i, max(d) AS d FROM nn GROUP BY i",
        "mutual_knn": _with(HIGH_PAIRS, _near("nn", "hi", 10)) + "SELECT a.i, a.j FROM nn a JOIN nn b ON a.i = b.j AND a.j = b.i WHERE a.i < a.j",
        "gather_pairs": _with(LOW_PAIRS) + "SELECT i, j, d FROM lo WHERE j = (i + 1) % (SELECT count(*) FROM u)",
        "normalize_exact": _with(HIGH_PAIRS) + "SELECT avg(d) AS mean FROM hi",
        "lift_sphere": _with("m AS (SELECT id, vec, least(1, sqrt(1 - 1e-7) / greatest(sqrt(vec[1] * vec[1] + vec[2] * vec[2]), 1e-300)) AS f FROM emb2)", "s AS (SELECT id, [sqrt(1 - f * f * (vec[1] * vec[1] + vec[2] * vec[2])), f * vec[1], f * vec[2]] AS y FROM m)") + _coordinates("s", "y", 3),
        "lift_hyper": _with("s AS (SELECT id, [sqrt(1 + vec[1] * vec[1] + vec[2] * vec[2]), vec[1], vec[2]] AS y FROM emb2)") + _coordinates("s", "y", 3),
        "center_euclid": _with("m AS (SELECT avg(vec[1]) AS a, avg(vec[2]) AS b FROM emb2)", "s AS (SELECT id, [vec[1] - a, vec[2] - b] AS y FROM emb2, m)") + _coordinates("s", "y", 2),
        "center_hyper": _centre_hyper(),
        "scaling_euclid": _with() + "SELECT pow(sqrt(avg(vec[1] * vec[1] + vec[2] * vec[2])) - 1, 2) AS loss FROM emb2",
        "scaling_rms": _with() + f"SELECT pow(sqrt(avg({g} * {g})) - 1, 2) AS loss FROM hyp3",
        "scaling_hard_barrier": _with() + f"SELECT avg(pow(greatest({g} - 3, 0), 2)) AS loss FROM hyp3",
        "scaling_softplus_barrier": _with() + f"SELECT avg(CASE WHEN {g} - 3 > 20 THEN {g} - 3 ELSE ln(1 + exp({g} - 3)) END) AS loss FROM hyp3",
        "scaling_mean_distance": _with() + f"SELECT avg({g}) AS loss FROM hyp3",
        "sigma_search": _with(*_sigma(k), recursive=True) + "SELECT i, sigma FROM sg",
        "sql_knn": _with(HIGH_PAIRS, _near("nn", "hi", 5)) + "SELECT i, rank, j, d FROM nn",
        "sql_affinities": _with(*_sigma(k), recursive=True) + "SELECT i, j, sum(p) / (SELECT 2 * sum(p) FROM cp) AS v FROM (SELECT i, j, p FROM cp UNION ALL SELECT j, i, p FROM cp) GROUP BY i, j",
        "conditional_p": _with(*_sigma(k), recursive=True) + "SELECT i, j, p FROM cp",
        "affinities": _with(*_sigma(k), recursive=True) + "SELECT i, j, sum(p) / (SELECT 2 * sum(p) FROM cp) AS v FROM (SELECT i, j, p FROM cp UNION ALL SELECT j, i, p FROM cp) GROUP BY i, j",
        "t_kernel": _with(_pairs("p", "emb2", _DISTANCE["euclid"])) + "SELECT i, j, 1 / (1 + d * d) AS kernel, -2 * d / pow(1 + d * d, 2) AS slope FROM p",
        "kl_loss": _with(LOW_PAIRS, "ke AS (SELECT i, j, 1 / (1 + d * d) AS k, (SELECT count(*) FROM u) AS n FROM lo)") + "SELECT sum(-1.0 / (2 * n) * ln(k / (SELECT sum(k) FROM ke) + 1e-12)) AS loss FROM ke WHERE j = (i + 1) % n OR i = (j + 1) % n",
        "trustworthiness": _with(HIGH_PAIRS, FLAT_PAIRS, *_trust("fl", "hi", 10)) + "SELECT value FROM tv",
        "continuity": _with(HIGH_PAIRS, FLAT_PAIRS, *_trust("hi", "fl", 10)) + "SELECT value FROM tv",
        "knn_overlap": _with(HIGH_PAIRS, FLAT_PAIRS, _near("a", "hi", 10), _near("b", "fl", 10)) + "SELECT count(*) / (10.0 * (SELECT count(*) FROM u)) AS value FROM a JOIN b USING (i, j)",
        "distortion_gu": _with(HIGH_PAIRS, LOW_PAIRS) + "SELECT avg(abs(pow(lo.d / hi.d, 2) - 1)) AS value FROM hi JOIN lo USING (i, j) WHERE i < j",
        "distortion_mse": _with(HIGH_PAIRS, LOW_PAIRS) + "SELECT avg(pow(lo.d - hi.d, 2)) AS value FROM hi JOIN lo USING (i, j) WHERE i < j",
        "volume_distortion": _with(HIGH_PAIRS, LOW_PAIRS, _near("a", "hi", 10), _near("b", "lo", 10)) + f"SELECT avg(abs(ln(greatest(b.d, {FLOOR}) / greatest(a.d, {FLOOR})))) AS value FROM a JOIN b USING (i) WHERE a.rank = 10 AND b.rank = 10",
        "area_utilisation": _with(
            "p AS (SELECT DISTINCT vec[1] AS x, vec[2] AS y FROM emb2)",
            # A directed edge between two points belongs to the hull where no point lies to its right.
            "ed AS (SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM p a JOIN p b ON a.x <> b.x OR a.y <> b.y WHERE NOT EXISTS (SELECT 1 FROM p c WHERE (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0))",
        ) + "SELECT sum(ax * b_y - bx * ay) / 2 / (SELECT (max(x) - min(x)) * (max(y) - min(y)) FROM p) AS value FROM ed",
        "radial_distribution": _with("m AS (SELECT avg(vec[1]) AS a, avg(vec[2]) AS b FROM emb2)", "r AS (SELECT sqrt(pow(vec[1] - a, 2) + pow(vec[2] - b, 2)) AS r FROM emb2, m)") + "SELECT stddev_pop(r) / avg(r) AS value FROM r",
        "silhouette": _with(*silhouette) + "SELECT value FROM si",
        "metric_panel": _with(*silhouette) + "SELECT 'silhouette' AS metric, format('{:.4f}', value) AS value FROM si",
        "davies_bouldin": _with(LOW_PAIRS, *_db("db", "lo")) + "SELECT value FROM db",
        "db_ratio": _with(HIGH_PAIRS, LOW_PAIRS, *_db("dh", "hi"), *_db("dl", "lo")) + "SELECT dh.value / dl.value AS value FROM dh, dl",
        "dunn": _with(LOW_PAIRS) + "SELECT min(CASE WHEN li <> lj THEN d END) / max(CASE WHEN li = lj THEN d END) AS value FROM lo",
        "cluster_density": _with(
            "c AS (SELECT label, avg(vec[1]) AS a, avg(vec[2]) AS b FROM emb2 GROUP BY label)",
            "r AS (SELECT label, greatest(avg(sqrt(pow(vec[1] - a, 2) + pow(vec[2] - b, 2))), 1e-12) AS r FROM emb2 JOIN c USING (label) GROUP BY label)",
            "x AS (SELECT label, a, b, r FROM c JOIN r USING (label))",
        ) + "SELECT sum((pow(p.a - q.a, 2) + pow(p.b - q.b, 2)) / (p.r * q.r)) / (SELECT count(*) FROM x) AS value FROM x p JOIN x q ON p.label < q.label",
        "class_density": _classes(),
        "stereographic": _with("p AS (SELECT id, vec[2] / (1 - vec[1]) AS x, vec[3] / (1 - vec[1]) AS y FROM sph3)", "m AS (SELECT max(sqrt(x * x + y * y)) AS m FROM p)") + "SELECT id, x / m AS x, y / m AS y FROM p, m",
        "azimuthal_equidistant": _with() + "SELECT id, acos(-vec[1]) / pi() * cos(atan2(vec[3], vec[2])) AS x, acos(-vec[1]) / pi() * sin(atan2(vec[3], vec[2])) AS y FROM sph3",
        "orthographic": _with() + "SELECT id, vec[2] AS x, vec[3] AS y FROM sph3",
        "euclid2d": _with("m AS (SELECT max(sqrt(vec[1] * vec[1] + vec[2] * vec[2])) AS m FROM emb2)") + "SELECT id, vec[1] / m AS x, vec[2] / m AS y FROM emb2, m",
        "poincare": _with() + "SELECT id, vec[2] / (vec[1] + 1) AS x, vec[3] / (vec[1] + 1) AS y FROM hyp3",
        "aligned": _with(
            "m AS (SELECT avg(vec[1]) AS a, avg(vec[2]) AS b, avg(vec[3]) AS c FROM sph3)",
            "w AS (SELECT a / n + 1 AS a, b / n AS b, c / n AS c FROM (SELECT *, sqrt(a * a + b * b + c * c) AS n FROM m))",
            "f AS (SELECT id, vec, a, b, c, 2 * (vec[1] * a + vec[2] * b + vec[3] * c) / (a * a + b * b + c * c) AS f FROM sph3, w)",
            "s AS (SELECT id, [vec[1] - f * a, vec[2] - f * b, vec[3] - f * c] AS y FROM f)",
        ) + _coordinates("s", "y", 3),
        "label_colors": _with("l AS (SELECT label, (dense_rank() OVER (ORDER BY label) - 1) % 10 AS r FROM (SELECT DISTINCT label FROM u))", f"c AS (SELECT label, {list(PALETTE)}[r + 1] AS h FROM l)")
        + "SELECT label, ('0x' || h[2:3])::INTEGER / 255.0::DOUBLE AS red, ('0x' || h[4:5])::INTEGER / 255.0::DOUBLE AS green, ('0x' || h[6:7])::INTEGER / 255.0::DOUBLE AS blue FROM c",
    }
    out |= _more(out, k)
    return out | _samples() | _fits(k) | _given(out)
