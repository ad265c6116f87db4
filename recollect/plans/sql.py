"""The same computations as SQL text, built from common table expressions."""

from __future__ import annotations

EPS = "2.220446049250313e-16"


def contingency(features: list[str], rows: str = "train", name: str = "ct", occ: str = "1") -> str:
    parts = " UNION ALL ".join(f"SELECT {i} AS fidx, {f} AS fval, class, SUM({occ}) AS cnt FROM {rows} GROUP BY {f}, class" for i, f in enumerate(features, 1))
    return f"{name} AS ({parts})"


def classes(rows: str = "train", occ: str = "1") -> str:
    return f"cls AS (SELECT class, ROW_NUMBER() OVER (ORDER BY MIN(iid), class) AS class_idx, SUM({occ}) AS gfreq FROM {rows} GROUP BY class)"


def weights(table: str = "ct", name: str = "wt", clamp: bool = True) -> str:
    """Entropies, gain, gain ratio, chi-square and shared variance of each feature."""
    ig = "GREATEST(h - hv, 0.0)" if clamp else "h - hv"
    least = "(LEAST(n_classes, n_vals) - 1)"
    return f"""{name}_v AS (SELECT fidx, fval, SUM(cnt) AS nv FROM {table} GROUP BY fidx, fval),
{name}_c AS (SELECT fidx, class, SUM(cnt) AS nc FROM {table} GROUP BY fidx, class),
{name}_n AS (SELECT fidx, SUM(cnt) AS n FROM {table} GROUP BY fidx),
{name}_h AS (SELECT c.fidx, SUM(-(nc / n) * LOG2(nc / n)) AS h, COUNT(*) AS n_classes FROM {name}_c c JOIN {name}_n n ON c.fidx = n.fidx GROUP BY c.fidx),
{name}_s AS (SELECT v.fidx, SUM(-(nv / n) * LOG2(nv / n)) AS si, COUNT(*) AS n_vals FROM {name}_v v JOIN {name}_n n ON v.fidx = n.fidx GROUP BY v.fidx),
{name}_x AS (SELECT t.fidx, SUM(-(t.cnt / n.n) * LOG2(t.cnt / v.nv)) AS hv, SUM(t.cnt * t.cnt * n.n / (v.nv * c.nc)) - MAX(n.n) AS x2 FROM {table} t JOIN {name}_v v ON t.fidx = v.fidx AND t.fval = v.fval JOIN {name}_c c ON t.fidx = c.fidx AND t.class = c.class JOIN {name}_n n ON t.fidx = n.fidx GROUP BY t.fidx),
{name} AS (SELECT n.fidx, s.n_vals, {ig} AS ig, s.si, CASE WHEN ABS(s.si) < {EPS} THEN 0.0 ELSE ({ig}) / s.si END AS gr, x.x2, CASE WHEN {least} > 0 THEN x.x2 / (n.n * {least}) ELSE 0.0 END AS sv FROM {name}_n n JOIN {name}_h h ON n.fidx = h.fidx JOIN {name}_s s ON n.fidx = s.fidx JOIN {name}_x x ON n.fidx = x.fidx)"""


def pattern(features: list[str], rows: str = "train", occ: str = "1") -> str:
    f = ", ".join(features)
    return f"pat AS (SELECT {f}, class, SUM({occ}) AS cnt FROM {rows} GROUP BY {f}, class)"


def overlap(f: str) -> str:
    return f"CASE WHEN q.{f} = p.{f} THEN 0.0 ELSE 1.0 END"


def weighted(features: list[str], weighting: str, deltas: dict[str, str] | None = None) -> str:
    """Weighted sum of the features' distances."""
    deltas = deltas or {}
    w = lambda i: "1.0" if weighting == "nw" else f"(SELECT {weighting} FROM wt WHERE fidx = {i})"
    return " + ".join(f"{w(i)} * ({deltas.get(f, overlap(f))})" for i, f in enumerate(features, 1))


def nearest(features: list[str], distance: str, k: int, shortcut: bool, on: str = "TRUE", joins: str = "", count: str = "p.cnt", where: str = "TRUE") -> str:
    """Counts by distance, ranked; the k + 1 nearest buckets of each query."""
    same = " AND ".join(f"q.{f} = p.{f}" for f in features)
    keep = "(NOT hit OR r > 1 OR exact)" if shortcut else "TRUE"
    return f"""dist AS (SELECT q.qid, p.class, {count} AS cnt, ROUND({distance}, 10) AS d, ({same}) AS exact FROM qry q JOIN pat p ON {on} {joins} WHERE {where}),
grp AS (SELECT qid, d, exact, class, SUM(cnt) AS cnt FROM dist GROUP BY qid, d, exact, class),
rnk AS (SELECT *, DENSE_RANK() OVER (PARTITION BY qid ORDER BY d) AS r FROM grp),
hits AS (SELECT *, BOOL_OR(exact) OVER (PARTITION BY qid) AS hit FROM rnk WHERE r <= {k + 1}),
bkt AS (SELECT qid, r, d, class, SUM(cnt) AS cnt, BOOL_OR(exact) AS exact FROM hits WHERE {keep} GROUP BY qid, r, d, class)"""


def factor(decay: str, far: str, a: float, b: float) -> str:
    return {
        "Z": "1.0",
        "ID": f"(1.0 / (d + {EPS}))",
        "IL": f"(CASE WHEN r = 1 OR {far} = near THEN 1.0 ELSE ({far} - d) / ({far} - near) END)",
        "ED": f"(CASE WHEN EXP(-{a} * POW(d, {b})) = 0 THEN {EPS} ELSE EXP(-{a} * POW(d, {b})) END)",
    }[decay]


def answer(k: int, decay: str = "Z", a: float = 1.0, b: float = 1.0, retry: bool = True, hidden: bool = False) -> str:
    """With ``hidden`` a query's own row doesn't count in its class's frequency. Votes, ties and the answer: ``ans(qid, predicted, distance, tie, exact)`` and ``dec(qid, class, class_idx, w)``."""
    again = "(t.tie AND NOT t.tie1)" if retry else "FALSE"
    often = "c.gfreq - CASE WHEN c.class = o.class THEN 1 ELSE 0 END" if hidden else "c.gfreq"
    own = " JOIN qry o ON o.qid = f.qid" if hidden else ""
    return f"""far AS (SELECT *, MIN(d) OVER (PARTITION BY qid) AS near, MAX(CASE WHEN r <= {k} THEN d END) OVER (PARTITION BY qid) AS far0, MAX(d) OVER (PARTITION BY qid) AS far1 FROM bkt),
tal AS (SELECT f.qid, f.class, c.class_idx, {often} AS gfreq, COALESCE(SUM(CASE WHEN r <= {k} THEN cnt * {factor(decay, 'far0', a, b)} END), 0.0) AS v, SUM(cnt * {factor(decay, 'far1', a, b)}) AS v1 FROM far f JOIN cls c ON f.class = c.class{own} GROUP BY f.qid, f.class, c.class_idx, {often}),
tie AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY ROUND(v, 10) DESC, gfreq DESC, class_idx) AS n0, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY ROUND(v1, 10) DESC, gfreq DESC, class_idx) AS n1, MAX(ROUND(v, 10)) OVER (PARTITION BY qid) AS m0, MAX(ROUND(v1, 10)) OVER (PARTITION BY qid) AS m1 FROM tal),
too AS (SELECT qid, SUM(CASE WHEN ROUND(v, 10) = m0 THEN 1 ELSE 0 END) > 1 AS tie, SUM(CASE WHEN ROUND(v1, 10) = m1 THEN 1 ELSE 0 END) > 1 AS tie1, MAX(CASE WHEN n0 = 1 THEN class END) AS c0, MAX(CASE WHEN n1 = 1 THEN class END) AS c1 FROM tie GROUP BY qid),
near AS (SELECT qid, MIN(d) AS distance FROM bkt WHERE r = 1 GROUP BY qid),
ans AS (SELECT t.qid, CASE WHEN {again} THEN c1 ELSE c0 END AS predicted, n.distance, t.tie, n.distance < {EPS} AS exact FROM too t JOIN near n ON t.qid = n.qid),
dec AS (SELECT * FROM (SELECT x.qid, x.class, x.class_idx, CASE WHEN {again} THEN x.v1 ELSE x.v END AS w FROM tal x JOIN too t ON x.qid = t.qid) WHERE w > 0)"""


def ordered_values(features: list[str], by: str) -> str:
    """``ord``: feature numbers by a measure, the best first; ``val(row)`` picks a row's values in that order."""
    return f"ord AS (SELECT LIST(fidx ORDER BY {by} DESC, fidx) AS fs, LIST({by} ORDER BY {by} DESC, fidx) AS ws FROM wt)"


def in_order(features: list[str], row: str) -> str:
    return f"LIST_TRANSFORM((SELECT fs FROM ord), lambda i: [{', '.join(f'{row}.{f}' for f in features)}][i])"
