"""Every operator as a query over the driver's tables, with its SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import statistics as S
from ..model import MemoryBasedLearner
from ..operators import edit, evaluate, search, tree, versions, vote
from ..options import TREE_ORDERS, Options
from ..storage import fresh
from . import sql as Q
from .views import BRAND, CUSTOMER, GAPS, LINE, ORDERS, PART, QUANTITY, View

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Query, text: str | None = None) -> None:
    QUERIES[name] = query
    if text is not None:
        SQL[name] = text


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to six decimals; minus zero becomes zero."""
    return df.withColumns({c: F.round(F.col(c), 6) + 0.0 for c in columns})


def six(*columns: str) -> str:
    return ", ".join(f"ROUND({c}, 6) + 0.0 AS {c}" for c in columns)


def learner(view: View, spark: SparkSession, sf_dir: str, **options) -> MemoryBasedLearner:
    return MemoryBasedLearner(Options(**options)).fit(view.train(spark, sf_dir), view.names)


# -- statistics ----------------------------------------------------------------------------------------------------

for name, view in (("part", PART), ("line", LINE), ("orders", ORDERS)):
    head = f"WITH {view.sql()}"
    add(f"class_table_{name}", lambda s, d, v=view: S.class_table(v.instances(s, d)), f"{head}, {Q.classes('inst')} SELECT class, class_idx, gfreq FROM cls")
    add(f"contingency_{name}", lambda s, d, v=view: S.contingency(v.instances(s, d), v.names), f"{head}, {Q.contingency(view.names, 'inst')} SELECT * FROM ct")
    add(f"db_entropy_{name}", lambda s, d, v=view: rounded(S.class_entropy(v.instances(s, d)), "db_entropy"), f"{head}, n AS (SELECT class, COUNT(*) AS n FROM inst GROUP BY class) SELECT ROUND(SUM(-(n / t) * LOG2(n / t)), 6) + 0.0 AS db_entropy FROM n, (SELECT SUM(n) AS t FROM n)")
    add(
        f"weights_{name}",
        lambda s, d, v=view: rounded(S.weights(S.contingency(v.instances(s, d), v.names)), "ig", "si", "gr", "x2", "sv"),
        f"{head}, {Q.contingency(view.names, 'inst')}, {Q.weights()} SELECT fidx, n_vals, {six('ig', 'si', 'gr', 'x2', 'sv')} FROM wt",
    )
    add(f"value_probs_{name}", lambda s, d, v=view: rounded(S.value_probs(S.contingency(v.instances(s, d), v.names)), "p"), f"{head}, {Q.contingency(view.names, 'inst')} SELECT fidx, fval, class, ROUND(cnt / SUM(cnt) OVER (PARTITION BY fidx, fval), 6) + 0.0 AS p, SUM(cnt) OVER (PARTITION BY fidx, fval) AS freq FROM ct")

BINNED = "val AS (SELECT DISTINCT fidx, fval, CAST(fval AS DOUBLE) AS x FROM ct), bin AS (SELECT fidx, fval, NTILE(20) OVER (PARTITION BY fidx ORDER BY x) AS b FROM val), bct AS (SELECT t.fidx, CAST(b AS VARCHAR) AS fval, class, SUM(cnt) AS cnt FROM ct t JOIN bin USING (fidx, fval) GROUP BY t.fidx, b, class)"
add("numeric_bins", lambda s, d: S.binned(S.contingency(QUANTITY.instances(s, d), QUANTITY.names)), f"WITH {QUANTITY.sql()}, {Q.contingency(QUANTITY.names, 'inst')}, {BINNED} SELECT * FROM bct")
add(
    "numeric_weights",
    lambda s, d: rounded(S.weights(S.binned(S.contingency(QUANTITY.instances(s, d), QUANTITY.names)), clamp=False), "ig", "si", "gr", "x2", "sv"),
    f"WITH {QUANTITY.sql()}, {Q.contingency(QUANTITY.names, 'inst')}, {BINNED}, {Q.weights('bct', clamp=False)} SELECT fidx, n_vals, {six('ig', 'si', 'gr', 'x2', 'sv')} FROM wt",
)
add(
    "numeric_range_and_spread",
    lambda s, d: rounded(S.numeric_range(QUANTITY.instances(s, d), QUANTITY.names), "n_min", "n_max", "sd"),
    f"WITH {QUANTITY.sql()}, {Q.contingency(QUANTITY.names, 'inst')}, x AS (SELECT DISTINCT fidx, fval, TRY_CAST(fval AS DOUBLE) AS x FROM ct), t AS (SELECT fidx, SUM(x) AS s FROM x GROUP BY fidx) SELECT x.fidx, {six('n_min', 'n_max', 'sd')}, n_bad FROM (SELECT x.fidx, MIN(x) AS n_min, MAX(x) AS n_max, SUM(CASE WHEN x IS NULL THEN 1 ELSE 0 END) AS n_bad, SQRT(SUM((s - x) * (s - x)) / COUNT(x)) AS sd FROM x JOIN t ON x.fidx = t.fidx GROUP BY x.fidx) x",
)
add("value_sets", lambda s, d: S.contingency(PART.instances(s, d), PART.names).groupBy("fidx").agg(F.array_join(F.array_sort(F.collect_set("fval")), ",").alias("values_")), f"WITH {PART.sql()}, {Q.contingency(PART.names, 'inst')} SELECT fidx, STRING_AGG(fval, ',' ORDER BY fval) AS values_ FROM (SELECT DISTINCT fidx, fval FROM ct) GROUP BY fidx")

PROBS = "pr AS (SELECT fidx, fval, class, cnt / SUM(cnt) OVER (PARTITION BY fidx, fval) AS p, SUM(cnt) OVER (PARTITION BY fidx, fval) AS freq FROM ct), pv AS (SELECT DISTINCT fidx, fval, freq FROM pr)"
TERMS = {
    "M": "ABS(p - q)",
    "J": "CASE WHEN p = 0 OR q = 0 THEN p + q ELSE p * LOG2(p / q) + q * LOG2(q / p) END",
    "S": "CASE WHEN p = 0 OR q = 0 THEN p + q ELSE p * LOG2(2 * p / (p + q)) + q * LOG2(2 * q / (p + q)) END",
}


def pair_table(kind: str, least: int = 1) -> str:
    """``prs(fidx, v, w, d)`` in SQL."""
    return f"{PROBS}, pq AS (SELECT a.fidx, a.fval AS v, b.fval AS w, LEAST(a.freq, b.freq) AS least, c.class, COALESCE(x.p, 0.0) AS p, COALESCE(y.p, 0.0) AS q FROM pv a JOIN pv b ON a.fidx = b.fidx AND a.fval <> b.fval CROSS JOIN (SELECT DISTINCT class FROM ct) c LEFT JOIN pr x ON x.fidx = a.fidx AND x.fval = a.fval AND x.class = c.class LEFT JOIN pr y ON y.fidx = b.fidx AND y.fval = b.fval AND y.class = c.class), prs AS (SELECT fidx, v, w, CASE WHEN MAX(least) < {least} THEN 1.0 ELSE SUM({TERMS[kind]}) / 2 END AS d FROM pq GROUP BY fidx, v, w)"


for kind, label in (("M", "value_difference"), ("J", "jeffrey"), ("S", "jensen_shannon")):
    add(
        f"pairs_{label}",
        lambda s, d, k=kind: rounded(M.distribution_pairs(M.packed(S.value_probs(S.contingency(rows := PART.instances(s, d), PART.names)), S.class_table(rows)), k, 3), "d"),
        f"WITH {PART.sql()}, {Q.contingency(PART.names, 'inst')}, {pair_table(kind, 3)} SELECT fidx, v, w, ROUND(d, 6) + 0.0 AS d FROM prs",
    )

NAMES = "SELECT a.n_name AS v, b.n_name AS w FROM nation a JOIN nation b ON a.n_name <> b.n_name"


def _name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return n.select(F.col("n_name").alias("v")).join(n.select(F.col("n_name").alias("w")), F.col("v") != F.col("w")).withColumn("fidx", F.lit(1).cast("long"))


BIGRAMS = "LIST_DISTINCT(LIST_TRANSFORM(RANGE(1, LENGTH({0})), lambda i: SUBSTRING({0}, i, 2)))"
add("pairs_dice", lambda s, d: rounded(M.string_pairs(_name_pairs(s, d), "DC"), "d"), f"SELECT CAST(1 AS BIGINT) AS fidx, v, w, ROUND(1.0 - 2.0 * LEN(LIST_INTERSECT({BIGRAMS.format('v')}, {BIGRAMS.format('w')})) / (LEN({BIGRAMS.format('v')}) + LEN({BIGRAMS.format('w')})), 6) + 0.0 AS d FROM ({NAMES})")
add("pairs_levenshtein", lambda s, d: M.string_pairs(_name_pairs(s, d), "L"))

# -- nearest neighbours --------------------------------------------------------------------------------------------


def predictions(view: View, **options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = learner(view, spark, sf_dir, **options).test(view.queries(spark, sf_dir))
        return rounded(out.select("qid", "class", "predicted", "distance", "tie", "exact"), "distance")

    return run


def search_sql(view: View, weighting: str = "gr", k: int = 1, decay: str = "Z", a: float = 1.0, b: float = 1.0, shortcut: bool | None = None, deltas: dict[str, str] | None = None, extra: str = "", joins: str = "") -> str:
    """All common table expressions up to the answers."""
    shortcut = k == 1 if shortcut is None else shortcut
    distance = Q.weighted(view.names, weighting, deltas)
    return f"WITH {view.sql()}, {Q.contingency(view.names)}, {Q.classes()}, {Q.weights()}{extra}, {Q.pattern(view.names)}, {Q.nearest(view.names, distance, k, shortcut, joins=joins)}, {Q.answer(k, decay, a, b)}"


ANSWER = " SELECT a.qid, q.class, a.predicted, ROUND(a.distance, 6) + 0.0 AS distance, a.tie, a.exact FROM ans a JOIN qry q ON a.qid = q.qid"

for weighting in ("nw", "gr", "ig", "x2", "sv"):
    for k in (1, 3, 5):
        add(f"ib1_overlap_{weighting}_k{k}", predictions(PART, weighting=weighting, k=k), search_sql(PART, weighting, k) + ANSWER)
add("ib1_orders_k1", predictions(ORDERS), search_sql(ORDERS) + ANSWER)
# Asked for, an exact match alone is the answer, whatever k is.
add("ib1_exact_on_k3", predictions(PART, k=3, exact="on"), search_sql(PART, "gr", 3, shortcut=True).replace("(NOT hit OR r > 1 OR exact)", "(NOT hit OR exact)") + ANSWER)
add("ib1_exact_off_k1", predictions(PART, exact="off"), search_sql(PART, "gr", 1, shortcut=False) + ANSWER)
for decay, a, b in (("ID", 1.0, 1.0), ("IL", 1.0, 1.0), ("ED", 0.3, 1.0), ("ED", 2.0, 2.0)):
    add(f"decay_{decay.lower()}_{a:g}_{b:g}".replace(".", "_"), predictions(PART, k=5, decay=decay, decay_a=a, decay_b=b), search_sql(PART, "gr", 5, decay, a, b) + ANSWER)

EACH = [Options(k=k, decay=decay, decay_a=a) for k in (1, 3, 5) for decay, a in (("Z", 1.0), ("ID", 1.0), ("IL", 1.0), ("ED", 0.3))]
add(
    "settings_of_one_search",
    lambda s, d: rounded(learner(PART, s, d).test_each(PART.queries(s, d), EACH).select("setting", "qid", "class", "predicted", "distance", "tie", "exact"), "distance"),
    " UNION ALL ".join(f"SELECT CAST({n} AS BIGINT) AS setting, * FROM ({search_sql(PART, 'gr', o.k, o.decay, o.decay_a) + ANSWER})" for n, o in enumerate(EACH)),
)


def delta_sql(kind: str) -> dict[str, str]:
    return {f: f"CASE WHEN q.{f} = p.{f} THEN 0.0 ELSE COALESCE(x{i}.d, 1.0) END" for i, f in enumerate(PART.names, 1)}


PAIR_JOINS = " ".join(f"LEFT JOIN prs x{i} ON x{i}.fidx = {i} AND x{i}.v = q.{f} AND x{i}.w = p.{f}" for i, f in enumerate(PART.names, 1))
for kind, label in (("M", "value_difference"), ("J", "jeffrey"), ("S", "jensen_shannon")):
    add(f"ib1_{label}_k3", predictions(PART, metric=kind, k=3), search_sql(PART, "gr", 3, deltas=delta_sql(kind), extra=f", {pair_table(kind)}", joins=PAIR_JOINS) + ANSWER)
add("ib1_value_difference_exact_first", predictions(PART, metric="M"), search_sql(PART, "gr", 1, deltas=delta_sql("M"), extra=f", {pair_table('M')}", joins=PAIR_JOINS) + ANSWER)
SPAN = "(SELECT MAX(CAST({0} AS DOUBLE)) - MIN(CAST({0} AS DOUBLE)) FROM train)"
for kind, label, body in (("N", "numeric", "ABS(CAST(q.f2 AS DOUBLE) - CAST(p.f2 AS DOUBLE))"), ("E", "euclidean", "SQRT(ABS(CAST(q.f2 AS DOUBLE) * CAST(q.f2 AS DOUBLE) - CAST(p.f2 AS DOUBLE) * CAST(p.f2 AS DOUBLE)))")):
    add(f"ib1_{label}_k3", predictions(CUSTOMER, metric=f"O:{kind}2", weighting="nw", k=3), search_sql(CUSTOMER, "nw", 3, deltas={"f2": f"CASE WHEN q.f2 = p.f2 THEN 0.0 ELSE {body} / {SPAN.format('f2')} END"}) + ANSWER)
NUMBER = f"CASE WHEN q.f2 = p.f2 THEN 0.0 ELSE ABS(CAST(q.f2 AS DOUBLE) - CAST(p.f2 AS DOUBLE)) / {SPAN.format('f2')} END"
add("ib1_mixed_ignored", predictions(PART, metric="O:N3:I2", weighting="nw", k=3), search_sql(BRAND, "nw", 3, deltas={"f2": NUMBER}) + ANSWER)
add("ib1_user_weights", predictions(PART, weighting="user", weights={"1": 0.5, "2": 0.25, "3": 2.0}, k=3), search_sql(PART, "nw", 3).replace(Q.weighted(PART.names, "nw"), " + ".join(f"{w} * ({Q.overlap(f)})" for w, f in zip((0.5, 0.25, 2.0), PART.names, strict=True))) + ANSWER)
add("ib1_diversified", predictions(PART, diversify=True), search_sql(PART, extra=", wv AS (SELECT fidx, gr - (SELECT MIN(gr) FROM wt) + " + Q.EPS + " AS gr FROM wt)").replace("(SELECT gr FROM wt WHERE", "(SELECT gr FROM wv WHERE") + ANSWER)
LETTERS = "CASE WHEN q.{0} = p.{0} THEN 0.0 ELSE 1.0 - 2.0 * LEN(LIST_INTERSECT({1}, {2})) / (LEN({1}) + LEN({2})) END"
add("ib1_dice_k3", predictions(BRAND, metric="O:DC1", weighting="nw", k=3), search_sql(BRAND, "nw", 3, deltas={"f1": LETTERS.format("f1", BIGRAMS.format("q.f1"), BIGRAMS.format("p.f1"))}) + ANSWER)
add("ib1_levenshtein_k3", predictions(BRAND, metric="L", weighting="nw", k=3))

# -- missing values: a symbol like any other ---------------------------------------------------------------------------


def gaps_sql(text: str) -> str:
    """The SQL of a query over PART, with GAPS in its place and missing values as a symbol."""
    columns = GAPS._columns()
    for f in GAPS.names:
        columns = columns.replace(f" AS {f}", f" AS raw_{f}")
    filled = "inst AS (SELECT iid, " + ", ".join(f"COALESCE(raw_{f}, CHR(1)) AS {f}" for f in GAPS.names) + f", class FROM (SELECT {columns} FROM part))"
    return text.replace(f"inst AS (SELECT {PART._columns()} FROM part)", filled)


add("ib1_nulls", predictions(GAPS), gaps_sql(search_sql(PART)) + ANSWER)
add("ib1_nulls_value_difference", predictions(GAPS, metric="M", k=3), gaps_sql(search_sql(PART, "gr", 3, deltas=delta_sql("M"), extra=f", {pair_table('M')}", joins=PAIR_JOINS)) + ANSWER)


def similar(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
        names = [f"e{i}" for i in range(64)]
        rows = df.select(F.col("vec_id").alias("iid"), *(F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)), F.col("label").cast("string").alias("class"))
        fitted = MemoryBasedLearner(Options(metric=kind, weighting="nw", k=3)).fit(rows.where("iid % 5 <> 0"), names)
        out = fitted.test(rows.where("iid % 5 = 0").withColumn("qid", F.col("iid")))
        return rounded(out.select("qid", "class", "predicted", "distance", "tie"), "distance")

    return run


VECTORS = "inst AS (SELECT vec_id AS iid, CAST(embedding AS DOUBLE[]) AS f1, CAST(label AS VARCHAR) AS class FROM embeddings), train AS (SELECT * FROM inst WHERE iid % 5 <> 0), qry AS (SELECT iid AS qid, f1, class FROM inst WHERE iid % 5 = 0)"
DOT = "LIST_DOT_PRODUCT(q.f1, p.f1)"
for kind, label, body in (("C", "cosine", f"1.0 - {DOT} / (SQRT(LIST_DOT_PRODUCT(q.f1, q.f1) * LIST_DOT_PRODUCT(p.f1, p.f1)) + {Q.EPS})"), ("D", "dot_product", f"(2147483647.0 - {DOT}) / 2147483647.0")):
    text = f"WITH {VECTORS}, {Q.classes()}, {Q.pattern(['f1'])}, {Q.nearest(['f1'], body, 3, False)}, {Q.answer(3)} SELECT a.qid, q.class, a.predicted, ROUND(a.distance, 6) + 0.0 AS distance, a.tie FROM ans a JOIN qry q ON a.qid = q.qid"
    add(f"ib1_{label}_k3", similar(kind), text)

add(
    "neighbours_k3",
    lambda s, d: rounded(learner(PART, s, d).neighbors(PART.queries(s, d), 3), "distance"),
    search_sql(PART, "gr", 3, shortcut=False) + " SELECT qid, r AS k, ROUND(d, 6) + 0.0 AS distance, class, cnt FROM bkt WHERE r <= 3",
)


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = learner(PART, spark, sf_dir)
    queries = PART.queries(spark, sf_dir)
    plan = fitted.plan()
    part = lambda r: search.neighbours(search.distances(queries, search.base_table(fitted.fitted.instances.where(f"iid % 2 = {r}"), PART.names), plan, 2), 2)
    return rounded(search.truncated(search.merged(part(0), part(1)), 2), "distance")


def halves_sql() -> str:
    distance = Q.weighted(PART.names, "gr")
    part = lambda r: f"(SELECT qid, DENSE_RANK() OVER (PARTITION BY qid ORDER BY d) AS r, d, class, cnt FROM (SELECT q.qid, ROUND({distance}, 10) AS d, p.class, COUNT(*) AS cnt FROM qry q CROSS JOIN train p WHERE p.iid % 2 = {r} GROUP BY ALL))"
    return f"WITH {PART.sql()}, {Q.contingency(PART.names)}, {Q.weights()}, both_ AS (SELECT * FROM {part(0)} WHERE r <= 2 UNION ALL SELECT * FROM {part(1)} WHERE r <= 2), sums AS (SELECT qid, d, class, SUM(cnt) AS cnt FROM both_ GROUP BY qid, d, class), rk AS (SELECT qid, DENSE_RANK() OVER (PARTITION BY qid ORDER BY d) AS k, ROUND(d, 6) + 0.0 AS distance, class, cnt FROM sums) SELECT * FROM rk WHERE k <= 2"


add("neighbour_sets_merged", _halves, halves_sql())

# -- distributions -------------------------------------------------------------------------------------------------


def shares(how: str, beam: int = 0) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        fitted = learner(PART, spark, sf_dir, k=3, normalisation=how, beam=beam)
        return rounded(fitted.distribution(fitted.transform(PART.queries(spark, sf_dir))).select("qid", "class", "w"), "w")

    return run


VOTES = search_sql(PART, "gr", 3)
SHARE = {
    "none": "nrm AS (SELECT qid, class, w FROM dec)",
    "probability": "nrm AS (SELECT qid, class, w / SUM(w) OVER (PARTITION BY qid) AS w FROM dec)",
    "add": "nrm AS (SELECT qid, class, w / SUM(w) OVER (PARTITION BY qid) AS w FROM (SELECT a.qid, c.class, COALESCE(d.w, 0.0) + 1.0 AS w FROM ans a CROSS JOIN cls c LEFT JOIN dec d ON d.qid = a.qid AND d.class = c.class))",
    "log": "nrm AS (SELECT qid, class, LN(1 + w) / SUM(LN(1 + w)) OVER (PARTITION BY qid) AS w FROM dec)",
}
for how, body in SHARE.items():
    add(f"distribution_{how}", shares(how), f"{VOTES}, {body} SELECT qid, class, ROUND(w, 6) + 0.0 AS w FROM nrm")
add("distribution_beam", shares("none", 1), f"{VOTES}, {SHARE['none']} SELECT qid, class, ROUND(w, 6) + 0.0 AS w FROM (SELECT *, DENSE_RANK() OVER (PARTITION BY qid ORDER BY ROUND(w, 10) DESC) AS n FROM nrm) WHERE n <= 1")


def _confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = learner(PART, spark, sf_dir, k=3, normalisation="probability")
    return rounded(fitted.confidence(fitted.transform(PART.queries(spark, sf_dir))), "confidence")


add("confidence", _confidence, f"{VOTES}, {SHARE['probability']} SELECT n.qid, ROUND(w, 6) + 0.0 AS confidence FROM nrm n JOIN ans a ON n.qid = a.qid AND n.class = a.predicted")


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = learner(PART, spark, sf_dir, k=3)
    return fitted.transform(PART.queries(spark, sf_dir)).select("qid", vote.rendered(F.col("votes")).alias("distribution"))


add("distribution_text", _rendered, f"{VOTES} SELECT qid, '{{ ' || STRING_AGG(class || ' ' || PRINTF('%.5f', w), ', ' ORDER BY class_idx) || ' }}' AS distribution FROM dec GROUP BY qid")

# -- trees ---------------------------------------------------------------------------------------------------------

ORD = Q.ordered_values(PART.names, "gr")
KEYS = f"trk AS (SELECT t.*, {Q.in_order(PART.names, 't')} AS vs FROM train t), qrk AS (SELECT q.*, {Q.in_order(PART.names, 'q')} AS vs FROM qry q), dep AS (SELECT UNNEST(RANGE(0, {len(PART.names) + 1})) AS depth), nod AS (SELECT depth, LIST_SLICE(vs, 1, depth) AS pre, class, COUNT(*) AS cnt FROM trk CROSS JOIN dep GROUP BY ALL), tre AS (SELECT * FROM (SELECT n.depth, n.pre, n.class AS def, SUM(cnt) OVER (PARTITION BY depth, pre) AS n, ROW_NUMBER() OVER (PARTITION BY depth, pre ORDER BY cnt DESC, gfreq DESC, class_idx) AS nr FROM nod n JOIN cls c ON n.class = c.class) WHERE nr = 1)"
TREE = f"WITH {PART.sql()}, {Q.contingency(PART.names)}, {Q.classes()}, {Q.weights()}, {ORD}, {KEYS}"
WALK = "wlk AS (SELECT * FROM (SELECT q.qid, q.class, t.def AS predicted, t.depth, ROW_NUMBER() OVER (PARTITION BY q.qid ORDER BY t.depth DESC) AS nr FROM qrk q JOIN dep d ON TRUE JOIN tre t ON t.depth = d.depth AND t.pre = LIST_SLICE(q.vs, 1, d.depth)) WHERE nr = 1)"
REST = "COALESCE(LIST_SUM(LIST_SLICE((SELECT ws FROM ord), CAST(depth AS INT) + 1, 99)), 0.0)"


def _igtree(view: View) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = learner(view, spark, sf_dir, algorithm="IGTREE").test(view.queries(spark, sf_dir))
        return rounded(out.select("qid", "class", "predicted", "distance", "depth", "leaf"), "distance")

    return run


add("igtree_nodes", lambda s, d: learner(PART, s, d, algorithm="IGTREE").tree().groupBy(F.col("depth").cast("long").alias("depth"), "default").agg(F.count("*").alias("nodes"), F.sum("n").alias("rows")).withColumnRenamed("default", "def"), f"{TREE} SELECT CAST(depth AS BIGINT) AS depth, def, COUNT(*) AS nodes, SUM(n) AS rows FROM tre GROUP BY depth, def")


def _pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learner(PART, spark, sf_dir, algorithm="IGTREE").pruned().groupBy(F.col("depth").cast("long").alias("depth")).agg(F.count("*").alias("nodes"))


UP = "LIST_SLICE(c.pre, 1, c.depth - 1)"
PRUNE = f"""k3 AS (SELECT c.* FROM tre c JOIN tre p ON p.depth = 2 AND p.pre = {UP} WHERE c.depth = 3 AND c.def <> p.def),
k2 AS (SELECT c.* FROM tre c JOIN tre p ON p.depth = 1 AND p.pre = {UP} WHERE c.depth = 2 AND (c.def <> p.def OR c.pre IN (SELECT LIST_SLICE(pre, 1, 2) FROM k3))),
k1 AS (SELECT c.* FROM tre c JOIN tre p ON p.depth = 0 WHERE c.depth = 1 AND (c.def <> p.def OR c.pre IN (SELECT LIST_SLICE(pre, 1, 1) FROM k2)))"""
LEFT = "SELECT *, NOT EXISTS (SELECT 1 FROM k1) AS leaf FROM tre WHERE depth = 0 UNION ALL SELECT *, pre NOT IN (SELECT LIST_SLICE(pre, 1, 1) FROM k2) FROM k1 UNION ALL SELECT *, pre NOT IN (SELECT LIST_SLICE(pre, 1, 2) FROM k3) FROM k2 UNION ALL SELECT *, TRUE FROM k3"
ANSWERED = f"{PRUNE}, lft AS ({LEFT}), wlk AS (SELECT * FROM (SELECT q.qid, q.class, t.def AS predicted, t.depth, t.leaf, ROW_NUMBER() OVER (PARTITION BY q.qid ORDER BY t.depth DESC) AS nr FROM qrk q JOIN dep d ON TRUE JOIN lft t ON t.depth = d.depth AND t.pre = LIST_SLICE(q.vs, 1, d.depth)) WHERE nr = 1)"
add("igtree", _igtree(PART), f"{TREE}, {ANSWERED} SELECT qid, class, predicted, ROUND({REST}, 6) + 0.0 AS distance, depth, leaf FROM wlk")
add("igtree_nulls", _igtree(GAPS), gaps_sql(f"{TREE}, {ANSWERED} SELECT qid, class, predicted, ROUND({REST}, 6) + 0.0 AS distance, depth, leaf FROM wlk"))
add("igtree_pruned", _pruned, f"{TREE}, {PRUNE} SELECT CAST(depth AS BIGINT) AS depth, COUNT(*) AS nodes FROM (SELECT depth FROM tre WHERE depth = 0 UNION ALL SELECT depth FROM k1 UNION ALL SELECT depth FROM k2 UNION ALL SELECT depth FROM k3) GROUP BY depth")
add("base_levels", lambda s, d: learner(PART, s, d, tree_order="GRO").base_info().select(F.col("depth").cast("long").alias("depth"), "nodes"), f"{TREE} SELECT CAST(depth AS BIGINT) AS depth, COUNT(DISTINCT pre) AS nodes FROM nod WHERE depth > 0 GROUP BY depth")



def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = learner(PART, spark, sf_dir, weighting="sd").fitted.measures
    rows = [(name, place, fidx) for name in TREE_ORDERS for place, fidx in enumerate(S.tree_order(measures, name), 1)]
    return spark.createDataFrame(rows, "order_ string, place long, fidx long")


RANKS = {"DO": "1", "UDO": "fidx", "GRO": "gr", "IGO": "ig", "1/V": "1 / n_vals", "1/S": "CASE WHEN si = 0 THEN 0 ELSE 1 / si END", "G/V": "gr / n_vals", "I/V": "ig / n_vals", "GxE": "gr * si", "IxE": "ig * si", "X2O": "x2", "SVO": "sv", "SDO": "sd", "X/V": "x2 / n_vals", "S/V": "sv / n_vals", "SD/V": "sd / n_vals"}
SPREAD = "nm AS (SELECT DISTINCT fidx, TRY_CAST(fval AS DOUBLE) AS x FROM ct), ns AS (SELECT fidx, SUM(x) AS s FROM nm GROUP BY fidx), sp AS (SELECT nm.fidx, COALESCE(SQRT(SUM((s - x) * (s - x)) / COUNT(x)), 0.0) AS sd FROM nm JOIN ns ON nm.fidx = ns.fidx GROUP BY nm.fidx), ms AS (SELECT wt.*, sp.sd FROM wt JOIN sp USING (fidx))"
add("tree_orders", _orders, f"WITH {PART.sql()}, {Q.contingency(PART.names)}, {Q.weights()}, {SPREAD} " + " UNION ALL ".join(f"SELECT '{name}' AS order_, ROW_NUMBER() OVER (ORDER BY {rank} DESC, fidx) AS place, CAST(fidx AS BIGINT) AS fidx FROM ms" for name, rank in RANKS.items()))
add("spread_weights", lambda s, d: rounded(learner(PART, s, d, weighting="sd").weights().select("fidx", "weight"), "weight"), f"WITH {PART.sql()}, {Q.contingency(PART.names)}, {Q.weights()}, {SPREAD} SELECT CAST(fidx AS BIGINT) AS fidx, ROUND(sd, 6) + 0.0 AS weight FROM ms")
add("selected_features", lambda s, d: s.createDataFrame([(n,) for n in learner(PART, s, d).select_features(2).fitted.features], "feature string"), f"WITH {PART.sql()}, {Q.contingency(PART.names)}, {Q.weights()} SELECT feature FROM (SELECT 'f' || fidx AS feature, ROW_NUMBER() OVER (ORDER BY gr / n_vals DESC, fidx) AS place FROM wt) WHERE place <= 2")
add("base_compression", lambda s, d: rounded(learner(PART, s, d, tree_order="GRO").compression(), "saved"), f"{TREE}, lev AS (SELECT depth, COUNT(DISTINCT pre) AS nodes FROM nod WHERE depth > 0 GROUP BY depth) SELECT i + n AS nodes, n AS patterns, ROUND(100 * (1 - (i + n) / (n * {len(PART.names) + 1})), 6) + 0.0 AS saved FROM (SELECT SUM(nodes) AS i, MAX(CASE WHEN depth = {len(PART.names)} THEN nodes END) AS n FROM lev)")
add("level_distributions", lambda s, d: learner(PART, s, d, tree_order="GRO").levels().groupBy(F.col("depth").cast("long").alias("depth"), "class").agg(F.count("*").alias("cells"), F.sum("cnt").alias("rows")), f"{TREE} SELECT CAST(depth AS BIGINT) AS depth, class, COUNT(*) AS cells, SUM(cnt) AS rows FROM nod GROUP BY depth, class")
add("level_next_values", lambda s, d: learner(PART, s, d, tree_order="GRO").next_values().select(F.col("depth").cast("long").alias("depth"), F.array_join("key", "|").alias("prefix"), "next_value", F.col("cnt").alias("rows")), f"{TREE} SELECT CAST(depth AS BIGINT) AS depth, ARRAY_TO_STRING(LIST_SLICE(vs, 1, depth), '|') AS prefix, vs[depth + 1] AS next_value, COUNT(*) AS rows FROM trk CROSS JOIN dep WHERE depth < {len(PART.names)} GROUP BY ALL")
add("neighbour_examples", lambda s, d: rounded(learner(PART, s, d).examples(PART.queries(s, d), 2, 3), "distance"), search_sql(PART, "gr", 2, shortcut=False) + f" SELECT qid, k, ROUND(d, 6) + 0.0 AS distance, place, pattern, class, cnt FROM (SELECT qid, d, {' || chr(32) || '.join('p.' + f for f in PART.names)} AS pattern, class, cnt, DENSE_RANK() OVER (PARTITION BY qid ORDER BY d) AS k, ROW_NUMBER() OVER (PARTITION BY qid, d ORDER BY {' || chr(32) || '.join('p.' + f for f in PART.names)}, class) AS place FROM (SELECT q.qid, ROUND({Q.weighted(PART.names, 'gr')}, 10) AS d, p.* FROM qry q CROSS JOIN pat p) p) WHERE k <= 2 AND place <= 3")
add("vote_entropy", lambda s, d: rounded((m := learner(PART, s, d, k=3)).transform(PART.queries(s, d)).select("qid", vote.entropy(F.col("votes")).alias("entropy")), "entropy"), f"{VOTES} SELECT qid, ROUND(SUM(-(w / t) * LOG2(w / t)), 6) + 0.0 AS entropy FROM (SELECT *, SUM(w) OVER (PARTITION BY qid) AS t FROM dec) GROUP BY qid")
add("prune_to_tree", lambda s, d: rounded(learner(PART, s, d, tree_order="GRO").to_tree().test(PART.queries(s, d)).select("qid", "class", "predicted", "distance", "depth", "leaf"), "distance"), SQL["igtree"])

HYBRID = "SELECT qid, q.class, predicted, ROUND(distance, 6) + 0.0 AS distance, tie, exact FROM ({0}) a JOIN qry q USING (qid)"


def hybrid_sql(deepest: bool) -> str:
    """Exact matches, then neighbours under a shared prefix, then the tree."""
    distance = Q.weighted(PART.names, "gr")
    block = "AND q.dq = LEN(LIST_SLICE(p.vs, 1, q.dq)) AND LIST_SLICE(q.vs, 1, q.dq) = LIST_SLICE(p.vs, 1, q.dq)"
    depth = "(SELECT MAX(t.depth) FROM tre t WHERE t.pre = LIST_SLICE(q.vs, 1, t.depth))" if deepest else "1"
    same = " AND ".join(f"q.{f} = p.{f}" for f in PART.names)
    both = f"{TREE}, {WALK}, qd AS (SELECT q.*, {depth} AS dq FROM qrk q), pat AS (SELECT vs, {', '.join(PART.names)}, class, COUNT(*) AS cnt FROM trk GROUP BY ALL), dist AS (SELECT q.qid, p.class, p.cnt, ROUND({distance}, 10) AS d, ({same}) AS exact FROM qd q JOIN pat p ON TRUE {block}), grp AS (SELECT qid, d, exact, class, SUM(cnt) AS cnt, BOOL_OR(exact) OVER (PARTITION BY qid) AS hit FROM dist GROUP BY qid, d, exact, class), hits AS (SELECT *, DENSE_RANK() OVER (PARTITION BY qid ORDER BY d) AS r FROM grp WHERE NOT hit OR exact), bkt AS (SELECT qid, r, d, class, SUM(cnt) AS cnt, BOOL_OR(exact) AS exact FROM hits WHERE r <= 2 GROUP BY qid, r, d, class), {Q.answer(1)}"
    rest = "" if deepest else f" UNION ALL SELECT qid, predicted, {REST} AS distance, FALSE AS tie, FALSE AS exact FROM wlk WHERE qid NOT IN (SELECT qid FROM ans)"
    return f"{both} " + HYBRID.format(f"SELECT qid, predicted, distance, tie, exact FROM ans{rest}")


def hybrid(algorithm: str, **options) -> Query:
    return lambda s, d: predictions(PART, algorithm=algorithm, **options)(s, d)


add("tribl", hybrid("TRIBL", tribl_offset=1, tree_order="GRO"), hybrid_sql(False))
add("tribl2", hybrid("TRIBL2", tree_order="GRO"), hybrid_sql(True))

# -- weights of rows, editing, evaluation --------------------------------------------------------------------------


def _exemplar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = PART.train(spark, sf_dir).withColumn("exw", (F.col("iid") % 3 + 1).cast("double"))
    out = MemoryBasedLearner(Options(k=3)).fit(rows, PART.names).test(PART.queries(spark, sf_dir))
    return rounded(out.select("qid", "class", "predicted", "distance", "tie"), "distance")


EXEMPLAR = f"WITH {PART.sql()}, {Q.contingency(PART.names)}, {Q.classes()}, {Q.weights()}, pat AS (SELECT {', '.join(PART.names)}, class, COUNT(*) AS cnt, ARG_MIN(iid % 3 + 1, iid) AS exw FROM train GROUP BY ALL), {Q.nearest(PART.names, f'ROUND({Q.weighted(PART.names, "gr")}, 10) / (p.exw + {Q.EPS})', 3, False)}, {Q.answer(3)}"
add("exemplar_weights", _exemplar, EXEMPLAR + " SELECT a.qid, q.class, a.predicted, ROUND(a.distance, 6) + 0.0 AS distance, a.tie FROM ans a JOIN qry q ON a.qid = q.qid")


def _occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = PART.train(spark, sf_dir).withColumn("occ", F.col("iid") % 4 + 1)
    return rounded(MemoryBasedLearner(Options()).fit(rows, PART.names).test(PART.queries(spark, sf_dir)).select("qid", "class", "predicted", "distance", "tie", "exact"), "distance")


OCC = "iid % 4 + 1"
add("occurrence_counts", _occurrences, f"WITH {PART.sql()}, {Q.contingency(PART.names, occ=OCC)}, {Q.classes(occ=OCC)}, {Q.weights()}, {Q.pattern(PART.names, occ=OCC)}, {Q.nearest(PART.names, Q.weighted(PART.names, 'gr'), 1, True)}, {Q.answer(1)}" + ANSWER)


def _edited(sign: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        all_, some = PART.train(spark, sf_dir), F.col("iid") % 3 == 1
        start = all_.where(~some) if sign > 0 else all_
        fitted = MemoryBasedLearner(Options()).fit(start, PART.names).partial_fit(all_.where(some), sign)
        return rounded(fitted.test(PART.queries(spark, sf_dir)).select("qid", "class", "predicted", "distance", "tie", "exact"), "distance")

    return run


def _maintained(spark: SparkSession, sf_dir: str) -> MemoryBasedLearner:
    """A base that grows by thirds, loses a share of its rows, is compacted in between, and takes in another base."""
    rows = PART.instances(spark, sf_dir)
    train, other = (versions.VersionedBase(spark, fresh(spark, "base"), PART.names) for _ in range(2))
    for r in (1, 2):
        train.update(rows.where(f"iid % 5 <> 0 AND iid % 3 = {r}"))
    train.compact()
    train.update(rows.where("iid % 5 <> 0 AND iid % 7 = 1 AND iid % 3 > 0"), -1)
    other.update(rows.where("iid % 5 <> 0 AND iid % 3 = 0"))
    other.update(rows.where("iid % 5 <> 0 AND iid % 7 = 1 AND iid % 3 = 0"), -1)
    train.merge(other)
    return MemoryBasedLearner(Options()).learn(train.patterns(), train.cells(), PART.names)


REMAINING = PART.sql().replace("WHERE NOT (iid % 5 = 0)", "WHERE NOT (iid % 5 = 0) AND NOT (iid % 7 = 1)")
add("maintained_answers", lambda s, d: rounded(_maintained(s, d).test(PART.queries(s, d)).select("qid", "class", "predicted", "distance", "tie", "exact"), "distance"), search_sql(PART).replace(PART.sql(), REMAINING) + ANSWER)
add("maintained_weights", lambda s, d: rounded(_maintained(s, d).weights().select("fidx", "weight", "ig", "si", "x2", "sv"), "weight", "ig", "si", "x2", "sv"), f"WITH {REMAINING}, {Q.contingency(PART.names)}, {Q.weights()} SELECT CAST(fidx AS BIGINT) AS fidx, ROUND(gr, 6) + 0.0 AS weight, {six('ig', 'si', 'x2', 'sv')} FROM wt")
FEWER = PART.sql().replace("WHERE NOT (iid % 5 = 0)", "WHERE NOT (iid % 5 = 0) AND NOT (iid % 3 = 1)")
add("increment", _edited(1), search_sql(PART) + ANSWER)
add("decrement", _edited(-1), search_sql(PART).replace(PART.sql(), FEWER) + ANSWER)
add("signed_counts", lambda s, d: edit.changed(PART.train(s, d), PART.instances(s, d).where("iid % 3 = 1"), PART.names, -1).groupBy("class").agg(F.count("*").alias("patterns"), F.sum("occ").alias("occ")), f"WITH {PART.sql()}, u AS (SELECT f1, f2, f3, class, 1 AS o FROM train UNION ALL SELECT f1, f2, f3, class, -1 FROM inst WHERE iid % 3 = 1), g AS (SELECT f1, f2, f3, class, SUM(o) AS occ FROM u GROUP BY ALL HAVING SUM(o) > 0) SELECT class, COUNT(*) AS patterns, SUM(occ) AS occ FROM g GROUP BY class")
add("ib2", predictions(PART, algorithm="IB2", ib2_seed=100))

TESTED = f"{search_sql(PART)}, tst AS (SELECT q.class, a.* FROM ans a JOIN qry q ON a.qid = q.qid)"
MATRIX = "mat AS (SELECT c.class, t.predicted, COUNT(*) AS n FROM tst t LEFT JOIN cls c ON t.class = c.class GROUP BY c.class, t.predicted), tot AS (SELECT SUM(n) AS total FROM mat), cnt AS (SELECT c.class, c.gfreq, COALESCE((SELECT SUM(n) FROM mat m WHERE m.class = c.class AND m.predicted = c.class), 0) AS tp, COALESCE((SELECT SUM(n) FROM mat m WHERE m.class = c.class), 0) AS oc, COALESCE((SELECT SUM(n) FROM mat m WHERE m.predicted = c.class), 0) AS ac FROM cls c), sco AS (SELECT class, gfreq, tp, ac - tp AS fp, oc - tp AS fn, total - oc - ac + tp AS tn, tp / NULLIF(ac, 0) AS pre, tp / NULLIF(oc, 0) AS rec, (ac - tp) / NULLIF(total - oc, 0) AS fpr FROM cnt, tot), scr AS (SELECT class, gfreq, tp, fp, fn, tn, pre AS precision, rec AS recall, fpr, 2 * pre * rec / NULLIF(pre + rec, 0) AS f1, 0.5 * rec * fpr + rec * (1 - fpr) + 0.5 * (1 - rec) * (1 - fpr) AS auc FROM sco)"
add("accuracy", lambda s, d: rounded(learner(PART, s, d).evaluate(PART.queries(s, d)), "accuracy"), f"{TESTED} SELECT COUNT(*) AS tested, SUM(CAST(class = predicted AS BIGINT)) AS correct, ROUND(AVG(CAST(class = predicted AS INT)), 6) + 0.0 AS accuracy, SUM(CAST(exact AS BIGINT)) AS exact, SUM(CAST(tie AND class = predicted AS BIGINT)) AS ties_correct, SUM(CAST(tie AND class <> predicted AS BIGINT)) AS ties_failed FROM tst")
add("confusion", lambda s, d: evaluate.confusion((m := learner(PART, s, d)).test(PART.queries(s, d)), m.fitted.classes), f"{TESTED}, {MATRIX} SELECT class, predicted, n FROM mat")
add("class_scores", lambda s, d: rounded(learner(PART, s, d).scores(PART.queries(s, d)), "precision", "recall", "fpr", "f1", "auc"), f"{TESTED}, {MATRIX} SELECT class, gfreq, tp, fp, fn, tn, {six('precision', 'recall', 'fpr', 'f1', 'auc')} FROM scr")
add("average_scores", lambda s, d: rounded(evaluate.averages(learner(PART, s, d).scores(PART.queries(s, d))), "micro_f1", "macro_f1", "micro_auc", "macro_auc"), f"{TESTED}, {MATRIX} SELECT ROUND(SUM(f1 * gfreq) / SUM(CASE WHEN f1 IS NOT NULL THEN gfreq END), 6) + 0.0 AS micro_f1, ROUND(AVG(f1), 6) + 0.0 AS macro_f1, ROUND(SUM(auc * gfreq) / SUM(CASE WHEN auc IS NOT NULL THEN gfreq END), 6) + 0.0 AS micro_auc, ROUND(AVG(auc), 6) + 0.0 AS macro_auc FROM scr")


def _cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = PART.instances(spark, sf_dir).withColumn("fold", (F.col("iid") % 3).cast("long"))
    return rounded(MemoryBasedLearner(Options()).cross_validate(rows, PART.names).select("fold", "qid", "class", "predicted", "distance"), "distance")


def cross_sql() -> str:
    one = lambda r: f"SELECT CAST({r} AS BIGINT) AS fold, qid, class, predicted, distance FROM ({(search_sql(PART) + ANSWER).replace('iid % 5 = 0', f'iid % 3 = {r}')})"
    return " UNION ALL ".join(map(one, range(3)))


add("cross_validation", _cross, cross_sql())


def _leave_one_out(sloppy: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = MemoryBasedLearner(Options(exact="off", sloppy=sloppy)).fit(PART.instances(spark, sf_dir), PART.names).leave_one_out()
        return rounded(out.select("qid", "class", "predicted", "distance", "tie"), "distance")

    return run


LOO = PART.sql().replace(" WHERE NOT (iid % 5 = 0)", "").replace(" WHERE iid % 5 = 0", "")
SAME = " AND ".join(f"q.{f} = p.{f}" for f in PART.names)
OWN = f"p.cnt - CASE WHEN {SAME} AND p.class = q.class THEN 1 ELSE 0 END"
add("leave_one_out_sloppy", _leave_one_out(True), f"WITH {LOO}, {Q.contingency(PART.names)}, {Q.classes()}, {Q.weights()}, {Q.pattern(PART.names)}, {Q.nearest(PART.names, Q.weighted(PART.names, 'gr'), 1, False, count=OWN, where=f'{OWN} > 0')}, {Q.answer(1, hidden=True)} SELECT a.qid, q.class, a.predicted, ROUND(a.distance, 6) + 0.0 AS distance, a.tie FROM ans a JOIN qry q ON a.qid = q.qid")
# The weights of a feature without one row depend on that row's value and class; ``rem`` numbers these.
REMOVED = "rem AS (SELECT ROW_NUMBER() OVER (ORDER BY fidx, fval, class) AS rid, fidx, fval, class FROM ct), ctr AS (SELECT * FROM (SELECT r.rid AS fidx, t.fval, t.class, t.cnt - CASE WHEN t.fval = r.fval AND t.class = r.class THEN 1 ELSE 0 END AS cnt FROM rem r JOIN ct t ON t.fidx = r.fidx) WHERE cnt > 0)"
OWN_WEIGHTS = "own AS (SELECT r.fidx, r.fval, r.class, w.gr FROM rem r JOIN wr w ON w.fidx = r.rid)"
WITHOUT = " ".join(f"JOIN own o{i} ON o{i}.fidx = {i} AND o{i}.fval = q.{f} AND o{i}.class = q.class" for i, f in enumerate(PART.names, 1))
STRICT = " + ".join(f"o{i}.gr * ({Q.overlap(f)})" for i, f in enumerate(PART.names, 1))
add("leave_one_out_strict", _leave_one_out(False), f"WITH {LOO}, {Q.contingency(PART.names)}, {Q.classes()}, {REMOVED}, {Q.weights('ctr', 'wr')}, {OWN_WEIGHTS}, {Q.pattern(PART.names)}, {Q.nearest(PART.names, STRICT, 1, False, joins=WITHOUT, count=OWN, where=f'{OWN} > 0')}, {Q.answer(1, hidden=True)} SELECT a.qid, q.class, a.predicted, ROUND(a.distance, 6) + 0.0 AS distance, a.tie FROM ans a JOIN qry q ON a.qid = q.qid")


def _leave_one_out_numeric(weighting: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = MemoryBasedLearner(Options(exact="off", metric="O:N2", weighting=weighting)).fit(CUSTOMER.instances(spark, sf_dir), CUSTOMER.names).leave_one_out()
        return rounded(out.select("qid", "class", "predicted", "distance"), "distance")

    return run


def leave_one_out_numeric_sql(weighting: str) -> str:
    """Every row against all others, with bins, weights, range and spread taken anew from the others."""
    rest = "SELECT q.iid AS rid, t.iid, t.f1, t.f2, t.class FROM inst q JOIN inst t ON t.iid <> q.iid"
    binned = "vals AS (SELECT DISTINCT rid, f2, CAST(f2 AS DOUBLE) AS x FROM rest), bins AS (SELECT rid, f2, NTILE(20) OVER (PARTITION BY rid ORDER BY x, f2) AS b FROM vals)"
    cells = "rct AS (SELECT rid * 2 AS fidx, f1 AS fval, class, COUNT(*) AS cnt FROM rest GROUP BY ALL UNION ALL SELECT rid * 2 + 1, CAST(b AS VARCHAR), class, COUNT(*) FROM rest JOIN bins USING (rid, f2) GROUP BY ALL)"
    spread = "spr AS (SELECT rid, f, SQRT(SUM((s - x) * (s - x)) / COUNT(x)) AS sd FROM (SELECT rid, f, x, SUM(x) OVER (PARTITION BY rid, f) AS s FROM (SELECT DISTINCT rid, 0 AS f, f1 AS v, CAST(f1 AS DOUBLE) AS x FROM rest UNION ALL SELECT DISTINCT rid, 1, f2, CAST(f2 AS DOUBLE) FROM rest)) GROUP BY rid, f)"
    weigh = "(SELECT rid, MAX(CASE WHEN f = 0 THEN sd END) AS w1, MAX(CASE WHEN f = 1 THEN sd END) AS w2 FROM spr GROUP BY rid)" if weighting == "sd" else "(SELECT fidx // 2 AS rid, MAX(CASE WHEN fidx % 2 = 0 THEN GREATEST(ig, 0.0) / NULLIF(si, 0) END) AS w1, MAX(CASE WHEN fidx % 2 = 1 THEN gr END) AS w2 FROM wr GROUP BY 1)"
    parts = [CUSTOMER.sql().split(", train AS")[0], f"rest AS ({rest})", binned, cells, spread if weighting == "sd" else Q.weights("rct", "wr", clamp=False)]
    return f"""WITH {", ".join(parts)}, wid AS (SELECT rid, MAX(CAST(f2 AS DOUBLE)) - MIN(CAST(f2 AS DOUBLE)) AS width FROM rest GROUP BY rid),
near AS (SELECT q.iid AS qid, t.iid, t.class, ROUND(w.w1 * CASE WHEN q.f1 = t.f1 THEN 0 ELSE 1 END + w.w2 * CASE WHEN q.f2 = t.f2 THEN 0 ELSE ABS(CAST(q.f2 AS DOUBLE) - CAST(t.f2 AS DOUBLE)) / d.width END, 10) AS d FROM inst q JOIN inst t ON t.iid <> q.iid JOIN {weigh} w ON w.rid = q.iid JOIN wid d ON d.rid = q.iid),
rnk AS (SELECT *, DENSE_RANK() OVER (PARTITION BY qid ORDER BY d) AS r FROM near), cls AS (SELECT class, MIN(iid) AS first, COUNT(*) AS n FROM inst GROUP BY class),
tal AS (SELECT qid, t.class, COUNT(*) FILTER (r = 1) AS v, COUNT(*) AS v1, MIN(d) AS d, ANY_VALUE(first) AS first, ANY_VALUE(n) - CASE WHEN t.class = ANY_VALUE(q.class) THEN 1 ELSE 0 END AS n FROM rnk t JOIN cls c ON c.class = t.class JOIN inst q ON q.iid = t.qid WHERE r <= 2 GROUP BY qid, t.class),
top AS (SELECT *, RANK() OVER (PARTITION BY qid ORDER BY v DESC) AS a, RANK() OVER (PARTITION BY qid ORDER BY v1 DESC) AS b, MIN(d) OVER (PARTITION BY qid) AS distance FROM tal),
sol AS (SELECT qid, COUNT(*) FILTER (a = 1) > 1 AND COUNT(*) FILTER (b = 1) = 1 AS again, MAX(CASE WHEN b = 1 THEN class END) AS c1, ARG_MIN(class, ROW(a, -n, first)) AS c0, MIN(distance) AS distance FROM top GROUP BY qid)
SELECT s.qid, q.class, CASE WHEN again THEN c1 ELSE c0 END AS predicted, ROUND(distance, 6) + 0.0 AS distance FROM sol s JOIN inst q ON q.iid = s.qid"""


for weighting in ("gr", "sd"):
    add(f"leave_one_out_numeric_{weighting}", _leave_one_out_numeric(weighting), leave_one_out_numeric_sql(weighting))
