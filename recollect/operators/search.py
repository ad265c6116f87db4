"""Nearest-neighbour search over distinct distances: k counts distances, and a bucket has all instances at one distance.

Where features count 0 or their weight, patterns are found by shared values: few features by ``subsets``, more by inverted ``lists``. Otherwise,
beyond PAIRS, patterns are dealt to ``blocks`` that a bound may exclude; below, the search lays a grid over queries and patterns: parts of the queries meet blocks of the patterns, each
meeting is a task's group of bounded size, and only the k + 1 nearest distances of a query leave it, as counts
by class. For the dot product and the cosine ``products`` take the grid's place, and that of blocks whose bounds exclude little. What metrics need of a value (its class distribution, given distances) is joined to the rows first, so
no table of all pairs of values is made. Where rows must agree in some columns (``block``), an equi-join
takes the grid's place and distances are column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.statistics import EPSILON, numeric
from . import blocks, products
from .lists import Lists
from .subsets import MOST, Subsets

#: Patterns of a block and queries of a part (about), and distances held at once.
BLOCK, PART, HELD = 50_000, 4_096, 2_000_000
#: Pairs of queries and patterns beyond which blocks with bounds take the place of the grid.
PAIRS = 2_000_000_000
#: Up to so many classes are counted by a product with a table of patterns and classes.
DENSE = 64
#: Up to so many distances are found by repeated minima, more by sorting.
FEW = 12
#: Distances are equal if they agree to so many decimals.
DECIMALS = 10
INT_MAX = 2147483647.0


@dataclass(frozen=True)
class Feature:
    """How a column enters the distance: its metric's code, weight and numeric range; the class distribution of
    values ``(fval, p, freq)`` and below which frequency it isn't used; distances ``(v, ds)`` that replace computed
    ones; columns of the queries with weights and ranges of their own."""

    name: str
    metric: str = "O"
    weight: float = 1.0
    width: float = 1.0
    probs: DataFrame | None = None
    least: int = 1
    given: DataFrame | None = None
    own_weight: str | None = None
    own_width: str | None = None


def delta(f: Feature, a: Column, b: Column) -> Column:
    """Unweighted distance of two values of a feature, ``q_<name>`` and ``p_<name>`` with what was joined to them."""
    width = F.nullif(F.col(f"q_{f.own_width}"), F.lit(0.0)) if f.own_width else F.lit(f.width)
    if f.metric == "O":
        d = M.overlap(a, b)
    elif f.metric == "N":
        d = M.numeric_distance(a, b, width)
    elif f.metric == "E":
        d = M.euclidean(a, b, width)
    elif f.metric == "DC":
        d = M.dice(a, b)
    elif f.metric == "L":
        d = M.levenshtein(a, b)
    else:
        own = lambda side, what: F.col(f"{side}_{f.name}__{what}")
        both = F.least(F.coalesce(own("q", "n"), F.lit(0)), F.coalesce(own("p", "n"), F.lit(0)))
        d = F.when(both < max(f.least, 1), 1.0).otherwise(M.distribution_distance(own("q", "p"), own("p", "p"), f.metric))
    if f.given is not None:
        d = F.coalesce(F.element_at(F.col(f"q_{f.name}__g"), b), d)
    return F.when(a.eqNullSafe(b), 0.0).otherwise(d)


def distance(features: list[Feature], similarity: str | None = None) -> Column:
    """Distance between ``q_<name>`` and ``p_<name>``, rounded."""
    weight = lambda f: F.col(f"q_{f.own_weight}") if f.own_weight else F.lit(f.weight)
    if similarity:
        x = lambda f: F.coalesce(numeric(F.col(f"q_{f.name}")), F.lit(0.0))
        y = lambda f: F.coalesce(numeric(F.col(f"p_{f.name}")), F.lit(0.0))
        add = lambda g: sum((weight(f) * g(f) for f in features), F.lit(0.0))
        dot = add(lambda f: x(f) * y(f))
        if similarity == "D":
            return F.round((F.lit(INT_MAX) - dot) / INT_MAX, DECIMALS)
        return F.round(1.0 - dot / (F.sqrt(add(lambda f: x(f) * x(f)) * add(lambda f: y(f) * y(f))) + EPSILON), DECIMALS)
    total = F.lit(0.0)
    for f in features:
        total = total + weight(f) * delta(f, F.col(f"q_{f.name}"), F.col(f"p_{f.name}"))
    return F.round(total, DECIMALS)


def base_table(instances: DataFrame, features: list[str], exemplar: bool = False) -> DataFrame:
    """Distinct patterns: features, class, ``cnt`` and the ``first`` key; with exemplar weights the first one of a pattern and class."""
    occ = F.col("occ").cast("long") if "occ" in instances.columns else F.lit(1).cast("long")
    more = [F.min_by("exw", "iid").alias("exw")] if exemplar else []
    return instances.groupBy(*features, "class").agg(F.sum(occ).alias("cnt"), F.min("iid").alias("first"), *more).where("cnt > 0")


def _joined(rows: DataFrame, features: list[Feature], side: str) -> DataFrame:
    """Rows with ``<side>_<name>`` columns, plus what metrics need of their values."""
    for f in features:
        key = f"{side}_{f.name}"
        if f.probs is not None and f"{key}__p" not in rows.columns:
            rows = rows.join(f.probs.select(F.col("fval").alias(key), F.col("p").alias(f"{key}__p"), F.col("freq").alias(f"{key}__n")), key, "left")
        if f.given is not None and side == "q":
            rows = rows.join(f.given.select(F.col("v").alias(key), F.col("ds").alias(f"{key}__g")), key, "left")
    return rows


def sides(queries: DataFrame, base: DataFrame, features: list[Feature], keys: list[str], exemplar: bool, leave_out: bool) -> tuple[DataFrame, DataFrame]:
    names = [f.name for f in features]
    more = [c for f in features for c in (f"{f.name}__p", f"{f.name}__n") if c in queries.columns]
    own = [c for f in features for c in (f.own_weight, f.own_width) if c]
    hidden = [F.col("class").alias("q_class"), (F.col("occ").cast("long") if "occ" in queries.columns else F.lit(1).cast("long")).alias("q_occ")] if leave_out else []
    q = queries.select("qid", *(F.col(n).alias(f"q_{n}") for n in [*names, *more, *own]), *(F.col(c) for c in keys), *hidden)
    p = base.select(*(F.col(n).alias(f"p_{n}") for n in names), *(F.col(c) for c in keys), "class", "cnt", *(["exw"] if exemplar else []))
    return _joined(q, features, "q"), _joined(p, features, "p")


def distances(queries: DataFrame, base: DataFrame, features: list[Feature], k: int, similarity: str | None = None, exemplar: bool = False, block: list[str] | None = None, leave_out: bool = False) -> DataFrame:
    """(qid, d, exact, class, cnt): what the base holds at the k + 1 nearest distances of each query, at least.

    With ``block`` only rows that agree in those columns are neighbours. ``leave_out`` takes the query itself
    out of its own pattern.
    """
    q, p = sides(queries, base, features, block or [], exemplar, leave_out)
    if by_subsets(features, similarity, exemplar) or not block and listed(features, similarity, exemplar):
        return shared(q, p, features, k, leave_out, block).found()
    if not block:
        size = q.count(), p.count()
        blocked = None if exemplar or size[0] * size[1] <= PAIRS else _blocked(p, features, similarity)
        if similarity and not exemplar and (blocked is None or not _excludes(q, p, blocked, features, k, similarity)):
            return _products(q, p, features, k, similarity, leave_out, size)
        if blocked is not None:
            meet = lambda left, right, keys: _meeting(left, right, keys, features, k, similarity, False, leave_out)
            return blocks.found(q, blocked, k, meet, BLOCK, PART)
        return _grid(q, p, features, k, similarity, exemplar, leave_out, size=size)
    exact = identical(features)
    d = distance(features, similarity)
    if exemplar:
        d = F.round(d / (F.col("exw") + EPSILON), DECIMALS)
    pairs = p.join(q, block).withColumn("d", d).withColumn("exact", exact)
    if leave_out:
        pairs = pairs.withColumn("cnt", F.col("cnt") - F.when(F.col("exact") & (F.col("class") == F.col("q_class")), F.col("q_occ")).otherwise(0)).where("cnt > 0")
    return pairs.groupBy("qid", "d", "exact", "class").agg(F.sum("cnt").alias("cnt"))


def identical(features: list[Feature]) -> Column:
    exact = F.lit(True)
    for f in features:
        exact = exact & F.col(f"q_{f.name}").eqNullSafe(F.col(f"p_{f.name}"))
    return exact


def _blocked(p: DataFrame, features: list[Feature], similarity: str | None) -> blocks.Dealt | None:
    """Blocks that queries can leave out; none if no feature gives a bound."""
    names, weights = [f.name for f in features], [float(f.weight) for f in features]
    if similarity:
        return blocks.by_norm(p, names, weights, INT_MAX) if similarity == "D" else blocks.by_angle(p, names, weights)
    leading = max((f for f in features if f.given is None), key=lambda f: f.weight, default=None)
    if leading is None:
        return None
    plain = _plain(leading)

    def distance(left: pa.Table, right: pa.Table) -> np.ndarray:
        return _feature_distance(plain, left, right, _coded(_column(left, f"q_{plain.name}"), _column(right, f"p_{plain.name}")), False)(slice(0, left.num_rows)).astype(float)

    def weight(left: pa.Table) -> np.ndarray:
        return _column(left, f"q_{plain.own_weight}").to_numpy(zero_copy_only=False) if plain.own_weight else np.full(left.num_rows, plain.weight)

    def width(left: pa.Table) -> np.ndarray:
        own = _column(left, f"q_{plain.own_width}").to_numpy(zero_copy_only=False).astype(float) if plain.own_width else np.full(left.num_rows, plain.width)
        return np.where(own < EPSILON, np.nan, own)

    if plain.metric in ("N", "E"):
        return blocks.by_range(p, plain.name, plain.metric == "E", weight, width)
    return blocks.by_value(p, plain.name, distance, weight)


def matches(queries: DataFrame, base: DataFrame, names: list[str]) -> DataFrame:
    """The patterns that equal a query, as its only bucket: (qid, r, d, class, cnt, exact)."""
    found = queries.select("qid", *names).join(base.select(*names, "class", "cnt"), names)
    return found.select("qid", F.lit(1).alias("r"), F.lit(0.0).alias("d"), "class", "cnt", F.lit(True).alias("exact"))


def folded(queries: DataFrame, held: DataFrame, features: list[Feature], k: int) -> DataFrame:
    """As ``distances`` for queries with a ``fold``, among the patterns ``held(.., class, cnt, fold)`` of the other folds; in one search, by subsets."""
    q, p = sides(queries, held, features, ["fold"], False, False)
    weights = [F.col(f"q_{f.own_weight}") if f.own_weight else F.lit(float(f.weight)) for f in features]
    return Subsets(q, p, [f.name for f in features], weights, k, held=p).found()


def by_subsets(features: list[Feature], similarity: str | None, exemplar: bool) -> bool:
    """Whether the search looks up subsets of values, identical patterns among them."""
    return listed(features, similarity, exemplar) and len(features) <= MOST


def listed(features: list[Feature], similarity: str | None, exemplar: bool) -> bool:
    """Whether distances are sums of the weights of different values."""
    return not similarity and not exemplar and all(f.metric == "O" and f.given is None for f in features) and bool(features)


def shared(q: DataFrame, p: DataFrame, features: list[Feature], k: int, leave_out: bool = False, keys: list[str] | None = None) -> Lists | Subsets:
    """The search by shared values, for ``sides``."""
    weights = [F.col(f"q_{f.own_weight}") if f.own_weight else F.lit(float(f.weight)) for f in features]
    names = [f.name for f in features]
    if len(features) <= MOST:
        return Subsets(q, p, names, weights, k, leave_out, keys)
    return Lists(q, p, names, weights, distance(features), identical(features), k, leave_out)


def examples(queries: DataFrame, base: DataFrame, features: list[Feature], k: int, most: int, similarity: str | None = None, exemplar: bool = False) -> DataFrame:
    """(qid, k, distance, place, pattern, class, cnt): the patterns at the k nearest distances, ``most`` of a distance at most, in the order of their values."""
    q, p = sides(queries, base, features, [], exemplar, False)
    found = _grid(q, p, features, k, similarity, exemplar, False, most)
    by = Window.partitionBy("qid")
    ranked = found.withColumn("k", F.dense_rank().over(by.orderBy("d")).cast("long")).withColumn("place", F.row_number().over(Window.partitionBy("qid", "d").orderBy("pattern", "class")).cast("long"))
    return ranked.where((F.col("k") <= k) & (F.col("place") <= most)).select("qid", "k", F.col("d").alias("distance"), "place", "pattern", "class", "cnt")


def _grid(q: DataFrame, p: DataFrame, features: list[Feature], k: int, similarity: str | None, exemplar: bool, leave_out: bool, shown: int = 0, size: tuple[int, int] | None = None) -> DataFrame:
    tasks = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, m = size or (q.count(), p.count())
    pieces = max(1, -(-m // BLOCK))
    parts = max(1, -(-n // PART), min(2 * tasks, n // 256))
    q = q.withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    p = p.withColumn("block", F.pmod(F.xxhash64(*(f"p_{f.name}" for f in features), "class"), F.lit(pieces)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return _meeting(q, p, ["part", "block"], features, k, similarity, exemplar, leave_out, shown)


def _vectors(features: list[Feature], side: str) -> Callable[[pa.Table], np.ndarray]:
    """The numbers of a table's rows; what spells none counts 0."""
    names = [f"{side}_{f.name}" for f in features]

    def numbers(table: pa.Table) -> np.ndarray:
        coded = [_column(table, n).cast(pa.string()).dictionary_encode(null_encoding="encode") for n in names]
        return np.nan_to_num(np.column_stack([_numbers(x.dictionary.to_pylist(), x.indices.to_numpy(zero_copy_only=False)) for x in coded]))

    return numbers


def _similarity(x: np.ndarray, y: np.ndarray, w: np.ndarray, similarity: str) -> np.ndarray:
    dot = (x * w) @ y.T
    if similarity == "D":
        return np.round((INT_MAX - dot) / INT_MAX, DECIMALS)
    return np.round(1.0 - dot / (np.sqrt(((x * x) @ w)[:, None] * ((y * y) @ w)[None, :]) + EPSILON), DECIMALS)


def _excludes(q: DataFrame, p: DataFrame, dealt: blocks.Dealt, features: list[Feature], k: int, similarity: str) -> bool:
    """Whether bounds leave out half of the blocks, as some queries and patterns tell; it chooses between two exact searches."""
    names = [f.name for f in features]
    some = [pa.Table.from_pylist([r.asDict() for r in df.select(*(f"{side}_{n}" for n in names)).limit(n_rows).collect()], pa.schema([(f"{side}_{n}", pa.string()) for n in names])) for df, side, n_rows in ((q, "q", 64), (p, "p", 2_048))]
    if not all(x.num_rows for x in some):
        return True
    x, y = (_vectors(features, side)(t) for side, t in zip("qp", some, strict=True))
    limit = _nearest(_similarity(x, y, np.array([f.weight for f in features]), similarity), k + 1)
    return float((dealt.bound(some[0]) <= limit[:, None] + blocks.MARGIN).mean()) <= 0.5


def _products(q: DataFrame, p: DataFrame, features: list[Feature], k: int, similarity: str, leave_out: bool, size: tuple[int, int]) -> DataFrame:
    """All pairs of queries and patterns, as vectors."""
    features = [_plain(f) for f in features]
    w = np.array([f.weight for f in features])
    schema = pa.schema([("qid", pa.null()), ("d", pa.float64()), ("exact", pa.bool_()), ("class", pa.string()), ("cnt", pa.int64())])

    def summed(x: np.ndarray, y: np.ndarray, left: dict, right: dict) -> Iterator[pa.Table]:
        coded = right["class"].dictionary_encode()
        label, classes, count = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, right["cnt"].to_numpy(zero_copy_only=False)
        same, other = products.equal(left["digest"], right["digest"])
        taken = np.zeros(len(same), dtype=np.int64)
        if leave_out:
            mine = pc.index_in(left["q_class"], classes).fill_null(-1).to_numpy(zero_copy_only=False)
            taken = np.where(label[other] == mine[same], left["q_occ"].to_numpy(zero_copy_only=False)[same], 0)
        types = schema.set(0, pa.field("qid", left["qid"].type))
        by_class = np.zeros((len(y), len(classes) if len(classes) <= DENSE else 0))
        if by_class.size:
            by_class[np.arange(len(y)), label] = count
        step = max(1, HELD // len(y))
        for at in range(0, len(x), step):
            s = slice(at, min(len(x), at + step))
            d = _similarity(x[s], y, w, similarity)
            here = (same >= s.start) & (same < s.stop)
            i, j, less = same[here] - s.start, other[here], taken[here]
            d[i[count[j] <= less], j[count[j] <= less]] = np.inf
            level = d.min(axis=1)
            for _ in range(k + 1):
                equal = d == level[:, None]
                if by_class.size:
                    total = np.rint(equal.astype(float) @ by_class).astype(np.int64)
                else:
                    r, c = np.nonzero(equal)
                    total = np.rint(np.bincount(r * len(classes) + label[c], count[c], len(d) * len(classes))).astype(np.int64).reshape(len(d), -1)
                exact, own = np.zeros_like(total), equal[i, j]
                np.add.at(total, (i[own], label[j[own]]), -count[j[own]])
                np.add.at(exact, (i[own], label[j[own]]), count[j[own]] - less[own])
                for is_exact, n in ((False, total), (True, exact)):
                    r, c = np.nonzero((n > 0) & np.isfinite(level)[:, None])
                    qid = left["qid"].take(pa.array(r + s.start))
                    yield pa.Table.from_arrays([qid, pa.array(level[r]), pa.array(np.full(len(r), is_exact)), classes.take(pa.array(c)), pa.array(n[r, c], pa.int64())], schema=types)
                level = np.where(d > level[:, None], d, np.inf).min(axis=1)

    return products.found(q, p, [f.name for f in features], lambda side: _vectors(features, side), summed, size, ["q_class", "q_occ"] if leave_out else [])


def _plain(f: Feature) -> Feature:
    """Without its frames, which don't travel to tasks."""
    return replace(f, probs=None, given=None)


def _meeting(q: DataFrame, p: DataFrame, keys: list[str], features: list[Feature], k: int, similarity: str | None, exemplar: bool, leave_out: bool, shown: int = 0) -> DataFrame:
    """What queries and patterns with the same ``keys`` are to one another, a task's group for each."""
    plain = [_plain(f) for f in features]
    given = {f.name for f in features if f.given is not None}

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return _met(left, right, plain, given, k, similarity, exemplar, leave_out, shown)

    qid = q.schema["qid"].dataType.simpleString()
    if shown:
        return q.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInArrow(meet, f"qid {qid}, d double, class string, pattern string, cnt long")
    met = q.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInArrow(meet, f"qid {qid}, d double, exact boolean, class string, cnt long")
    return met.groupBy("qid", "d", "exact", "class").agg(F.sum("cnt").alias("cnt"))


# -- one meeting of queries and patterns, in NumPy -----------------------------------------------------------------


def _column(table: pa.Table, name: str) -> pa.Array:
    c = table.column(name).combine_chunks()
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def _coded(q: pa.Array, p: pa.Array) -> tuple[np.ndarray, np.ndarray, list, list, np.ndarray, np.ndarray]:
    """Codes of values on both sides (equal values have equal codes, those the patterns lack are negative), the values, and codes within the queries."""
    q, p = q.cast(pa.string()).dictionary_encode(null_encoding="encode"), p.cast(pa.string()).dictionary_encode(null_encoding="encode")
    at = pc.index_in(q.dictionary, p.dictionary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
    own = q.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    there = p.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    return at[own] if len(at) else own, there, q.dictionary.to_pylist(), p.dictionary.to_pylist(), own, at


def _numbers(values: list, codes: np.ndarray) -> np.ndarray:
    def number(x: str | None) -> float:
        try:
            return float(x) if x is not None and "_" not in x else np.nan
        except ValueError:
            return np.nan

    return np.array([number(v) for v in values] or [np.nan])[codes]


def _distributions(column: pa.Array, freq: pa.Array, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Class distribution and frequency of each value; zeros for one unknown in training."""
    _, first = np.unique(codes, return_index=True)
    rows = column.take(pa.array(first)).to_pylist()
    width = max((len(r) for r in rows if r is not None), default=0)
    out = np.zeros((n, width))
    for i, r in enumerate(rows):
        if r is not None:
            out[i] = r
    return out, np.nan_to_num(freq.take(pa.array(first)).to_numpy(zero_copy_only=False).astype(float))


def _value_distances(f: Feature, left: pa.Table, right: pa.Table, codes: tuple, given: bool) -> np.ndarray:
    """Distances of all values of the queries and of the patterns in this meeting."""
    _, there, asked, known, own, at = codes
    if f.metric in ("M", "J", "S"):
        x, nx = _distributions(_column(left, f"q_{f.name}__p"), _column(left, f"q_{f.name}__n"), own, len(asked))
        y, ny = _distributions(_column(right, f"p_{f.name}__p"), _column(right, f"p_{f.name}__n"), there, len(known))
        d = M.distribution_distances(x, y, f.metric)
        d[np.minimum(nx[:, None], ny[None, :]) < max(f.least, 1)] = 1.0
    elif f.metric in ("L", "DC"):
        one = M.edits if f.metric == "L" else M.letter_distance
        d = np.array([[float(one(a, b)) for b in known] for a in asked]).reshape(len(asked), len(known))
    else:
        d = np.ones((len(asked), len(known)))
    if given:
        place = {v: j for j, v in enumerate(known)}
        _, first = np.unique(own, return_index=True)
        for i, pairs in enumerate(_column(left, f"q_{f.name}__g").take(pa.array(first)).to_pylist()):
            for v, x in pairs or ():
                if v in place:
                    d[i, place[v]] = x
    same = np.flatnonzero(at >= 0)
    d[same, at[same]] = 0.0
    return d


def _feature_distance(f: Feature, left: pa.Table, right: pa.Table, codes: tuple, given: bool) -> Callable[[slice], np.ndarray]:
    """Distances of a run of queries to all patterns, in one feature."""
    asked, there, values, known, own, _ = codes
    if f.metric == "O" and not given:
        return lambda s: asked[s, None] != there[None, :]
    if f.metric in ("N", "E") and not given:
        x, y = _numbers(values, own), _numbers(known, there)
        width = np.full(left.num_rows, f.width) if f.own_width is None else _column(left, f"q_{f.own_width}").to_numpy(zero_copy_only=False).astype(float)
        width = np.where(width < EPSILON, np.nan, width)[:, None]  # without a range, different values are at distance 1

        def numbers(s: slice) -> np.ndarray:
            d = np.abs(x[s, None] - y[None, :]) if f.metric == "N" else np.sqrt(np.abs((x * x)[s, None] - (y * y)[None, :]))
            return np.where(asked[s, None] == there[None, :], 0.0, np.nan_to_num(d / width[s], nan=1.0))

        return numbers
    table = _value_distances(f, left, right, codes, given)
    return lambda s: table[own[s]][:, there]


def _nearest(d: np.ndarray, k: int) -> np.ndarray:
    """For each row the k-th smallest different value, or the largest if there are fewer."""
    if k <= FEW:
        limit = d.min(axis=1)
        for _ in range(k - 1):
            above = np.where(d > limit[:, None], d, np.inf).min(axis=1)
            limit = np.where(np.isinf(above), limit, above)
        return limit
    out = np.empty(len(d))
    for i, row in enumerate(d):
        values = np.unique(row[np.isfinite(row)])
        out[i] = values[min(k, len(values)) - 1] if len(values) else np.inf
    return out


def _met(left: pa.Table, right: pa.Table, features: list[Feature], given: set[str], k: int, similarity: str | None, exemplar: bool, leave_out: bool, shown: int = 0) -> pa.Table:
    middle = [("class", pa.string()), ("pattern", pa.string())] if shown else [("exact", pa.bool_()), ("class", pa.string())]
    schema = pa.schema([("qid", left.schema.field("qid").type), ("d", pa.float64()), *middle, ("cnt", pa.int64())])
    n, m = left.num_rows, right.num_rows
    if not n or not m:
        return schema.empty_table()
    codes = {f.name: _coded(_column(left, f"q_{f.name}"), _column(right, f"p_{f.name}")) for f in features}
    label, classes = (x := _column(right, "class").dictionary_encode()).indices.to_numpy(zero_copy_only=False), x.dictionary
    count = _column(right, "cnt").to_numpy(zero_copy_only=False)
    divisor = _column(right, "exw").to_numpy(zero_copy_only=False) + EPSILON if exemplar else None
    weights = [_column(left, f"q_{f.own_weight}").to_numpy(zero_copy_only=False)[:, None] if f.own_weight else np.full((n, 1), f.weight) for f in features]
    if leave_out:
        mine = pc.index_in(_column(left, "q_class"), classes).fill_null(-1).to_numpy(zero_copy_only=False)
        times = _column(left, "q_occ").to_numpy(zero_copy_only=False)
    if similarity:
        x, y = (np.nan_to_num(np.column_stack([_numbers(codes[f.name][2 + side], codes[f.name][4 if side == 0 else 1]) for f in features])) for side in (0, 1))
        w = np.array([f.weight for f in features])
    else:
        one = [_feature_distance(f, left, right, codes[f.name], f.name in given) for f in features]
    step, parts = max(1, HELD // m), []
    if shown:
        pattern = np.array([" ".join(v) for v in zip(*(_column(right, f"p_{f.name}").cast(pa.string()).to_pylist() for f in features), strict=True)])
        names = np.array(classes.to_pylist())[label]
    for at in range(0, n, step):
        s = slice(at, min(n, at + step))
        if similarity:
            d = _similarity(x[s], y, w, similarity)
        else:
            d = np.zeros((s.stop - s.start, m))
            for weight, f in zip(weights, one, strict=True):
                d += weight[s] * f(s)
        d = np.round(d, DECIMALS)
        if exemplar:
            d = np.round(d / divisor[None, :], DECIMALS)
        if leave_out:
            same = label[None, :] == mine[s, None]
            for f in features:
                same &= codes[f.name][0][s, None] == codes[f.name][1][None, :]
            d[same & (count[None, :] <= times[s, None])] = np.inf
        i, j = np.nonzero((d <= _nearest(d, k + 1 - bool(shown))[:, None]) & np.isfinite(d))
        if shown:
            order = np.lexsort((names[j], pattern[j], d[i, j], i))
            i, j = i[order], j[order]
            start = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1]) | (d[i, j][1:] != d[i, j][:-1]))))
            keep = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i)))) < shown
            i, j = i[keep], j[keep]
            qid = _column(left, "qid").slice(s.start, s.stop - s.start).take(pa.array(i))
            parts.append(pa.Table.from_arrays([qid, pa.array(d[i, j]), classes.take(pa.array(label[j])), pa.array(pattern[j].tolist(), pa.string()), pa.array(count[j], pa.int64())], schema=schema))
            continue
        exact = np.ones(len(i), dtype=bool)
        for f in features:
            exact &= codes[f.name][0][s][i] == codes[f.name][1][j]
        own = count[j] - (np.where(same[i, j], times[s][i], 0) if leave_out else 0)
        parts.append(_summed(_column(left, "qid").slice(s.start, s.stop - s.start), i, d[i, j], exact, label[j], own, classes, schema))
    return pa.concat_tables(parts)


def _summed(qid: pa.Array, i: np.ndarray, d: np.ndarray, exact: np.ndarray, label: np.ndarray, count: np.ndarray, classes: pa.Array, schema: pa.Schema) -> pa.Table:
    order = np.lexsort((label, exact, d, i))
    i, d, exact, label, count = i[order], d[order], exact[order], label[order], count[order]
    new = np.ones(len(i), dtype=bool)
    if len(i):
        new[1:] = (i[1:] != i[:-1]) | (d[1:] != d[:-1]) | (exact[1:] != exact[:-1]) | (label[1:] != label[:-1])
    start = np.flatnonzero(new)
    total = np.add.reduceat(count, start) if len(start) else count
    return pa.Table.from_arrays([qid.take(pa.array(i[start])), pa.array(d[start]), pa.array(exact[start]), classes.take(pa.array(label[start])), pa.array(total, pa.int64())], schema=schema)


# -- buckets -------------------------------------------------------------------------------------------------------


def buckets(found: DataFrame, k: int, shortcut: bool = False) -> DataFrame:
    """The k + 1 nearest distances: (qid, r, d, class, cnt). With the shortcut an identical pattern alone is the first bucket."""
    ranked = found.withColumn("r", F.dense_rank().over(Window.partitionBy("qid").orderBy("d"))).where(F.col("r") <= k + 1)
    if shortcut:
        ranked = ranked.withColumn("hit", F.max("exact").over(Window.partitionBy("qid"))).where("not hit or r > 1 or exact")
    return ranked.groupBy("qid", "r", "d", "class").agg(F.sum("cnt").alias("cnt"), F.max("exact").alias("exact"))


def buckets_each(found: DataFrame, settings: list[dict], k: int) -> DataFrame:
    """Buckets of several settings from one search for the k + 1 nearest distances: ``qid`` is (setting, qid), and each row has its setting's values.

    ``settings`` have k, and ``first`` (with the shortcut) or ``only`` (an identical pattern is the whole answer).
    """
    by = Window.partitionBy("qid")
    ranked = found.withColumn("r", F.dense_rank().over(by.orderBy("d"))).where(F.col("r") <= k + 1).withColumn("hit", F.max("exact").over(by))
    each = F.array(*(F.struct(F.lit(n).cast("long").alias("setting"), *(F.lit(v).alias(name) for name, v in s.items())) for n, s in enumerate(settings)))
    # A setting leaves rows out before they are multiplied.
    own = F.filter(each, lambda s: (F.col("r") <= s["k"] + 1) & (~F.col("hit") | F.col("exact") | ~s["only"] & (~s["first"] | (F.col("r") > 1))))
    names = list(settings[0])
    rows = ranked.withColumn("s", F.explode(own)).select(F.struct("s.setting", "qid").alias("qid"), "r", "d", "class", "cnt", "exact", *(f"s.{n}" for n in names))
    return rows.groupBy("qid", "r", "d", "class", *names).agg(F.sum("cnt").alias("cnt"), F.max("exact").alias("exact"))


def neighbours(found: DataFrame, k: int) -> DataFrame:
    """The k nearest buckets as rows: (qid, k, distance, class, cnt)."""
    return buckets(found, k).where(F.col("r") <= k).select("qid", F.col("r").cast("long").alias("k"), F.col("d").alias("distance"), "class", "cnt")


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two neighbour tables together: equal distances add up, buckets are numbered anew."""
    both = a.unionByName(b).groupBy("qid", "distance", "class").agg(F.sum("cnt").alias("cnt"))
    return both.select("qid", F.dense_rank().over(Window.partitionBy("qid").orderBy("distance")).cast("long").alias("k"), "distance", "class", "cnt")


def truncated(found: DataFrame, n: int) -> DataFrame:
    return found.where(F.col("k") <= n)
