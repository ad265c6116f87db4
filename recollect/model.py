"""The learner: fitted statistics and a table of patterns, and the plans that classify with them."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import metrics as M
from .functions import statistics as S
from .operators import edit, evaluate, search, tree, versions, vote
from .options import NUMERICAL, STORABLE, Options
from .storage import cut


@dataclass(frozen=True)
class Fitted:
    """What is known after fitting; the measures are a few numbers a feature, on the driver, and taken when first asked for. ``keys`` has the patterns by key
    (``versions``), where instances don't."""

    features: list[str]
    instances: DataFrame
    base: DataFrame
    classes: DataFrame
    table: DataFrame
    known: Callable[[], tuple[dict[int, dict[str, float]], list[int]]]
    metrics: list[str]
    weights: list[float]
    keys: DataFrame | None = None

    @property
    def measures(self) -> dict[int, dict[str, float]]:
        return self.known()[0]

    @property
    def order(self) -> list[int]:
        return self.known()[1]


class MemoryBasedLearner:
    """k-nearest-neighbour classification over distinct distances, trees, hybrids and edited bases.

    ``fit`` takes rows with an order key ``iid``, string features and ``class`` (optionally ``occ``, a count,
    and ``exw``, an exemplar weight); ``transform`` takes rows with ``qid`` and the same features. A missing value
    is a symbol of its own, equal to itself; rows without a class aren't learned from.
    """

    def __init__(self, options: Options | None = None, **settings):
        self.options = (options or Options()).but(**settings) if settings else options or Options()
        self.fitted: Fitted | None = None
        self._grown: tuple | None = None
        self.given_probs: DataFrame | None = None
        self.given_pairs: DataFrame | None = None

    # -- fitting -----------------------------------------------------------------------------------------------

    def fit(self, instances: DataFrame, features: list[str]) -> MemoryBasedLearner:
        o = self.options
        if len(features) > o.max_features:
            raise ValueError(f"more than {o.max_features} features")
        used = [(f, m) for i, f in enumerate(features, 1) if (m := o.metric_of(i)) != "I"]
        features, kinds = [f for f, _ in used], [m for _, m in used]
        names = ["iid", *features, "class", *(c for c in ("occ", "exw") if c in instances.columns)]
        rows = instances.where("class is not null").select("iid", *S.symbols(instances, features), F.col("class").cast("string").alias("class"), *names[2 + len(features) :])
        learned = edit.seeded(rows, o.ib2_seed, features) if o.algorithm == "IB2" else rows
        # Small beside the rows: a cell for each value and class, and a row for each class.
        table, classes = S.contingency(rows, features).persist(), S.class_table(rows).persist()
        base = search.base_table(learned, features, exemplar="exw" in learned.columns).persist()
        self._assembled(features, kinds, learned, base, table, classes)
        if o.algorithm == "IB2":
            f = self._known()
            edited = edit.ib2(rows, features, f.weights, classes, o.ib2_seed)
            self.fitted = replace(f, instances=edited, base=search.base_table(edited, features).persist())
        return self

    def learn(self, patterns: DataFrame, cells: DataFrame, features: list[str], keys: DataFrame | None = None) -> MemoryBasedLearner:
        """Fit from tables that are maintained (``versions``): ``patterns(features, class, cnt, first)`` and ``cells(fidx, fval, class, cnt)``; rows aren't read.

        ``keys`` has the patterns by key; ``partial_fit`` needs it to know what comes first once a first row is taken away.
        """
        o = self.options
        if o.algorithm == "IB2":
            raise ValueError("an edited base needs its rows in order")
        used = [(i, f, m) for i, f in enumerate(features, 1) if (m := o.metric_of(i)) != "I"]
        names = [f for _, f, _ in used]
        if len(used) < len(features):
            patterns = versions.added(patterns, names)
            place = F.create_map(*(F.lit(x) for k, (i, _, _) in enumerate(used, 1) for x in (i, k)))
            cells = cells.where(F.col("fidx").isin([i for i, _, _ in used])).withColumn("fidx", place[F.col("fidx").cast("int")].cast("long"))
        base, table = patterns.persist(), cells.persist()
        classes = S.class_table(base.select(F.col("first").alias("iid"), "class", F.col("cnt").alias("occ"))).persist()
        rows = base.select(F.col("first").alias("iid"), *names, "class", F.col("cnt").alias("occ"))
        self._assembled(names, [m for _, _, m in used], rows, base, table, classes)
        self.fitted = replace(self.fitted, keys=keys)
        return self

    def release(self) -> None:
        """Drop what the learner keeps in memory."""
        for df in (self.fitted.base, self.fitted.table, self.fitted.classes, *([self._grown[1]] if self._grown else [])) if self.fitted else ():
            df.unpersist()

    def _assembled(self, features: list[str], kinds: list[str], learned: DataFrame, base: DataFrame, table: DataFrame, classes: DataFrame) -> None:
        """The learner from its tables: patterns, cells and classes; rows aren't read."""
        o = self.options
        similar = o.global_metric in ("C", "D")
        statistics = cache(lambda: self._statistics(table, features, kinds))

        def known() -> tuple[dict[int, dict[str, float]], list[int]]:
            measures, ranges = statistics()
            order = S.tree_order(measures, o.tree_order or ("G/V" if o.algorithm in ("IB1", "IB2") else {"gr": "GRO", "ig": "IGO", "x2": "X2O", "sv": "SVO", "sd": "SDO"}.get(o.weighting, "DO")))
            return {i: measures[i] | ranges[i] for i in measures}, order

        # Similarities with given weights need no cells, which are as many as all values of all vectors.
        weights = self._weights({} if similar and o.weighting in ("nw", "user") else statistics()[0], len(features))
        metrics = kinds if similar else [("O" if m in NUMERICAL and (statistics()[1][i]["n_bad"] or statistics()[1][i]["width"] < S.EPSILON) else m) for i, m in enumerate(kinds, 1)]
        self.fitted = Fitted(features, learned, base, classes, table, cache(known), metrics, weights)

    def _statistics(self, table: DataFrame, features: list[str], kinds: list[str]):
        numeric = [i for i, m in enumerate(kinds, 1) if m in NUMERICAL]
        ranges = {i: {"n_bad": 0, "width": 0.0, "sd": 0.0} for i in range(1, len(features) + 1)}
        if numeric or self.options.weighting == "sd" or (self.options.tree_order or "").startswith("SD"):
            for r in S.value_range(table.where("cnt > 0")).collect():
                ranges[r["fidx"]] = {"n_bad": r["n_bad"], "width": (r["n_max"] - r["n_min"]) if r["n_max"] is not None else 0.0, "sd": r["sd"] or 0.0}
        good = [i for i in numeric if not ranges[i]["n_bad"] and ranges[i]["width"] >= S.EPSILON]
        symbolic = table.where(~F.col("fidx").isin(good)) if good else table
        measured = S.weights(symbolic)
        if good:
            measured = measured.unionByName(S.weights(S.binned(table.where(F.col("fidx").isin(good)), self.options.bins), clamp=False))
        measures = {r["fidx"]: {k: float(r[k]) for k in ("n_vals", "ig", "si", "gr", "x2", "sv")} | {"sd": ranges[r["fidx"]]["sd"]} for r in measured.collect()}
        return measures, ranges

    def _weights(self, measures: dict[int, dict[str, float]], n: int) -> list[float]:
        o = self.options
        if o.weighting == "nw":
            out = [1.0] * n
        elif o.weighting == "user":
            out = [float(o.weights[str(i)]) if str(i) in o.weights else float(o.weights[i]) for i in range(1, n + 1)]
        else:
            out = [measures[i][o.weighting] for i in range(1, n + 1)]
        if o.diversify and out:
            least = min(out)
            out = [w - least + S.EPSILON for w in out]
        return out

    def _known(self) -> Fitted:
        if self.fitted is None:
            raise ValueError("the learner isn't fitted")
        return self.fitted

    def plan(self) -> list[search.Feature]:
        """Features as they enter the distance, with what their metric needs of a value."""
        f, packed = self._known(), None
        given = self._given()
        out = []
        for i, (name, metric, weight) in enumerate(zip(f.features, f.metrics, f.weights, strict=True), 1):
            probs = None
            if metric in ("M", "J", "S"):
                if packed is None:
                    packed = M.packed(self.given_probs if self.given_probs is not None else S.value_probs(f.table), f.classes).persist()
                probs = packed.where(F.col("fidx") == i).select("fval", "p", "freq")
            own = given.where(F.col("fidx") == i).select("v", "ds") if given is not None and metric in STORABLE else None
            width = 1.0 if self.similarity else f.measures[i]["width"] or 1.0
            out.append(search.Feature(name, metric, weight, width, probs, self.options.clip, own))
        return out

    def _given(self) -> DataFrame | None:
        """(fidx, v, ds): the given distances of a value as a map; values that are rare in training keep the computed ones."""
        if self.given_pairs is None:
            return None
        f, often = self._known(), None
        for i, m in f.measures.items():
            rows = f.table.where(F.col("fidx") == i).groupBy("fidx", "fval").agg(F.sum("cnt").alias("n")).where(F.col("n") >= round(self.options.matrix_clip * math.log(max(m["n_vals"], 1))))
            often = rows if often is None else often.union(rows)
        pairs = self.given_pairs
        for end in ("v", "w"):
            pairs = pairs.join(often.select("fidx", F.col("fval").alias(end)), ["fidx", end], "left_semi")
        return pairs.groupBy("fidx", "v").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("w", "d")))).alias("ds"))

    def _asked(self, queries: DataFrame) -> DataFrame:
        """Queries with their values as symbols."""
        names = self._known().features
        return queries.select(*(c for c in queries.columns if c not in names), *S.symbols(queries, names))

    @property
    def similarity(self) -> str | None:
        m = self.options.global_metric
        return m if m in ("C", "D") else None

    # -- classification ----------------------------------------------------------------------------------------

    def found(self, queries: DataFrame, k: int | None = None, base: DataFrame | None = None, block: list[str] | None = None, leave_out: bool = False) -> DataFrame:
        f = self._known()
        return search.distances(self._asked(queries), f.base if base is None else base, self.plan(), k or self.options.k, self.similarity, "exw" in f.base.columns, block, leave_out)

    def transform(self, queries: DataFrame) -> DataFrame:
        """(qid, predicted, distance, tie, exact, votes), or (qid, predicted, distance, depth, leaf) from a tree."""
        o, f = self.options, self._known()
        if o.algorithm == "IGTREE":
            return self.descend(queries)
        if o.algorithm in ("TRIBL", "TRIBL2"):
            return self._hybrid(queries)
        if self._shortcut() and (o.exact == "on" or not search.by_subsets(self.plan(), self.similarity, "exw" in f.base.columns)):
            return self._exact_first(queries)
        near = search.buckets(self.found(queries), o.k, self._shortcut())
        return vote.answers(near, f.classes, o.k, o.decay, o.decay_a, o.decay_b, seed=o.random_seed)

    def _exact_first(self, queries: DataFrame) -> DataFrame:
        """Queries that the base has are answered by their own pattern, from an equi-join; only the others are searched.

        Asked for by ``exact="on"`` such an answer is final; else a tie looks for the next distance.
        """
        o, f = self.options, self._known()
        first = vote.answers(search.matches(self._asked(queries), f.base, f.features), f.classes, 1, retry=False, seed=o.random_seed)
        done = first if o.exact == "on" else first.where("NOT tie")
        rest = queries.join(done.select("qid"), "qid", "left_anti")
        near = search.buckets(self.found(rest), o.k, True)
        return done.unionByName(vote.answers(near, f.classes, o.k, o.decay, o.decay_a, o.decay_b, seed=o.random_seed))

    def _shortcut(self) -> bool:
        o = self.options
        return self.similarity is None and (o.exact == "on" or (o.exact == "reference" and o.k == 1))

    def _ordered(self) -> tuple[list[str], list[float]]:
        f = self._known()
        return [f.features[i - 1] for i in f.order], [f.weights[i - 1] for i in f.order]

    def tree(self) -> DataFrame:
        """The tree of all patterns, kept as long as the learner is."""
        order, f = self._ordered()[0], self._known()
        key = (id(f), tuple(order))
        if self._grown is None or self._grown[0] != key:
            self._grown = key, tree.nodes(f.base, order, f.classes).persist()
        return self._grown[1]

    def pruned(self) -> DataFrame:
        """The tree that answers: without nodes that say what their parent says."""
        return tree.pruned(self.tree())

    def descend(self, queries: DataFrame) -> DataFrame:
        order, weights = self._ordered()
        return tree.descend(self._asked(queries), self.pruned(), order, weights)

    def to_tree(self) -> MemoryBasedLearner:
        """A decision tree made of this learner's patterns, weights and order."""
        f = self._known()
        out = MemoryBasedLearner(self.options.but(algorithm="IGTREE", k=1, decay="Z", metric="O", exact="reference", ib2_seed=0, tribl_offset=0))
        out.fitted = replace(f, metrics=["O"] * len(f.features))
        return out

    def _hybrid(self, queries: DataFrame) -> DataFrame:
        """TRIBL: neighbours among patterns that share a fixed number of values; TRIBL2: as many as the base has. Exact matches first."""
        o, f = self.options, self._known()
        order, _ = self._ordered()
        queries = self._asked(queries)
        if o.algorithm == "TRIBL":
            asked = tree.blocked(queries, order, o.tribl_offset).withColumn("depth", F.lit(o.tribl_offset))
            base = tree.blocked(f.base, order, o.tribl_offset).withColumn("depth", F.lit(o.tribl_offset))
        else:
            steps = queries.select("qid", tree.prefixes(order).alias("x"))
            have = f.base.select(tree.prefixes(order).alias("x")).select("x.depth", "x.key").distinct()
            deepest = steps.select("qid", "x.depth", "x.key").join(have, ["depth", "key"]).groupBy("qid").agg(F.max(F.struct("depth", "key")).alias("y")).select("qid", "y.depth", F.col("y.key").alias("block"))
            asked = queries.join(deepest, "qid")
            base = f.base.select("*", tree.prefixes(order).alias("x")).select(*f.base.columns, "x.depth", F.col("x.key").alias("block"))
        pairs = self.found(asked, base=base, block=["depth", "block"])
        # An exact match is the only bucket of its query, so a tie in it has nothing to look further at.
        own = pairs.withColumn("hit", F.max("exact").over(Window.partitionBy("qid"))).where("NOT hit OR exact").drop("hit")
        out = vote.answers(search.buckets(own, o.k), f.classes, o.k, o.decay, o.decay_a, o.decay_b)
        if o.algorithm == "TRIBL":
            walked = tree.descend(queries, self.tree(), order, self._ordered()[1]).select("qid", F.col("predicted").alias("w"), F.col("distance").alias("far"))
            either = walked.join(out, "qid", "left")
            out = either.select("qid", F.coalesce("predicted", "w").alias("predicted"), F.coalesce("distance", "far").alias("distance"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("tie", "exact")), "votes")
        return out

    def neighbors(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        return search.neighbours(self.found(queries, k), k or self.options.k)

    def distribution(self, answered: DataFrame) -> DataFrame:
        """(qid, class, class_idx, w) as the options normalise and limit it."""
        o = self.options
        rows = vote.normalised(answered, self._known().classes, o.normalisation, o.add_factor)
        return vote.beam(rows, o.beam) if o.beam else rows

    def confidence(self, answered: DataFrame) -> DataFrame:
        """(qid, confidence): the normalised weight of the answer."""
        if self.options.normalisation == "none":
            raise ValueError("confidence needs a normalisation")
        rows = self.distribution(answered)
        return rows.join(answered.select("qid", F.col("predicted").alias("class")), ["qid", "class"]).select("qid", F.col("w").alias("confidence"))

    # -- evaluation --------------------------------------------------------------------------------------------

    def test(self, queries: DataFrame) -> DataFrame:
        """``transform`` with the true class of each query."""
        return self.transform(queries).join(queries.select("qid", "class"), "qid")

    def test_each(self, queries: DataFrame, settings: list[Options]) -> DataFrame:
        """``test`` for several settings, numbered from 0 in ``setting``, from one search with the largest k.

        They may differ from this learner's in k, decay, the rule for exact matches and what is made of votes; whatever
        changes distances needs a search of its own and is an error. With a random seed ties are drawn by setting.
        """
        votes_only = {"k": 1, "decay": "Z", "decay_a": 1.0, "decay_b": 1.0, "exact": "off", "show": (), "normalisation": "none", "add_factor": 1.0, "beam": 0, "max_neighbours": 500}
        if not settings or self.options.algorithm != "IB1" or any(o.but(**votes_only) != self.options.but(**votes_only) for o in settings):
            raise ValueError("settings of one search differ in k, decay, exact matches and votes only")
        same = self.similarity is None
        each = [{"k": o.k, "decay": o.decay, "a": float(o.decay_a), "b": float(o.decay_b), "first": same and o.exact == "reference" and o.k == 1, "only": same and o.exact == "on"} for o in settings]
        most = max(o.k for o in settings)
        near = search.buckets_each(self.found(queries, most), each, most)
        out = vote.answers(near, self._known().classes, *map(F.col, ("k", "decay", "a", "b")), seed=self.options.random_seed)
        return out.select("qid.setting", "qid.qid", *(c for c in out.columns if c != "qid")).join(queries.select("qid", "class"), "qid")

    def evaluate(self, queries: DataFrame) -> DataFrame:
        return evaluate.accuracy(self.test(queries))

    def scores(self, queries: DataFrame) -> DataFrame:
        classes = self._known().classes
        return evaluate.scores(evaluate.confusion(self.test(queries), classes), classes)

    def leave_one_out(self) -> DataFrame:
        """Each training row classified by the others: (qid, predicted, ..., class).

        With ``sloppy`` the weights stay those of the whole table; else each row has those of the table without it.
        """
        o, f = self.options, self._known()
        if "exw" in f.base.columns:
            raise ValueError("rows with weights can't be left out one by one")
        rows = f.instances.withColumn("qid", F.col("iid")).withColumn("occ", S.occurrences(f.instances)).select("qid", *f.features, "class", "occ")
        # Equal rows have equal answers, unless ties are drawn by row, so one of them asks.
        alike = [*f.features, "class", "occ"]
        queries = asked = cut(rows.groupBy(*alike).agg(F.min("qid").alias("qid"))) if o.random_seed is None else rows
        plan = self.plan()
        if not o.sloppy:
            queries, plan = self._strict(queries, plan)
        near = search.buckets(search.distances(queries, f.base, plan, o.k, self.similarity, leave_out=True), o.k, self._shortcut())
        out = vote.answers(near, f.classes, o.k, o.decay, o.decay_a, o.decay_b, seed=o.random_seed, hidden=asked.select("qid", "class", "occ")).join(asked, "qid")
        shown = [c for c in out.columns if c not in (*f.features, "occ")]
        return out.select(*shown) if o.random_seed is not None else rows.join(out.drop("qid"), alike).select(*shown)

    def _strict(self, queries: DataFrame, plan: list[search.Feature]) -> tuple[DataFrame, list[search.Feature]]:
        """Queries with their own weights, ranges and class distributions: of a feature they depend on the row's value and class alone.

        They are taken once for all values and classes, and reach the rows by one join of their values. Which
        metric a feature has is that of the whole table.
        """
        o, f = self.options, self._known()
        numbers = [i for i, m in enumerate(f.metrics, 1) if m in NUMERICAL]
        whole = f.table.where("cnt > 0")
        facts = whole.select("fidx", "fval", "class")
        on = ["fidx", "fval", "class"]
        if o.weighting == "sd" or numbers:
            facts = facts.join(S.ranges_without(whole), ["fidx", "fval"], "left")
        if o.weighting not in ("nw", "user", "sd"):
            without = S.weights_without(whole.where(~F.col("fidx").isin(numbers)) if numbers else whole)
            if numbers:
                without = without.unionByName(S.binned_without(whole.where(F.col("fidx").isin(numbers)), o.bins))
            facts = facts.join(without.select(*on, F.col(o.weighting).alias("w")), on, "left")
        elif o.weighting == "sd":
            facts = facts.withColumn("w", F.col("sd"))
        else:
            given = F.create_map(*(F.lit(x) for i, w in enumerate(self._weights(f.measures, len(f.features)), 1) for x in (i, w)))
            facts = facts.withColumn("w", given[F.col("fidx").cast("int")])
        if any(x.probs is not None for x in plan):
            facts = facts.join(S.probs_without(whole, f.classes), on, "left")
        facts = cut(facts)
        values = F.array(*(F.struct(F.lit(i).cast("long").alias("fidx"), F.col(n).alias("fval")) for i, n in enumerate(f.features, 1)))
        met = queries.select("qid", "class", F.explode(values).alias("x")).select("qid", "class", "x.*").join(facts, on)
        columns, out = [], []
        of = lambda what, i, name: F.first(F.when(F.col("fidx") == i, F.col(what)), ignorenulls=True).alias(name)
        for i, feature in enumerate(plan, 1):
            columns.append(of("w", i, f"w__{feature.name}"))
            feature = replace(feature, own_weight=f"w__{feature.name}")
            if i in numbers:
                columns.append(of("width", i, f"r__{feature.name}"))
                feature = replace(feature, own_width=f"r__{feature.name}")
            if feature.probs is not None:
                columns += [of("p", i, f"{feature.name}__p"), of("freq", i, f"{feature.name}__n")]
            out.append(feature)
        wide = met.groupBy("qid").agg(*columns)
        if o.diversify and o.weighting not in ("nw", "user"):
            own = [f"w__{x.name}" for x in plan]
            least = F.least(*own) if len(own) > 1 else F.col(own[0])
            wide = wide.withColumns({c: F.col(c) - least + S.EPSILON for c in own})
        return queries.join(wide, "qid"), out

    def cross_validate(self, instances: DataFrame, features: list[str], fold: str = "fold") -> DataFrame:
        """Each fold classified by a learner fitted on the others: (fold, qid, class, predicted, ...)."""
        numbers = sorted(r[0] for r in instances.select(fold).distinct().collect())
        if len(numbers) < 2:
            raise ValueError("cross-validation needs folds")
        o = self.options
        simple = all(o.metric_of(i) in ("O", "I") for i in range(1, len(features) + 1)) and o.algorithm == "IB1" and o.weighting != "sd" and "exw" not in instances.columns
        used = [f for i, f in enumerate(features, 1) if o.metric_of(i) != "I"]
        if simple and 0 < len(used) <= search.MOST and not (o.exact == "on" and o.k > 1):
            return self._folds_at_once(instances, used, fold, numbers)
        out = None
        for n in numbers:
            learner = MemoryBasedLearner(self.options).fit(instances.where(F.col(fold) != n), features)
            tested = learner.test(instances.where(F.col(fold) == n).withColumn("qid", F.col("iid"))).withColumn("fold", F.lit(n))
            out = tested if out is None else out.unionByName(tested)
        return out

    def _folds_at_once(self, instances: DataFrame, features: list[str], fold: str, numbers: list) -> DataFrame:
        """Cross-validation of overlap: each fold's statistics and counts are those of the whole table less its own, and one search answers all."""
        o, m = self.options, len(features)
        kind = instances.schema[fold].dataType.simpleString()
        occ = S.occurrences(instances).alias("occ")
        rows = instances.select(F.col(fold).alias("fold"), "iid", *S.symbols(instances, features), F.col("class").cast("string").alias("class"), occ)
        held = rows.where("class IS NOT NULL").groupBy("fold", *features, "class").agg(F.sum("occ").alias("cnt"), F.min("iid").alias("first")).persist()
        weights = {n: self._weights(x, m) for n, x in self._measured_without(held, features, numbers).items()}
        classes = S.classes_without(held.groupBy("fold", "class").agg(F.min("first").alias("first"), F.sum("cnt").alias("n")), numbers)
        by_fold = lambda i: F.element_at(F.create_map(*(F.lit(x) for n in numbers for x in (n, float(weights[n][i])))), F.col("fold").cast(kind))
        queries = rows.withColumn("qid", F.col("iid")).select("qid", "fold", "class", *features, *(by_fold(i).alias(f"w__{f}") for i, f in enumerate(features)))
        plan = [search.Feature(f, own_weight=f"w__{f}") for f in features]
        near = search.buckets(search.folded(queries, held, plan, o.k), o.k, self._shortcut())
        out = vote.answers(near, classes, o.k, o.decay, o.decay_a, o.decay_b, seed=o.random_seed, folds=queries.select("qid", "fold"))
        return out.join(queries.select("qid", "fold", "class"), "qid")

    def _measured_without(self, held: DataFrame, features: list[str], numbers: list) -> dict:
        """By fold, the measures of the features in the other folds."""
        m = len(features)
        values = F.array(*(F.struct(F.lit(i).cast("long").alias("fidx"), F.col(f).alias("fval")) for i, f in enumerate(features, 1)))
        own = held.select("fold", F.explode(values).alias("x"), "class", "cnt").groupBy("fold", "x.fidx", "x.fval", "class").agg(F.sum("cnt").alias("own")).persist()
        every = F.explode(F.array(*(F.struct(F.lit(n).alias("fold"), F.lit(k).cast("long").alias("place")) for k, n in enumerate(numbers))))
        total = own.groupBy("fidx", "fval", "class").agg(F.sum("own").alias("all")).select("*", every.alias("y")).select("fidx", "fval", "class", "all", "y.*")
        without = total.join(own, ["fold", "fidx", "fval", "class"], "left").select((F.col("place") * m + F.col("fidx")).alias("fidx"), "fval", "class", (F.col("all") - F.coalesce("own", F.lit(0))).alias("cnt"))
        out: dict = {n: {} for n in numbers}
        for r in S.weights(without).collect():  # a row for each feature and fold
            out[numbers[(r["fidx"] - 1) // m]][(r["fidx"] - 1) % m + 1] = {k: float(r[k]) for k in ("n_vals", "ig", "si", "gr", "x2", "sv")} | {"sd": 0.0}
        own.unpersist()
        return out

    # -- editing -----------------------------------------------------------------------------------------------

    def partial_fit(self, rows: DataFrame, sign: int = 1) -> MemoryBasedLearner:
        """Add rows, or with sign -1 take them away; all statistics are those of the new table."""
        if self.options.algorithm == "IGTREE":
            raise ValueError("a decision tree can't be edited")
        if self.options.algorithm == "IB2" and sign < 0:
            raise ValueError("rows can't be taken out of an edited base")
        f = self._known()
        out = MemoryBasedLearner(self.options.but(metric=self._metrics()))
        if self.options.algorithm == "IB2" or "exw" in f.base.columns:
            return out.fit(edit.changed(f.instances, rows, f.features, sign), f.features)
        change = cut(versions.delta(rows, f.features, sign))
        own = versions.delta(f.instances, f.features) if f.keys is None else f.keys.select(*f.features, "class", "first", "cnt")
        keys = own.unionByName(change)
        if sign < 0:  # the first key that is left of a pattern isn't known from its sum
            keys = cut(versions.by_key(keys, f.features))
        summed = keys if sign < 0 else f.base.select(*f.features, "class", "cnt", "first").unionByName(change)
        patterns = cut(versions.added(summed, f.features))
        cells = cut(versions.added_cells(f.table.unionByName(versions.cells_of(change, f.features))))
        return out.learn(patterns, cells, f.features, keys)

    def _metrics(self) -> str:
        """The metrics as they are for the features that aren't ignored."""
        f, head = self._known(), self.options.global_metric
        given = [m for i in range(1, self.options.max_features + 1) if (m := self.options.metric_of(i)) != "I"][: len(f.features)]
        return ":".join([head, *(f"{m}{i}" for i, m in enumerate(given, 1) if m != head)])

    def select_features(self, n: int) -> MemoryBasedLearner:
        """A learner fitted anew on the n features that come first in the tree order."""
        f = self._known()
        best = sorted(f.order[:n])
        own = ":".join(f"{f.metrics[i - 1]}{k}" for k, i in enumerate(best, 1) if f.metrics[i - 1] != self.options.global_metric)
        options = self.options.but(metric=":".join(filter(None, (self.options.global_metric, own))))
        if options.weights:
            options = options.but(weights={str(k): self.options.weights[str(i)] for k, i in enumerate(best, 1)})
        return MemoryBasedLearner(options).fit(f.instances, [f.features[i - 1] for i in best])

    # -- tables and files --------------------------------------------------------------------------------------

    def weights(self) -> DataFrame:
        f = self._known()
        rows = [(i, f.features[i - 1], f.metrics[i - 1], f.weights[i - 1], *(m[k] for k in ("n_vals", "ig", "si", "gr", "x2", "sv", "sd"))) for i, m in sorted(f.measures.items())]
        return f.base.sparkSession.createDataFrame(rows, "fidx long, feature string, metric string, weight double, n_vals double, ig double, si double, gr double, x2 double, sv double, sd double")

    def value_probs(self) -> DataFrame:
        return S.value_probs(self._known().table)

    def value_sets(self) -> DataFrame:
        return self._known().table.groupBy("fidx").agg(F.array_sort(F.collect_set("fval")).alias("values"))

    def set_value_probs(self, probs: DataFrame) -> None:
        """Class distributions ``(fidx, fval, class, p)`` that replace those of training; frequencies stay those of training."""
        often = self._known().table.groupBy("fidx", "fval").agg(F.sum("cnt").alias("freq"))
        self.given_probs = probs.select("fidx", "fval", "class", "p").join(often, ["fidx", "fval"])

    def set_value_distances(self, pairs: DataFrame) -> None:
        """Distances ``(fidx, v, w, d)`` that replace computed ones."""
        self.given_pairs = pairs.unionByName(pairs.select("fidx", F.col("w").alias("v"), F.col("v").alias("w"), "d")).distinct()

    def base_info(self) -> DataFrame:
        """(depth, nodes, branching) of the tree of patterns."""
        return tree.sizes(self._known().base, self._ordered()[0])

    def compression(self) -> DataFrame:
        """One row: nodes, patterns, and the percentage of nodes that shared prefixes save."""
        return tree.compression(self._known().base, self._ordered()[0])

    def levels(self) -> DataFrame:
        """(depth, key, class, cnt): the class distribution of each prefix."""
        return tree.levels(self._known().base, self._ordered()[0])

    def next_values(self) -> DataFrame:
        """(depth, key, next_value, cnt): what follows each prefix in the base."""
        return tree.following(self._known().base, self._ordered()[0])

    def examples(self, queries: DataFrame, k: int | None = None, most: int | None = None) -> DataFrame:
        """The patterns at the k nearest distances of each query, ``max_neighbours`` of a distance at most."""
        f = self._known()
        return search.examples(self._asked(queries), f.base, self.plan(), k or self.options.k, most or self.options.max_neighbours, self.similarity, "exw" in f.base.columns)

    def settings(self) -> str:
        """Options, classes, and metrics, weights and statistics of the features, as JSON."""
        f = self._known()
        rows = [{"number": i, "name": n, "metric": m, "weight": w, **f.measures[i]} for i, (n, m, w) in enumerate(zip(f.features, f.metrics, f.weights, strict=True), 1)]
        classes = [r["class"] for r in f.classes.orderBy("class_idx").collect()]
        return json.dumps({"options": asdict(self.options), "classes": classes, "features": rows, "order": f.order})

    def save(self, path: str) -> None:
        f = self._known()
        f.instances.write.mode("overwrite").parquet(f"{path}/instances")
        text = json.dumps({"options": asdict(self.options), "features": f.features})
        f.base.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> MemoryBasedLearner:
        settings = json.loads(spark.read.text(f"{path}/settings").first()[0])
        options = Options(**settings["options"])
        learner = cls(options.but(algorithm="IB1", ib2_seed=0) if options.algorithm == "IB2" else options)
        return learner.fit(spark.read.parquet(f"{path}/instances"), settings["features"])
