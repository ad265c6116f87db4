"""A base that grows and shrinks without its rows being read again: signed deltas of patterns and cells, by version.

Each change writes two tables into the folder of the base: what it adds to (or takes from) the count of each pattern, by the keys of
its rows, and of each cell of the contingency table. A reader adds the deltas up; all statistics come from the sums. Keys
stay because the first key of what is left, which numbers the classes, can't be known from sums once a first row goes. A version counts
once a file names it, which is written last, so that a change is seen whole or not at all; a change that is made again under its
version (a micro-batch after a failure) changes nothing. ``compact`` writes the sums as a new generation, which
covers the versions before it; it is the only step that reads the base.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import statistics as S


def delta(rows: DataFrame, features: list[str], sign: int = 1) -> DataFrame:
    """(features, class, first, cnt): signed counts of the patterns of ``rows``, by key."""
    known = rows.where("class IS NOT NULL").select("iid", *S.symbols(rows, features), F.col("class").cast("string").alias("class"), S.occurrences(rows).alias("occ"))
    return known.groupBy(*features, "class", F.col("iid").alias("first")).agg((F.sum("occ") * sign).alias("cnt"))


def cells_of(patterns: DataFrame, features: list[str]) -> DataFrame:
    """(fidx, fval, class, cnt) of a table or a delta of patterns."""
    return S.contingency(patterns.withColumnRenamed("cnt", "occ"), features)


def by_key(patterns: DataFrame, features: list[str]) -> DataFrame:
    """The sums of deltas of patterns by key; keys that were taken away go."""
    return patterns.groupBy(*features, "class", "first").agg(F.sum("cnt").alias("cnt")).where("cnt <> 0")


def added(patterns: DataFrame, features: list[str]) -> DataFrame:
    """(features, class, cnt, first): the sums of deltas of patterns, and the first key that is left of each; what falls to zero goes."""
    first = F.min(F.when(F.col("cnt") > 0, F.col("first")))
    return by_key(patterns, features).groupBy(*features, "class").agg(F.sum("cnt").alias("cnt"), first.alias("first")).where("cnt > 0")


def added_cells(cells: DataFrame) -> DataFrame:
    return cells.groupBy("fidx", "fval", "class").agg(F.sum("cnt").alias("cnt")).where("cnt > 0")


class VersionedBase:
    """A base in a folder that all executors share; ``features`` are columns of the rows, of any type."""

    #: The version of what a compaction writes.
    WHOLE = -1

    def __init__(self, spark: SparkSession, path: str, features: list[str]):
        self.spark, self.path, self.features = spark, path, list(features)

    def _folder(self, generation: int, table: str) -> str:
        return f"{self.path}/generation={generation}/{table}"

    def _state(self) -> tuple[int, set[int]]:
        """The last generation that is whole, and the versions that it covers or has."""
        known = self._read(f"{self.path}/generation=*/commits")
        if known is None:
            return 0, set()
        rows = known.select("generation", "version").distinct().collect()  # a row for each change since the last compaction, and the versions that it covers
        last = max((r["generation"] for r in rows if r["generation"] == 0 or r["version"] == self.WHOLE), default=0)
        return last, {r["version"] for r in rows if r["generation"] == last}

    def _read(self, path: str) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def _write(self, patterns: DataFrame, generation: int, version: int) -> None:
        patterns.write.mode("overwrite").parquet(f"{self._folder(generation, 'patterns')}/version={version}")
        own = self.spark.read.schema(patterns.schema).parquet(f"{self._folder(generation, 'patterns')}/version={version}")
        cells_of(own, self.features).write.mode("overwrite").parquet(f"{self._folder(generation, 'cells')}/version={version}")

    def _commit(self, generation: int, versions: list[int]) -> None:
        rows = self.spark.createDataFrame([(generation, v) for v in versions], "generation int, version long")
        rows.coalesce(1).write.mode("append").parquet(self._folder(generation, "commits"))

    def update(self, rows: DataFrame, sign: int = 1, version: int | None = None) -> bool:
        """Add ``rows`` (or with sign -1 take them away) as a version; False if it's there already."""
        return self._update(delta(rows, self.features, sign), version)

    def _update(self, patterns: DataFrame, version: int | None) -> bool:
        generation, versions = self._state()
        version = max(versions, default=self.WHOLE) + 1 if version is None else version
        if version < 0:
            raise ValueError("versions count from 0")
        if version in versions:
            return False
        self._write(patterns, generation, version)
        self._commit(generation, [version])
        return True

    def merge(self, other: VersionedBase, version: int | None = None) -> bool:
        """Add all that another base with the same features has."""
        if other.features != self.features:
            raise ValueError("the bases have different features")
        return self._update(other.keys(), version)

    def _deltas(self, table: str) -> DataFrame:
        generation, versions = self._state()
        if not versions:
            raise ValueError("the base has no rows yet")
        folder = self._folder(generation, table)
        have = [v for v in sorted(versions) if generation == 0 or v == self.WHOLE or v not in self._covered(generation)]
        return self.spark.read.option("basePath", folder).parquet(*(f"{folder}/version={v}" for v in have)).drop("version")

    def _covered(self, generation: int) -> set[int]:
        rows = self.spark.read.parquet(f"{self.path}/generation={generation}/covered").select("version").collect()
        return {r["version"] for r in rows}

    def patterns(self) -> DataFrame:
        """(features, class, cnt, first) as of now."""
        return added(self._deltas("patterns"), self.features)

    def keys(self) -> DataFrame:
        """The patterns as of now, by key."""
        return by_key(self._deltas("patterns"), self.features).join(self.patterns().select(*self.features, "class"), [*self.features, "class"], "left_semi")

    def cells(self) -> DataFrame:
        """(fidx, fval, class, cnt) as of now."""
        return added_cells(self._deltas("cells"))

    def compact(self) -> None:
        """Write the sums as one version of a new generation. A change that is made meanwhile must be made again."""
        generation, versions = self._state()
        if not versions:
            return
        after = generation + 1
        covered = sorted(versions - {self.WHOLE})
        self._write(self.keys(), after, self.WHOLE)
        self.spark.createDataFrame([(v,) for v in covered], "version long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/generation={after}/covered")
        self._commit(after, [*covered, self.WHOLE])

    def writer(self, sign: int = 1) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: a micro-batch is the version of its number."""
        return lambda rows, number: self.update(rows, sign, number) and None
