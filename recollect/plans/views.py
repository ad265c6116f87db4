"""Tables of the driver as learning problems: instances (iid, features, class) and queries (qid, features, class)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class View:
    """A learning problem: columns as SQL expressions of one table, and how test rows are told from training rows."""

    table: str
    iid: str
    features: tuple[str, ...]
    label: str
    test: str

    @property
    def names(self) -> list[str]:
        return [f"f{i}" for i in range(1, len(self.features) + 1)]

    def _columns(self) -> str:
        return ", ".join([f"{self.iid} AS iid", *(f"{e} AS {n}" for e, n in zip(self.features, self.names, strict=True)), f"{self.label} AS class"])

    def sql(self) -> str:
        """Common table expressions ``inst``, ``train`` and ``qry``."""
        names = ", ".join(self.names)
        return f"inst AS (SELECT {self._columns()} FROM {self.table}), train AS (SELECT * FROM inst WHERE NOT ({self.test})), qry AS (SELECT iid AS qid, {names}, class FROM inst WHERE {self.test})"

    def instances(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{self.table}.parquet").selectExpr(*(f"{x}" for x in self._columns_list()))

    def _columns_list(self) -> list[str]:
        return [f"{self.iid} AS iid", *(f"{e} AS {n}" for e, n in zip(self.features, self.names, strict=True)), f"{self.label} AS class"]

    def train(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.instances(spark, sf_dir).where(f"NOT ({self.test})")

    def queries(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.instances(spark, sf_dir).where(self.test).withColumn("qid", F.col("iid"))


PART = View("part", "p_partkey", ("p_brand", "p_type", "CAST(p_size AS STRING)"), "SPLIT_PART(p_name, ' ', 1)", "iid % 5 = 0")
#: As PART, with missing values, and without the type.
GAPS = View("part", "p_partkey", ("CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END", "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_type END", "CAST(p_size AS STRING)"), "SPLIT_PART(p_name, ' ', 1)", "iid % 5 = 0")
BRAND = View("part", "p_partkey", ("p_brand", "CAST(p_size AS STRING)"), "SPLIT_PART(p_name, ' ', 1)", "iid % 5 = 0")
ORDERS = View("orders", "o_orderkey", ("o_orderpriority", "CAST(o_custkey % 7 AS STRING)"), "o_orderstatus", "iid % 50 = 0")
CUSTOMER = View("customer", "c_custkey", ("CAST(c_nationkey AS STRING)", "CAST(CAST(ROUND(c_acctbal) AS BIGINT) AS STRING)"), "c_mktsegment", "iid % 5 = 0")
LINE = View("lineitem", "l_orderkey", ("l_linestatus", "CAST(CAST(ROUND(l_discount * 100) AS INT) AS STRING)", "CAST(CAST(ROUND(l_tax * 100) AS INT) AS STRING)", "CAST(l_linenumber AS STRING)"), "l_returnflag", "iid % 1000 = 0")
QUANTITY = View("lineitem", "l_orderkey", ("CAST(CAST(ROUND(l_quantity) AS INT) AS STRING)", "CAST(CAST(ROUND(l_discount * 100) AS INT) AS STRING)", "CAST(CAST(ROUND(l_tax * 100) AS INT) AS STRING)"), "l_returnflag", "iid % 1000 = 0")
