"""Registry of catalogued queries, shared derived dimensions, oracle SQL pieces.

Every catalogued query is a callable ``(spark, sf_dir) -> DataFrame`` over the
driver tables (through ``termflow.sources.fixtures``).  Its DuckDB oracle is an
SQL string over the same tables, built from the CTE pieces below that spell
the fixture expressions in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ontology as onto
from ..sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Add a query (and its oracle SQL, when SQL can express it)."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def r6(c) -> Column:
    """Round to 6 decimals (the oracle comparison grain)."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def r6_double(c) -> Column:
    """``r6`` of a column of doubles, the same value for a fraction of the time: away from halves of the last place a whole number
    of millionths, divided, is the double next to the rounded decimal.  Near halves, and for large values, ``r6`` itself."""
    x = F.col(c) if isinstance(c, str) else c
    millionths = x * 1e6
    away = F.abs(millionths - F.floor(millionths) - 0.5) >= 1e-3
    return F.when((F.abs(x) < 1e6) & away, F.floor(millionths + 0.5) / 1e6).otherwise(r6(x))


class Dims:
    """Derived ontology dimensions of one data folder, built once per session:
    the closure and the level tables are loop results, reused by every query
    that needs them (like a materialised dimension table)."""

    _cache: dict[tuple[str, str], "Dims"] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._closure = None
        self._levels: dict[str, tuple[DataFrame, int]] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Dims":
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._cache:
            cls._cache[key] = cls(spark, sf_dir)
        return cls._cache[key]

    @property
    def terms(self) -> DataFrame:
        return fx.terms(self.spark, self.sf_dir)

    @property
    def edges(self) -> DataFrame:
        return fx.edges(self.spark, self.sf_dir)

    def _build(self):
        clo, down, up = onto.closure_and_levels(self.edges, self.terms)
        self._closure = clo
        self._levels = {"down": down, "up": up}

    @property
    def closure(self) -> onto.Closure:
        if self._closure is None:
            self._build()
        return self._closure

    def levels(self, direction: str) -> tuple[DataFrame, int]:
        if direction not in self._levels:
            self._build()
        return self._levels[direction]


# ----------------------------------------------------------- oracle SQL pieces

def key_hash_sql(*keys: str, seed: int = 42) -> str:
    """SQL of ``scalar.key_hash``."""
    p, x = 2147483647, f"CAST({seed} AS BIGINT)"
    for k in keys:
        x = f"(({x} * 48271 + ({k}) % {p}) % {p})"
        x = f"(({x} * {x} + ({k}) % {p}) % {p})"
    return x


def sql(*ctes: str, body: str) -> str:
    """Assemble ``WITH RECURSIVE <ctes> <body>`` (just the body without CTEs)."""
    if not ctes:
        return body
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


EDGE = """edge AS (
  SELECT DISTINCT child, parent FROM (
    SELECT p_partkey AS child, 3 * ((p_partkey // 3) // 2) + p_partkey % 3 AS parent
    FROM part WHERE p_partkey // 3 >= 1
    UNION ALL
    SELECT p_partkey AS child, 3 * ((p_partkey // 3) // 3) + p_partkey % 3 AS parent
    FROM part WHERE p_partkey // 3 >= 1))"""

CLOSURE = """closure(child, ancestor) AS (
  SELECT child, parent FROM edge
  UNION
  SELECT c.child, e.parent FROM closure c JOIN edge e ON c.ancestor = e.child)"""

RCLOSURE = """rclosure AS (
  SELECT child, ancestor FROM closure UNION ALL SELECT p_partkey, p_partkey FROM part)"""

TERMS = """terms AS (
  SELECT p_partkey AS term, p_partkey % 3 AS namespace,
         CASE WHEN p_partkey // 3 = 0 THEN CAST(0 AS DOUBLE) ELSE p_retailprice / CAST(1000 AS DOUBLE) END AS ia
  FROM part)"""

PRED_A = """pred_a AS (
  SELECT l_orderkey AS entry, l_partkey AS term, max(l_discount * 10) AS prob
  FROM lineitem GROUP BY l_orderkey, l_partkey)"""

PRED_B = """pred_b AS (
  SELECT l_orderkey AS entry, l_partkey AS term, max(l_quantity / CAST(50 AS DOUBLE)) AS prob
  FROM lineitem GROUP BY l_orderkey, l_partkey)"""

PRED_RAW = """pred_raw AS (
  SELECT l_orderkey AS entry, l_partkey AS term, abs(l_tax) * 10 AS prob, l_linenumber AS ord FROM lineitem)"""

ANNOT = """annot AS (
  SELECT DISTINCT l_orderkey AS entry, l_partkey AS term, l_partkey % 3 AS aspect
  FROM lineitem WHERE l_returnflag = 'R')"""

NEG = """neg AS (
  SELECT DISTINCT l_orderkey AS entry, l_partkey AS term FROM lineitem
  WHERE l_linestatus = 'O' AND l_linenumber = 1)"""


def snapshot_cte(name: str, window: tuple) -> str:
    start, end = window
    cond = f"l_shipdate < TIMESTAMP '{end} 00:00:00'"
    if start is not None:
        cond += f" AND l_shipdate >= TIMESTAMP '{start} 00:00:00'"
    return f"""{name} AS (
  SELECT l_orderkey AS entry, l_partkey AS term, l_returnflag || l_linestatus AS source
  FROM lineitem WHERE {cond})"""


SNAP_OLD = snapshot_cte("snap_old", fx.OLD_SNAPSHOT)
SNAP_NEW = snapshot_cte("snap_new", fx.NEW_SNAPSHOT)


EVIDENCE = """evidence AS (
  SELECT l_orderkey AS entry, l_partkey AS term, l_partkey % 3 AS aspect,
         l_returnflag || l_linestatus AS code FROM lineitem)"""

TAXONOMY = """taxonomy AS (
  SELECT o_orderkey AS entry, c_nationkey AS taxon FROM orders JOIN customer ON o_custkey = c_custkey)"""

LINKS = """links AS (
  SELECT 'p' || CAST(l_partkey AS VARCHAR) AS protein1, 's' || CAST(l_suppkey AS VARCHAR) AS protein2,
         l_quantity AS score FROM lineitem)"""

IDMAP = """idmap AS (
  SELECT 's' || CAST(s_suppkey AS VARCHAR) AS src, 'n' || CAST(s_nationkey AS VARCHAR) AS dst FROM supplier)"""

HITS = """hits AS (
  SELECT l_orderkey AS query, l_partkey AS target, l_discount AS identity,
         CAST(l_quantity AS INTEGER) AS alnlen, power(10.0, -l_quantity) AS evalue,
         l_extendedprice AS bits FROM lineitem)"""
