"""R7: contracts of tables before they are taken in."""

from __future__ import annotations

from pyspark.sql import functions as F

from featureline.operators.contracts import (ColumnContract, Contract, VIOLATIONS, column_facts, heavy_values, report,
                                             with_violations)
from featureline.operators.drift import ERROR
from featureline.queries.base import query, table
from featureline.session import work_dir

_GAMMA = (1 + ERROR) / (1 - ERROR)

ORDERS = Contract((
    ColumnContract("o_totalprice", low=10_000.0, high=450_000.0, required=True, max_null_share=0.0,
                   quantiles=((0.5, 200_000.0, 300_000.0), (0.99, 0.0, 400_000.0))),
    ColumnContract("o_orderstatus", listed=("F", "O"), max_share=0.332),
    ColumnContract("o_orderpriority", listed=("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"), max_share=0.25)),
    unique=(("o_custkey", "o_orderdate"), ("o_orderkey",)))
EVENTS = Contract((
    ColumnContract("value", low=0.5, high=200.0, quantiles=((0.5, 10.0, 100.0),)),
    ColumnContract("event_type", listed=("view", "click", "purchase"), max_share=0.5),
    ColumnContract("user_id", max_share=0.008)))


def _facts(spark, sf, name: str, contract: Contract, period=None):
    """Facts written once; what follows reads these."""
    folder = work_dir(spark, "facts")
    column_facts(table(spark, sf, name), contract, period).write.parquet(folder)
    return spark.read.parquet(folder)


@query("r7_quarantine", """
SELECT * FROM (SELECT o_orderkey, concat_ws('; ', CASE WHEN o_totalprice < 10000 OR o_totalprice > 450000 THEN 'o_totalprice: outside' END,
  CASE WHEN o_totalprice IS NULL THEN 'o_totalprice: missing' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'o_orderstatus: not listed' END,
  CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW') THEN 'o_orderpriority: not listed' END,
  CASE WHEN count(*) OVER (PARTITION BY o_custkey, o_orderdate) > 1 AND o_custkey IS NOT NULL AND o_orderdate IS NOT NULL THEN 'o_custkey, o_orderdate: repeated' END,
  CASE WHEN count(*) OVER (PARTITION BY o_orderkey) > 1 AND o_orderkey IS NOT NULL THEN 'o_orderkey: repeated' END) AS why FROM orders) WHERE why <> ''""")
def quarantine(spark, sf):
    """Every order that breaks a row rule, with all its reasons."""
    return with_violations(table(spark, sf, "orders"), ORDERS).where(F.size(VIOLATIONS) > 0).select(
        "o_orderkey", F.concat_ws("; ", VIOLATIONS).alias("why"))


@query("r7_column_facts", " UNION ALL ".join(f"""
SELECT CAST(date_trunc('month', ts) AS TIMESTAMP) AS period, '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS n_null,
  count(*) FILTER ({outside}) AS n_outside, count(*) FILTER ({unlisted}) AS n_unlisted FROM events GROUP BY ALL""" for c, outside, unlisted in [
      ("value", "value < 0.5 OR value > 200", "false"), ("event_type", "false", "event_type NOT IN ('view', 'click', 'purchase')"),
      ("user_id", "false", "false")]))
def facts_per_period(spark, sf):
    """The stored counts per month and column."""
    month = F.date_trunc("month", "ts").cast("timestamp_ntz")
    cells = _facts(spark, sf, "events", EVENTS, month).select("period", "column", F.inline("cells"))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    return cells.groupBy("period", "column").agg(*[of(k).alias(n) for k, n in (
        ("rows", "n_rows"), ("null", "n_null"), ("outside", "n_outside"), ("unlisted", "n_unlisted"))])


_HEAVY = [("events", "user_id", 0.008), ("events", "event_type", 0.2), ("documents", "lang", 0.1), ("documents", "text", 0.001)]


@query("r7_heavy_values", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", md5(CAST({c} AS VARCHAR)) AS value_md5, count(*) AS n, CAST(any_value(k) AS BIGINT) AS n_known
FROM {t}, (SELECT count({c}) AS k FROM {t}) WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > any_value(k) * {s}::DOUBLE""" for t, c, s in _HEAVY))
def heavy(spark, sf):
    """Values that fill more than a share of a table, from slots and then by value; whole texts among them."""
    found = None
    for name, column, share in _HEAVY:
        contract = Contract((ColumnContract(column, max_share=share),))
        one = heavy_values(table(spark, sf, name), _facts(spark, sf, name, contract), column, share).select(
            F.lit(column).alias("column"), F.md5(F.col("value").cast("string").cast("binary")).alias("value_md5"), "n", "n_known")
        found = one if found is None else found.unionByName(one)
    return found


def _line(column: str, rule: str, observed: str, low: str, high: str, holds: str, source: str) -> str:
    return f"""SELECT '{column}' AS "column", '{rule}' AS rule, round(CAST({observed} AS DOUBLE), 9) AS observed, CAST({low} AS DOUBLE) AS low,
  CAST({high} AS DOUBLE) AS high, {holds} AS holds FROM {source}"""


def _quantile(q: float, low: float, high: float) -> str:
    x = f"pow({_GAMMA!r}::DOUBLE, ceil(ln(o_totalprice) / ln({_GAMMA!r}::DOUBLE))) * (2 / ({_GAMMA!r}::DOUBLE + 1))"
    at = f"""(SELECT {x} AS v FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice) AS r, count(*) OVER () AS n FROM orders
  WHERE o_totalprice IS NOT NULL) WHERE r = greatest(CAST(ceil({q}::DOUBLE * n) AS BIGINT), 1))"""
    return _line("o_totalprice", f"quantile {q}", "v", str(low), str(high), f"v * 1.01 >= {low} AND v * 0.99 <= {high}", at)


def _share(column: str, limit: float) -> str:
    top = f"(SELECT CASE WHEN max(c) / sum(c)::DOUBLE > {limit}::DOUBLE THEN max(c) / sum(c)::DOUBLE ELSE 0 END AS v FROM (SELECT count(*) AS c FROM orders WHERE {column} IS NOT NULL GROUP BY {column}))"
    return _line(column, "share of one value", "v", "NULL", str(limit), f"v <= {limit}::DOUBLE", top)


def _count(column: str, rule: str, what: str) -> str:
    return _line(column, rule, "v", "NULL", "0", "v = 0", f"(SELECT count(*) FILTER ({what}) AS v FROM orders)")


@query("r7_contract_report", " UNION ALL ".join([
    _count("o_totalprice", "outside", "o_totalprice < 10000 OR o_totalprice > 450000"), _count("o_totalprice", "missing", "o_totalprice IS NULL"),
    _line("o_totalprice", "null share", "v", "NULL", "0", "v <= 0", "(SELECT 1 - count(o_totalprice) / count(*) AS v FROM orders)"),
    _quantile(0.5, 200000.0, 300000.0), _quantile(0.99, 0.0, 400000.0),
    _count("o_orderstatus", "not listed", "o_orderstatus NOT IN ('F', 'O')"), _share("o_orderstatus", 0.332),
    _count("o_orderpriority", "not listed", "o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')"),
    _share("o_orderpriority", 0.25)]))
def contract_report(spark, sf):
    """All rules of the orders, judged on merged facts of all years."""
    facts = _facts(spark, sf, "orders", ORDERS, F.year("o_orderdate"))
    return report(table(spark, sf, "orders"), facts, ORDERS).withColumn("observed", F.round("observed", 9))
