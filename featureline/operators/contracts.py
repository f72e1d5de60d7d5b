"""Contracts of a table: declared bounds, lists, nullity, uniqueness, quantiles, shares of one value, and numbers of distinct values.

What the table rules need is counted once per period and stored. Each fact is a count of cells: rows, rows without a value, outside
the bounds, not in the list; buckets of a value's size (as in ``drift``); and slots of its hash. Counts add up, so the facts of any range of
periods come from stored ones without reading the data again. Numbers of distinct values are HyperLogLog sketches, which merge as well.

A value that fills more than a share of all rows fills its slot that far too. So only rows of such slots, of which there are at most
1 / share, are counted by value: ``heavy_values`` is exact, and its shuffle doesn't grow with the number of distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from featureline.errors import FeaturelineError
from featureline.operators.drift import ERROR, bucket_of, sketch_quantiles

VIOLATIONS = "_violations"
#: Slots of a value's hash; the cells of a column and period are bounded by these and by the buckets of doubles.
SLOTS = 65_536
#: 2 ** 12 registers: an estimate is off by 1.6 % in one of three cases, by 5 % in one of 500.
REGISTERS_LOG, DISTINCT_ERROR = 12, 0.05


class ContractBroken(FeaturelineError):
    """A rule about the whole table doesn't hold."""


@dataclass(frozen=True)
class ColumnContract:
    """What is promised of a column. Row rules (``low``, ``high``, ``listed``, ``required``) put single rows aside; table rules
    (``max_null_share``, ``quantiles``: share, low and high each; ``max_share`` of one value; ``distinct``: low and high) judge the whole.
    NaN is outside all bounds; null only breaks ``required``."""

    column: str
    low: object = None
    high: object = None
    listed: tuple = ()
    required: bool = False
    max_null_share: float | None = None
    quantiles: tuple[tuple[float, float, float], ...] = ()
    max_share: float | None = None
    distinct: tuple[int, int] | None = None


@dataclass(frozen=True)
class Contract:
    """Columns, and lists of columns whose values together are unique (rows with a null among them are not compared)."""

    columns: tuple[ColumnContract, ...]
    unique: tuple[tuple[str, ...], ...] = field(default=())


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _outside(rule: ColumnContract, dtype: T.DataType) -> Column:
    value, found = _col(rule.column), F.lit(False)
    if rule.low is not None:
        found = found | (value < F.lit(rule.low))
    if rule.high is not None:
        found = found | (value > F.lit(rule.high))
    if isinstance(dtype, (T.DoubleType, T.FloatType)) and not (rule.low is None and rule.high is None):
        found = found | F.isnan(value)
    return F.coalesce(found, F.lit(False))


def _unlisted(rule: ColumnContract) -> Column:
    return F.coalesce(~_col(rule.column).isin(*rule.listed), F.lit(False)) if rule.listed else F.lit(False)


def with_violations(df: DataFrame, contract: Contract) -> DataFrame:
    """Adds ``_violations``: ``column: outside``, ``column: not listed``, ``column: missing`` and ``a, b: repeated``, empty for a good row.

    Every row of a repeated key is marked, since nothing tells which is right. Repeated keys are found by one aggregate of the keys
    and joined back; a key that very many rows have is one row there.
    """
    found = []
    for rule in contract.columns:
        found += [F.when(_outside(rule, df.schema[rule.column].dataType), F.lit(f"{rule.column}: outside")),
                  F.when(_unlisted(rule), F.lit(f"{rule.column}: not listed")),
                  F.when(_col(rule.column).isNull() & F.lit(rule.required), F.lit(f"{rule.column}: missing"))]
    out = df
    for k, key in enumerate(contract.unique):
        names = {c: f"_key{k}_{i}" for i, c in enumerate(key)}
        more = (df.select(*[_col(c).alias(n) for c, n in names.items()]).dropna().groupBy(*names.values())
                .agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n").withColumn(f"_repeated{k}", F.lit(True)))
        out = out.join(more, [_col(c) == F.col(n) for c, n in names.items()], "left").drop(*names.values())
        found.append(F.when(F.col(f"_repeated{k}"), F.lit(", ".join(key) + ": repeated")))
    text = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    return out.withColumn(VIOLATIONS, text).select(*[_col(c) for c in df.columns], VIOLATIONS)


def column_facts(df: DataFrame, contract: Contract, period: Column | None = None) -> DataFrame:
    """One row per period and column: ``cells`` (kind, cell, n) and, where distinct values are bounded, ``distinct_sketch``.

    Values become counted cells before the shuffle, whatever the rows.
    """
    period = F.lit(None).cast("string") if period is None else period
    tall = []
    for rule in contract.columns:
        value, dtype = _col(rule.column), df.schema[rule.column].dataType
        kinds = [("rows", F.lit(0)), ("null", F.when(value.isNull(), 0)), ("outside", F.when(_outside(rule, dtype), 0)),
                 ("unlisted", F.when(_unlisted(rule), 0))]
        if rule.quantiles:
            kinds.append(("bucket", bucket_of(value)))
        if rule.max_share is not None:
            kinds.append(("slot", F.when(value.isNotNull(), slot_of(value))))
        tall += [F.struct(F.lit(rule.column).alias("column"), F.lit(kind).alias("kind"), cell.cast("int").alias("cell")) for kind, cell in kinds]
    counts = (df.select(period.alias("period"), F.inline(F.array(*tall))).where("cell IS NOT NULL")
              .groupBy("period", "column", "kind", "cell").agg(F.count(F.lit(1)).alias("n")))
    facts = counts.groupBy("period", "column").agg(F.array_sort(F.collect_list(F.struct("kind", "cell", "n"))).alias("cells"))
    bounded = [r.column for r in contract.columns if r.distinct]
    if not bounded:
        return facts.withColumn("distinct_sketch", F.lit(None).cast("binary"))
    wide = df.groupBy(period.alias("period")).agg(
        *[F.hll_sketch_agg(_col(c).cast("string"), F.lit(REGISTERS_LOG)).alias(f"_s{i}") for i, c in enumerate(bounded)])
    sketches = wide.select(F.col("period").alias("_period"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("_column"), F.col(f"_s{i}").alias("distinct_sketch")) for i, c in enumerate(bounded)])))
    return facts.join(sketches, F.col("period").eqNullSafe(F.col("_period")) & (F.col("column") == F.col("_column")), "left").drop(
        "_period", "_column")


def slot_of(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(SLOTS)).cast("int")


def merged_cells(facts: DataFrame) -> DataFrame:
    """Counts per column, kind and cell over all given periods."""
    return facts.select("column", F.inline("cells")).groupBy("column", "kind", "cell").agg(F.sum("n").alias("n"))


def heavy_values(df: DataFrame, facts: DataFrame, column: str, share: float) -> DataFrame:
    """Values that fill more than ``share`` of the rows that have one, and their rows: ``value``, ``n``, ``n_known``. Exact; ``facts`` are those of
    ``df``, with ``max_share`` declared for the column."""
    slots = merged_cells(facts.where(F.col("column") == column)).where("kind = 'slot'")
    known = slots.agg(F.sum("n").alias("n_known"))
    # at most 1 / share slots
    full = slots.join(F.broadcast(known)).where(F.col("n") > F.col("n_known") * share).select(F.col("cell").alias("_slot"), "n_known")
    values = df.select(_col(column).alias("value")).where("value IS NOT NULL")
    counted = (values.join(F.broadcast(full), slot_of(F.col("value")) == F.col("_slot"), "left_semi").groupBy("value")
               .agg(F.count(F.lit(1)).alias("n")))
    return counted.join(F.broadcast(known)).where(F.col("n") > F.col("n_known") * share)


def report(df: DataFrame, facts: DataFrame, contract: Contract) -> DataFrame:
    """One row per declared rule: ``column``, ``rule``, ``observed``, ``low``, ``high``, ``holds``. Without rows no rule is broken but a lower bound
    of distinct values.

    Only ``max_share`` reads ``df`` again (rows of overfull slots). A quantile holds if the value known to 1 % may lie within its bounds, a
    number of distinct values if its estimate, give or take 5 %, may.
    """
    cells, lines = merged_cells(facts), []
    count = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    sums = cells.groupBy("column").agg(*[count(k).alias(f"_{k}") for k in ("rows", "null", "outside", "unlisted")])

    def line(rows: DataFrame, rule: ColumnContract, name: str, observed: Column, low, high, error: float = 0.0):
        low_, high_ = F.lit(low).cast("double"), F.lit(high).cast("double")
        slack = F.abs(F.col("observed")) * error
        one = rows.agg(F.coalesce(F.max(observed.cast("double")), F.lit(0.0)).alias("observed"), F.count(F.lit(1)).alias("_seen"))
        lines.append(one.select(
            F.lit(rule.column).alias("column"), F.lit(name).alias("rule"), "observed", low_.alias("low"), high_.alias("high"),
            ((F.coalesce(F.col("observed") + slack >= low_, F.lit(True)) & F.coalesce(F.col("observed") - slack <= high_, F.lit(True)))
             | ((F.col("_seen") == 0) & F.lit(name.startswith("quantile")))).alias("holds")))

    for rule in contract.columns:
        mine = sums.where(F.col("column") == rule.column)
        if rule.low is not None or rule.high is not None:
            line(mine, rule, "outside", F.col("_outside"), None, 0)
        if rule.listed:
            line(mine, rule, "not listed", F.col("_unlisted"), None, 0)
        if rule.required:
            line(mine, rule, "missing", F.col("_null"), None, 0)
        if rule.max_null_share is not None:
            line(mine, rule, "null share", F.col("_null") / F.col("_rows"), None, rule.max_null_share)
        if rule.quantiles:
            sketch = (cells.where((F.col("column") == rule.column) & (F.col("kind") == "bucket")).groupBy(F.col("column").alias("feature"))
                      .agg(F.collect_list(F.struct(F.col("cell").alias("bucket"), "n")).alias("sketch")))
            found = sketch_quantiles(sketch, [q for q, _, _ in rule.quantiles])
            for q, low, high in rule.quantiles:
                line(found.where(F.col("share") == q), rule, f"quantile {q}", F.col("value"), low, high, ERROR)
        if rule.max_share is not None:
            line(heavy_values(df, facts, rule.column, rule.max_share), rule, "share of one value", F.col("n") / F.col("n_known"), None,
                 rule.max_share)
        if rule.distinct:
            merged = facts.where((F.col("column") == rule.column) & F.col("distinct_sketch").isNotNull()).agg(
                F.hll_union_agg("distinct_sketch").alias("s")).where("s IS NOT NULL")
            line(merged, rule, "distinct", F.hll_sketch_estimate("s"), *rule.distinct, error=DISTINCT_ERROR)
    empty = df.sparkSession.createDataFrame([], "column string, rule string, observed double, low double, high double, holds boolean")
    for one in lines:
        empty = empty.unionByName(one)
    return empty


def broken(report_: DataFrame, row_rules: Sequence[str] = ("outside", "not listed", "missing")) -> list[str]:
    """The table rules that don't hold, as text (one for each rule at most); rows that break row rules are put aside instead."""
    return sorted(f"{r['column']}: {r['rule']} is {r['observed']}" for r in report_.where(~F.col("holds")).collect() if r["rule"] not in row_rules)
