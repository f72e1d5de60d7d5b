"""Latest row per key, keyed insert and update, and reports of unmatched rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from featureline.operators.skew import skew_join


def latest_per_key(df: DataFrame, keys: Sequence[str], ts_col: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """The newest row per key. An aggregate, so every task sends at most one row per key."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(ts_col, *tiebreak, *[c for c in rest if c != ts_col and c not in tiebreak])
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_best.`{c}`").alias(c) for c in df.columns])


def first_per_key(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*order_cols, *[c for c in rest if c not in order_cols])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_best.`{c}`").alias(c) for c in df.columns])


def inner_join(features: DataFrame, labels: DataFrame, keys: Sequence[str], salts: int = 1) -> DataFrame:
    """Rows present on both sides."""
    return skew_join(features, labels, keys, "inner", salts)


def suffix_join(left: DataFrame, right: DataFrame, on: Sequence[str], suffixes: tuple[str, str],
                salts: int = 1) -> DataFrame:
    """Inner join that keeps both copies of equally named columns, told apart by suffix."""
    shared = [c for c in left.columns if c in right.columns and c not in on]
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return skew_join(left, right, on, "inner", salts)


def keyed_insert(existing: DataFrame, requests: DataFrame, key: str, order_cols: Sequence[str],
                 salts: int = 1) -> DataFrame:
    """Requests with ``status``: the first request of an unknown key is accepted, all others conflict.

    ``order_cols`` tell requests of one key apart and order them.
    """
    order = F.struct(*order_cols)
    firsts = requests.groupBy(key).agg(F.min(order).alias("_first"))
    firsts = firsts.join(existing.select(key), key, "left_anti")
    judged = skew_join(requests, firsts, [key], "left", salts)
    return judged.withColumn(
        "status", F.when(F.col("_first") == order, F.lit("accepted")).otherwise(F.lit("conflict"))
    ).drop("_first")


def keyed_update(table: DataFrame, updates: DataFrame, key: str, columns: Sequence[str],
                 touched: dict[str, Column] | None = None) -> DataFrame:
    """The table with ``columns`` taken from the update of the same key; null is a value and clears.

    ``updates`` holds at most one row per key. ``touched`` sets further columns of updated rows.
    """
    marked = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = table.join(marked, key, "left")
    hit = F.col("_hit").isNotNull()
    changed = {c: F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}
    changed |= {c: F.when(hit, value).otherwise(F.col(c)) for c, value in (touched or {}).items()}
    return joined.withColumns(changed).select(*table.columns)


def unknown_keys(table: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    return updates.join(table.select(key), key, "left_anti")


def lookup(table: DataFrame, key: str, wanted: str | DataFrame) -> DataFrame:
    """Rows whose key equals a value, or is found in a table of wanted keys."""
    if isinstance(wanted, DataFrame):
        return table.join(wanted.select(key), key, "left_semi")
    return table.filter(F.col(key) == wanted)


def lookup_one(table: DataFrame, key: str, value: str) -> DataFrame:
    """At most one row: the key is unique."""
    return lookup(table, key, value).limit(1)


def unmatched_report(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows of either side, merged rows, and rows without a partner.

    Both sides shrink to one row per key before they meet, so no pairs are formed.
    """
    l = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_l"))
    r = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_r"))
    both = l.join(r, list(keys), "full_outer")
    lc, rc = F.coalesce(F.col("_l"), F.lit(0)), F.coalesce(F.col("_r"), F.lit(0))

    def total(x: Column, name: str) -> Column:
        return F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(name)

    return both.agg(
        total(lc, "n_features"), total(rc, "n_labels"), total(lc * rc, "n_merged"),
        total(F.when(rc == 0, lc).otherwise(0), "n_features_unmatched"),
        total(F.when(lc == 0, rc).otherwise(0), "n_labels_unmatched"),
    )


def unmatched_rows(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    return (skew_join(left, right.select(*keys).distinct(), keys, "left_anti"),
            skew_join(right, left.select(*keys).distinct(), keys, "left_anti"))
