"""Point-in-time joins: each spine row gets the newest feature row of its key that is not too late.

Plain form: spine and feature rows are put into one frame, shuffled once by key and sorted
by time; a running ``last`` carries the newest feature row to the spine rows behind it.
Several views with the same keys share that one shuffle.

With ``bucket``, the rows of every key are cut into time buckets of that width (``skew``). Each bucket is seeded with the
newest feature row of the buckets before it, found on a summary with one row per key and bucket, and then runs as a group of its
own: a key with very many rows runs in many tasks, and no key is looked for beforehand.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from featureline.errors import FeaturelineError, SchemaMismatch
from featureline.functions.exprs import exact_time, partition_date, ts_literal
from featureline.operators import skew
from featureline.schema import EVENT_TIMESTAMP, FeatureView, parse_refs


@dataclass(frozen=True)
class _Wanted:
    """What one view contributes to the join."""

    view: FeatureView
    table: DataFrame
    columns: tuple[tuple[str, str], ...]  # (feature, output name)
    ttl: timedelta | None


def historical_features(
    spine: DataFrame,
    refs: str | Sequence[str],
    views: Sequence[FeatureView],
    tables: dict[str, DataFrame],
    *,
    spine_ts: str = EVENT_TIMESTAMP,
    allow_exact: bool = False,
    full_names: bool = False,
    time_range: tuple[datetime | str | int, datetime | str | int] | None = None,
    prune: bool = True,
    bucket: timedelta | None = skew.BUCKET,
) -> DataFrame:
    """Every spine row (duplicates too) with the referenced features as of its time.

    ``allow_exact`` decides whether a feature row of exactly the spine time counts; by
    default it does not. ``time_range`` is the spine's (first, last) time where known; with
    ``prune`` it is read otherwise, so that features outside it are never scanned.
    ``bucket`` is the width of the time buckets that cut every key; None runs each key whole, which saves the summary
    where no key has more rows than a task should sort.
    """
    wanted = _group_refs(refs, views, tables, full_names)
    clash = {name for w in wanted for _, name in w.columns} & set(spine.columns)
    if clash:
        raise FeaturelineError(f"feature names already in the spine: {sorted(clash)}")
    by_keys: dict[tuple[str, ...], list[_Wanted]] = {}
    for w in wanted:
        if w.table.schema[w.view.ts_col].dataType != spine.schema[spine_ts].dataType:
            raise SchemaMismatch(f"times of view {w.view.name} and of the spine differ in type")
        by_keys.setdefault(tuple(w.view.keys), []).append(w)
    incomplete = dict.fromkeys(by_keys, True)
    if time_range is None and prune:
        ts_type = spine.schema[spine_ts].dataType
        facts = spine.agg(exact_time(F.min(spine_ts), ts_type), exact_time(F.max(spine_ts), ts_type),
                          *[F.bool_or(~skew.complete_key(keys)) for keys in by_keys]).first()
        time_range = (facts[0], facts[1]) if facts[0] is not None else None
        incomplete = dict(zip(by_keys, facts[2:]))
    result = spine
    for keys, group in by_keys.items():
        result = _join_group(result, list(keys), group, spine_ts, allow_exact, time_range, bucket,
                             bool(incomplete[keys]))
    order = [name for _, name in _output_names(parse_refs(refs, views), full_names)]
    return result.select(*spine.columns, *order)


def _output_names(parsed, full_names: bool):
    names = [((view, feature), f"{view.name}__{feature}" if full_names else feature) for view, feature in parsed]
    seen = [name for _, name in names]
    repeated = sorted({name for name in seen if seen.count(name) > 1})
    if repeated:
        raise FeaturelineError(f"feature names used twice: {repeated}; use full_names=True or drop repeats")
    return names


def _group_refs(refs, views, tables, full_names: bool) -> list[_Wanted]:
    columns: dict[str, list[tuple[str, str]]] = {}
    by_name = {}
    for (view, feature), name in _output_names(parse_refs(refs, views), full_names):
        by_name[view.name] = view
        columns.setdefault(view.name, []).append((feature, name))
    return [_Wanted(by_name[name], tables[name], tuple(cols), by_name[name].ttl or None)
            for name, cols in columns.items()]


def in_time_range(view: FeatureView, table: DataFrame, time_range: tuple[datetime | str | int, datetime | str | int] | None) -> DataFrame:
    """Feature rows that any spine row of the given time range could match.

    The bounds are constants, so they reach the Parquet reader; with a date-partitioned
    table whole folders are skipped as well.
    """
    ts = F.col(view.ts_col)
    table = table.filter(ts.isNotNull())
    if time_range is None:
        return table
    ts_type = table.schema[view.ts_col].dataType
    first, last = (ts_literal(bound, ts_type) for bound in time_range)
    table = table.filter(ts <= last)
    if view.ttl:
        table = table.filter(ts >= first - F.lit(view.ttl))
    if view.date_column and view.date_column in table.columns:
        day = lambda ts: partition_date(ts, ts_type, view.date_grain)
        table = table.filter(F.col(view.date_column) <= day(last))
        if view.ttl:
            table = table.filter(F.col(view.date_column) >= day(first - F.lit(view.ttl)))
    return table


def _feature_row(w: _Wanted, ts: Column) -> Column:
    """Time, tie-break columns, then the features; compared in that order."""
    fields = [ts.alias("ts")]
    fields += [F.col(c).alias(f"t{i}") for i, c in enumerate(w.view.tiebreak)]
    wanted = [feature for feature, _ in w.columns]
    rest = [] if w.view.tiebreak else [f for f in w.view.features if f not in wanted]
    # Without tie-break columns all features in declared order decide, wanted or not.
    if rest:
        fields += [F.col(f).alias(f"o{i}") for i, f in enumerate(w.view.features)]
    fields += [F.col(feature).alias(f"f{i}") for i, feature in enumerate(wanted)]
    return F.struct(*fields)


def _join_group(spine, keys, group, spine_ts, allow_exact, time_range, bucket, incomplete) -> DataFrame:
    """Spine and feature rows in one frame: keys, ``_ts``, ``_side``, one ``_f<i>`` per view, and the rest of the
    spine as ``_p<i>``. Keys and time are not carried twice."""
    payload = [c for c in spine.columns if c not in keys and c != spine_ts]
    spine_side, feature_side = (1, 0) if allow_exact else (0, 1)
    slots = [f"_f{i}" for i in range(len(group))]

    features = []
    for w in group:
        table = in_time_range(w.view, w.table, time_range).filter(skew.complete_key(keys))
        ts = F.col(w.view.ts_col)
        features.append(table.select(
            *[F.col(key).cast(spine.schema[key].dataType).alias(key) for key in keys],
            ts.alias("_ts"), _feature_row(w, ts).alias("_row"),
        ))

    carried = {f"_p{i}": c for i, c in enumerate(payload)}
    rows = spine.select(*keys, F.col(spine_ts).alias("_ts"), *[F.col(c).alias(p) for p, c in carried.items()])
    if bucket is not None:
        spine_rows, feature_rows = _bucketed(rows, features, keys, spine.schema[spine_ts].dataType, bucket)
        groups = [*keys, "_g"]
    elif incomplete:
        spine_rows = rows.withColumn("_g", skew.null_key_group(keys))
        feature_rows = [f.withColumn("_g", F.lit(0).cast("long")) for f in features]
        groups = [*keys, "_g"]
    else:
        spine_rows, feature_rows, groups = rows, features, keys

    empty_slots = {slot: F.lit(None).cast(f.schema["_row"].dataType) for slot, f in zip(slots, features)}
    empty_payload = {p: F.lit(None).cast(spine.schema[c].dataType) for p, c in carried.items()}
    combined = spine_rows.withColumns({"_side": F.lit(spine_side), **empty_slots})
    for slot, f in zip(slots, feature_rows):
        filled = {**empty_slots, slot: F.col("_row")}
        combined = combined.unionByName(
            f.withColumns({"_side": F.lit(feature_side), **empty_payload, **filled}).drop("_row"))

    window = (Window.partitionBy(*groups).orderBy("_ts", "_side", *slots)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    matched = combined.select(
        *keys, "_ts", "_side", *carried, *[F.last(slot, ignorenulls=True).over(window).alias(slot) for slot in slots],
    ).filter(F.col("_side") == spine_side)

    places = {c: p for p, c in carried.items()} | {spine_ts: "_ts"}
    out = [F.col(places.get(c, c)).alias(c) for c in spine.columns]
    for slot, w in zip(slots, group):
        alive = F.lit(True)
        if w.ttl:
            alive = F.col(f"{slot}.ts") >= F.col("_ts") - F.lit(w.ttl)
        out += [F.when(alive, F.col(f"{slot}.f{i}")).alias(name) for i, (_, name) in enumerate(w.columns)]
    return matched.select(*out)


def _bucketed(rows, features, keys, ts_type, width):
    """Both sides with their time bucket ``_g``, and for each bucket with spine rows the newest feature row before it."""
    number = skew.time_bucket(F.col("_ts"), ts_type, width)
    spine_rows = rows.withColumn("_g", skew.null_key_group(keys, F.coalesce(number, F.lit(-1).cast("long"))))
    used = spine_rows.filter(skew.complete_key(keys) & F.col("_ts").isNotNull()).select(*keys, "_g").distinct()

    # One row per key and bucket, combined before the shuffle, so this window stays small.
    before = Window.partitionBy(*keys).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    feature_rows = []
    for f in features:
        local = f.withColumn("_g", number)
        nothing = F.lit(None).cast(f.schema["_row"].dataType)
        newest = local.groupBy(*keys, "_g").agg(F.max("_row").alias("_row"), F.lit(False).alias("_used"))
        summary = newest.unionByName(used.select("*", nothing.alias("_row"), F.lit(True).alias("_used")))
        seeds = (
            summary.groupBy(*keys, "_g").agg(F.max("_row").alias("_row"), F.bool_or("_used").alias("_used"))
            .select(*keys, "_g", "_used", F.last("_row", ignorenulls=True).over(before).alias("_row"))
            .filter(F.col("_used") & F.col("_row").isNotNull())
            .select(*keys, F.col("_row.ts").alias("_ts"), "_row", "_g")
        )
        feature_rows.append(local.unionByName(seeds))
    return spine_rows, feature_rows
