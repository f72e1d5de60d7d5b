"""Declared entities, feature views, row schemas and feature references."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F, types as T

from featureline.errors import FeaturelineError, SchemaMismatch
from featureline.functions.exprs import non_empty_items

ENTITY_ID = "entity_id"
EVENT_TIMESTAMP = "event_timestamp"

SPINE = T.StructType([
    T.StructField(ENTITY_ID, T.StringType()),
    T.StructField(EVENT_TIMESTAMP, T.TimestampType()),
])

LABELS = T.StructType([
    T.StructField(ENTITY_ID, T.StringType()),
    T.StructField(EVENT_TIMESTAMP, T.TimestampType()),
    T.StructField("churned", T.BooleanType()),
])

PREDICTION = T.StructType([
    T.StructField(ENTITY_ID, T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("model_uri", T.StringType()),
    T.StructField("model_version", T.LongType()),
    T.StructField("predicted_at", T.TimestampType()),
])

CATALOG = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("created_by", T.LongType()),
    T.StructField("updated_by", T.LongType()),
    T.StructField("is_active", T.BooleanType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("feature_view", T.StringType()),
    T.StructField("feature_refs", T.StringType()),
    T.StructField("label_column", T.StringType()),
    T.StructField("experiment", T.StringType()),
    T.StructField("owner", T.StringType()),
    T.StructField("cron_schedule", T.StringType()),
])


@dataclass(frozen=True)
class Entity:
    name: str
    join_keys: tuple[str, ...]
    description: str = ""


@dataclass(frozen=True)
class FeatureView:
    """A time-series table of features.

    ``tiebreak`` orders rows of one key with the same event time (the greatest wins); the
    features themselves, in declared order, decide what is left. ``date_column`` names the
    date the Parquet files are partitioned by, if they are.
    """

    name: str
    entities: tuple[Entity, ...]
    schema: T.StructType
    ttl: timedelta | None = None
    source: str | None = None
    ts_col: str = EVENT_TIMESTAMP
    ts_type: T.DataType = field(default_factory=T.TimestampType)
    key_type: T.DataType = field(default_factory=T.StringType)
    tiebreak: tuple[str, ...] = ()
    tiebreak_type: T.DataType = field(default_factory=T.LongType)
    date_column: str | None = None
    date_grain: str = "day"
    online: bool = True

    @property
    def keys(self) -> list[str]:
        return [key for entity in self.entities for key in entity.join_keys]

    @property
    def features(self) -> list[str]:
        return self.schema.fieldNames()

    @property
    def table_schema(self) -> T.StructType:
        """Keys, event time, features, then tie-break columns that are not features."""
        fields = [T.StructField(key, self.key_type) for key in self.keys]
        fields.append(T.StructField(self.ts_col, self.ts_type))
        fields.extend(self.schema.fields)
        known = {f.name for f in fields}
        fields.extend(T.StructField(c, self.tiebreak_type) for c in self.tiebreak if c not in known)
        return T.StructType(fields)


CUSTOMER = Entity("customer", (ENTITY_ID,), "A customer; joins every customer-level view.")

CUSTOMER_FEATURES = FeatureView(
    name="customer_features",
    entities=(CUSTOMER,),
    ttl=timedelta(days=365),
    schema=T.StructType([
        T.StructField("age", T.LongType()),
        T.StructField("account_balance", T.DoubleType()),
        T.StructField("num_transactions", T.LongType()),
        T.StructField("days_since_last_txn", T.LongType()),
    ]),
)

CUSTOMER_FEATURE_REFS = [f"customer_features:{name}" for name in CUSTOMER_FEATURES.features]


def schema_problems(actual: T.StructType, declared: T.StructType) -> list[str]:
    """Missing and mistyped columns, one line each; extra columns are no problem."""
    types = {f.name: f.dataType for f in actual.fields}
    problems = []
    for wanted in declared.fields:
        if wanted.name not in types:
            problems.append(f"missing column {wanted.name} {wanted.dataType.simpleString()}")
        elif types[wanted.name] != wanted.dataType:
            problems.append(
                f"column {wanted.name} is {types[wanted.name].simpleString()}, "
                f"declared {wanted.dataType.simpleString()}"
            )
    return problems


def conform(df: DataFrame, declared: T.StructType) -> DataFrame:
    """The declared columns in declared order, or SchemaMismatch naming every difference."""
    problems = schema_problems(df.schema, declared)
    if problems:
        raise SchemaMismatch("; ".join(problems))
    return df.select(*declared.fieldNames())


def parse_refs(refs: str | Iterable[str], views: Sequence[FeatureView]) -> list[tuple[FeatureView, str]]:
    """``view:feature`` references, as a list or one comma-separated string, in order."""
    items = refs.split(",") if isinstance(refs, str) else list(refs)
    by_name = {view.name: view for view in views}
    parsed = []
    for item in (text.strip() for text in items):
        if not item:
            continue
        view_name, separator, feature = item.partition(":")
        if not separator or view_name not in by_name:
            raise FeaturelineError(f"unknown feature view in reference {item!r}")
        if feature not in by_name[view_name].features:
            raise FeaturelineError(f"unknown feature in reference {item!r}")
        parsed.append((by_name[view_name], feature))
    if not parsed:
        raise FeaturelineError("no feature references given")
    return parsed


def explode_refs(df: DataFrame, refs_col: str = "feature_refs") -> DataFrame:
    """One row per reference of a table that holds them as comma-separated text."""
    ref = F.col("_ref")
    return (
        df.select(*[c for c in df.columns if c != refs_col],
                  F.posexplode(non_empty_items(F.col(refs_col))).alias("position", "_ref"))
        .withColumn("view", F.split_part(ref, F.lit(":"), F.lit(1)))
        .withColumn("feature", F.split_part(ref, F.lit(":"), F.lit(2)))
        .drop("_ref")
    )


def unknown_refs(refs: DataFrame, views: Sequence[FeatureView]) -> DataFrame:
    """Exploded references whose view or feature is not declared."""
    known: Column = F.lit(False)
    for view in views:
        known = known | ((F.col("view") == view.name) & F.col("feature").isin(view.features))
    return refs.filter(~known)
