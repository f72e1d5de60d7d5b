"""R2, R3 and R5: the promotion gate, rollbacks and feature drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from featureline.operators.commits import alias_history
from featureline.operators.drift import ERROR, feature_drift, feature_sketches, sketch_quantiles
from featureline.operators.gate import compare_models
from featureline.queries import base as b
from featureline.queries.aggregates import scored_documents
from featureline.queries.base import ntz, query, table
from featureline.session import work_dir

_FEATURES = ["age", "account_balance", "num_transactions", "days_since_last_txn"]
_GAMMA = (1 + ERROR) / (1 - ERROR)
_BUCKETS_SQL = b.CUSTOMER_FEATURES_SQL + ", tall AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, event_timestamp AS ts, CAST({c} AS DOUBLE) AS x FROM customer_features" for c in _FEATURES) + f"""),
buckets AS (SELECT feature, ts, x, CASE WHEN x = 0 THEN 0 ELSE CAST(sign(x) AS INTEGER) * (CAST(ceil(ln(abs(x)) / ln({_GAMMA!r}::DOUBLE)) AS INTEGER) + 100000)
  END AS bucket FROM tall)"""


def _stored(spark, sf):
    """Sketches of the features per quarter, written once; everything below reads these only."""
    folder = work_dir(spark, "sketches")
    quarter = F.date_trunc("quarter", "event_timestamp").cast("timestamp_ntz")
    feature_sketches(b.customer_features(spark, sf), _FEATURES, quarter).write.parquet(folder)
    return spark.read.parquet(folder)


@query("r5_feature_drift", f"""
WITH {_BUCKETS_SQL},
base AS (SELECT feature, bucket, count(*) AS n FROM buckets WHERE ts < TIMESTAMP '1997-01-01' AND bucket IS NOT NULL GROUP BY ALL),
now AS (SELECT feature, date_trunc('quarter', ts) AS period, bucket, count(*) AS n FROM buckets WHERE ts >= TIMESTAMP '1997-01-01' GROUP BY ALL),
periods AS (SELECT feature, period, sum(n) AS n_current, coalesce(sum(n) FILTER (WHERE bucket IS NULL), 0) AS n_missing FROM now GROUP BY ALL),
both_ AS (SELECT feature, period, bucket, sum(now) AS now, sum(base) AS base FROM (
  SELECT feature, period, bucket, n AS now, 0 AS base FROM now WHERE bucket IS NOT NULL
  UNION ALL SELECT feature, period, bucket, 0, n FROM base JOIN periods USING (feature)) GROUP BY ALL),
placed AS (SELECT *, sum(now) OVER r AS now_to, sum(base) OVER r AS base_to, sum(now) OVER g AS n_now, sum(base) OVER g AS n_base FROM both_
  WINDOW r AS (PARTITION BY feature, period ORDER BY bucket), g AS (PARTITION BY feature, period)),
bins AS (SELECT feature, period, least(9, (10 * (base_to - base)) // n_base) AS bin, sum(now) AS now, sum(base) AS base, any_value(n_now) AS n_now,
  any_value(n_base) AS n_base, max(abs(now_to / n_now - base_to / n_base)) AS gap FROM placed GROUP BY ALL),
shares AS (SELECT *, (now + 0.5::DOUBLE) / (n_now + 0.5::DOUBLE * used) AS p, (base + 0.5::DOUBLE) / (n_base + 0.5::DOUBLE * used) AS q
  FROM (SELECT *, count(*) OVER (PARTITION BY feature, period) AS used FROM bins)),
found AS (SELECT feature, period, sum((p - q) * ln(p / q)) AS psi, max(gap) AS distance FROM shares WHERE n_now > 0 AND n_base > 0 GROUP BY ALL)
SELECT feature, CAST(period AS TIMESTAMP) AS period, CAST(n_current AS BIGINT) AS n_current, CAST(n_missing AS BIGINT) AS n_missing, round(psi, 9) AS psi,
  round(distance, 9) AS distance, coalesce(psi > 0.2 OR distance > 0.1, false) AS drifted
FROM periods LEFT JOIN found USING (feature, period)""")
def drift(spark, sf):
    """Each quarter from 1997 on against all the time before, from stored sketches."""
    sketches, start = _stored(spark, sf), ntz("1997-01-01 00:00:00")
    found = feature_drift(sketches.where(F.col("period") < start), sketches.where(F.col("period") >= start))
    return found.withColumns({c: F.round(c, 9) for c in ("psi", "distance")})


_SHARES = [0.0, 0.25, 0.5, 0.9, 1.0]


@query("r5_sketch_quantiles", f"""
WITH {_BUCKETS_SQL},
ranked AS (SELECT feature, bucket, row_number() OVER (PARTITION BY feature ORDER BY x) AS rank, count(*) OVER (PARTITION BY feature) AS n
  FROM buckets WHERE x IS NOT NULL)
SELECT feature, share, round(CASE WHEN bucket = 0 THEN 0 ELSE sign(bucket) * pow({_GAMMA!r}::DOUBLE, abs(bucket) - 100000)
  * (2 / ({_GAMMA!r}::DOUBLE + 1)) END, 6) AS value
FROM ranked JOIN (SELECT unnest({_SHARES}::DOUBLE[]) AS share) ON rank = greatest(CAST(ceil(share * n) AS BIGINT), 1)""")
def quantiles(spark, sf):
    """Quantiles over all quarters, from merged sketches; the SQL takes the bucket of the row that has the rank."""
    return sketch_quantiles(_stored(spark, sf), _SHARES).withColumn("value", F.round("value", 6))


_GATE_SQL = """
n AS (SELECT count(*) FILTER (t) AS p, count(*) FILTER (NOT t) AS q FROM scored),
ranks AS (SELECT t, a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS ra,
  rank() OVER (PARTITION BY t ORDER BY a) + (count(*) OVER (PARTITION BY t, a) - 1) / 2.0::DOUBLE AS rta,
  rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS rb,
  rank() OVER (PARTITION BY t ORDER BY b) + (count(*) OVER (PARTITION BY t, b) - 1) / 2.0::DOUBLE AS rtb FROM scored),
shares AS (SELECT t, CASE WHEN t THEN (ra - rta) / q ELSE 1 - (ra - rta) / p END AS va, CASE WHEN t THEN (rb - rtb) / q ELSE 1 - (rb - rtb) / p END AS vb FROM ranks, n),
parts AS (SELECT t, count(*) AS n, avg(va) AS ma, avg(vb) AS mb, var_samp(va) AS aa, var_samp(vb) AS bb, covar_samp(va, vb) AS ab FROM shares GROUP BY t),
one AS (SELECT max(ma) FILTER (t) AS champion_auc, max(mb) FILTER (t) AS candidate_auc, sum(aa / n) AS va, sum(bb / n) AS vb, sum(ab / n) AS vab FROM parts),
classes AS (SELECT count(*) FILTER ((a > 0.5) = t AND (b > 0.5) <> t) AS only_a, count(*) FILTER ((b > 0.5) = t AND (a > 0.5) <> t) AS only_b FROM scored),
judged AS (SELECT *, (candidate_auc - champion_auc) / sqrt(va + vb - 2 * vab) AS z,
  pow(greatest(abs(only_a - only_b) - 1, 0), 2) / nullif(only_a + only_b, 0) AS mcnemar FROM one, classes)
SELECT p AS n_positive, q AS n_negative, round(champion_auc, 9) AS champion_auc, round(candidate_auc, 9) AS candidate_auc, round(va, 9) AS champion_variance,
  round(vb, 9) AS candidate_variance, round(vab, 9) AS covariance, only_a AS only_champion_right, only_b AS only_candidate_right, round(z, 6) AS z,
  round(mcnemar, 6) AS mcnemar, z >= 1.6449 AND NOT coalesce(only_a > only_b AND mcnemar > 3.8415, false) AS promote, CAST(0 AS BIGINT) AS n_unscored FROM judged, n"""
_ROUNDED = {
    "champion_auc": 9, "candidate_auc": 9, "champion_variance": 9, "candidate_variance": 9, "covariance": 9, "z": 6, "mcnemar": 6}


def _rounded(df):
    return df.withColumns({c: F.round(c, k) for c, k in _ROUNDED.items()})


@query("r2_promotion_gate", f"""
WITH scored AS (SELECT toxic = 1 AS t, ((l.doc_id * 37) % 101) / 100.0::DOUBLE AS a, (((l.doc_id * 53) % 97) + 12 * toxic) / 110.0::DOUBLE AS b
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id), {_GATE_SQL}""")
def gate(spark, sf):
    """A candidate that knows a little more than the champion; many equal scores."""
    better = (F.pmod(F.col("doc_id") * 53, F.lit(97)) + 12 * F.col("toxic")) / 110.0
    return _rounded(compare_models(scored_documents(spark, sf).withColumn("better", better), "toxic", "score", "better"))


@query("r2_gate_many_scores", f"""
WITH scored AS (SELECT o_orderstatus = 'F' AS t, o_totalprice / 600000 AS a, ((o_totalprice * 7) % 1000) / 1000 AS b FROM orders), {_GATE_SQL}""")
def gate_many_scores(spark, sf):
    """Nearly every pair of scores differs: ranks go over score ranges."""
    orders = table(spark, sf, "orders").select(
        (F.col("o_orderstatus") == "F").alias("done"), (F.col("o_totalprice") / 600000).alias("old"),
        (F.pmod(F.col("o_totalprice") * 7, F.lit(1000.0)) / 1000).alias("new"))
    return _rounded(compare_models(orders, "done", "old", "new", range_scores=5_000))


@query("r3_alias_rollback", """
WITH RECURSIVE events_ AS (SELECT user_id AS name, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, event_id AS version,
  CASE event_type WHEN 'error' THEN 'rollback' WHEN 'signup' THEN 'rollback' WHEN 'click' THEN 'restore' ELSE 'set' END AS action FROM events),
walk(name, k, stack, undone) AS (
  SELECT DISTINCT name, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM events_
  UNION ALL
  SELECT w.name, e.k,
    CASE WHEN e.action = 'set' THEN list_append(stack, version) WHEN e.action = 'rollback' AND len(stack) > 1 THEN stack[1:len(stack) - 1]
         WHEN e.action = 'restore' AND len(undone) > 0 THEN list_append(stack, undone[len(undone)]) ELSE stack END,
    CASE WHEN e.action = 'set' THEN CAST([] AS BIGINT[]) WHEN e.action = 'rollback' AND len(stack) > 1 THEN list_append(undone, stack[len(stack)])
         WHEN e.action = 'restore' AND len(undone) > 0 THEN undone[1:len(undone) - 1] ELSE undone END
  FROM walk w JOIN events_ e ON e.name = w.name AND e.k = w.k + 1)
SELECT name, CASE WHEN len(stack) > 0 THEN stack[len(stack)] END AS version, greatest(len(stack) - 1, 0) AS n_below, len(undone) AS n_undone
FROM walk QUALIFY row_number() OVER (PARTITION BY name ORDER BY k DESC) = 1""")
def rollbacks(spark, sf):
    """Each user's events as promotions, rollbacks and restores, folded in their order."""
    kind = F.col("event_type")
    action = F.when(kind.isin("error", "signup"), "rollback").when(kind == "click", "restore").otherwise("set")
    moved = table(spark, sf, "events").select(F.col("user_id").alias("name"), F.struct("ts", "event_id").alias("at"), action.alias("action"),
                                              F.col("event_id").alias("version"))
    return alias_history(moved, ["name"], "at").select(
        "name", "version", F.size("below").cast("long").alias("n_below"), F.size("undone").cast("long").alias("n_undone"))
