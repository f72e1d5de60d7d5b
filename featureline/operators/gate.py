"""The promotion gate: two models on the same validation rows.

The areas under the two ROC curves belong to the same rows, so their difference is judged with their covariance, which follows
from midranks: for every positive row the share of negatives below it, for every negative row the share of positives above it.
Classes are compared by the rows that only one of the models gets right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from featureline.operators.metrics import RANGE_SCORES, running_below
from featureline.session import work_dir

#: One-sided 5 % of the normal distribution, and 5 % of the chi-square distribution with one degree of freedom.
Z_LIMIT, CHI_LIMIT = 1.6449, 3.8415


def _clean(score: str) -> Column:
    score = F.col(f"`{score}`").cast("double") + F.lit(0.0)  # -0.0 and 0.0 are one score
    return F.when(~F.isnan(score), score)


def compare_models(df: DataFrame, truth: str, champion: str, candidate: str, threshold: float = 0.5, z_limit: float = Z_LIMIT,
                   chi_limit: float = CHI_LIMIT, range_scores: int = RANGE_SCORES) -> DataFrame:
    """One row: both areas with variances and covariance, z, the rows that only one model gets right, and ``promote``.

    The candidate is promoted if its area is larger with z of at least ``z_limit`` and it is not worse in classes with a statistic
    above ``chi_limit``. Rows without truth or a score are left out and counted. Rows shrink to one per pair of scores and
    class; ranks are whole numbers (twice the midranks), so that sums are exact whatever the order.
    """
    spark = df.sparkSession
    rows = df.select((F.col(f"`{truth}`").cast("int") == 1).alias("t"), _clean(champion).alias("a"), _clean(candidate).alias("b"))
    known = F.col("t").isNotNull() & F.col("a").isNotNull() & F.col("b").isNotNull()
    folder = work_dir(spark, "gate")
    rows.withColumns({c: F.when(known, F.col(c)) for c in ("a", "b", "t")}).groupBy("t", "a", "b").agg(F.count(F.lit(1)).alias("n")) \
        .write.parquet(folder)
    counted = spark.read.parquet(folder)
    pairs = counted.where("t IS NOT NULL")
    n = {r["t"]: r["n"] for r in pairs.groupBy("t").agg(F.sum("n").alias("n")).collect()}
    positives, negatives = n.get(True, 0), n.get(False, 0)
    ranked = pairs
    for score in ("a", "b"):
        by_score = pairs.groupBy(score).agg(
            F.coalesce(F.sum(F.when(F.col("t"), F.col("n"))), F.lit(0)).alias("pos"),
            F.coalesce(F.sum(F.when(~F.col("t"), F.col("n"))), F.lit(0)).alias("neg"))
        below = running_below(by_score, score, ["pos", "neg"], range_scores)
        # Twice the negatives below a positive row, or twice the positives above a negative one; equal scores count half.
        ranked = ranked.join(below.select(score, (2 * F.col("neg_below") + F.col("neg")).alias(f"low_{score}"),
                                          (2 * (positives - F.col("pos_below")) - F.col("pos")).alias(f"high_{score}")), score)
        ranked = ranked.withColumn(f"x_{score}", F.when(F.col("t"), F.col(f"low_{score}")).otherwise(F.col(f"high_{score}")).cast("decimal(19,0)"))
    right = {s: (F.col(s) > threshold) == F.col("t") for s in ("a", "b")}
    sums = {f"s_{x}{y}": F.sum(F.col("n") * F.col(f"x_{x}") * F.col(f"x_{y}")).cast("double") for x, y in ("aa", "bb", "ab")}
    sums |= {f"s_{x}": F.sum(F.col("n") * F.col(f"x_{x}")).cast("double") for x in "ab"}
    each = ranked.groupBy("t").agg(*[v.alias(k) for k, v in sums.items()],
                                   F.sum(F.when(right["a"] & ~right["b"], F.col("n")).otherwise(0)).alias("only_a"),
                                   F.sum(F.when(right["b"] & ~right["a"], F.col("n")).otherwise(0)).alias("only_b"))
    # Two rows, one per class, put beside each other; of each class the covariances of the mean rank shares.
    def part(sums: str, x: str, y: str, own: int, other: int):
        centred = F.col(f"{sums}.s_{''.join(sorted(x + y))}") - F.col(f"{sums}.s_{x}") * F.col(f"{sums}.s_{y}") / float(max(own, 1))
        return centred / (float(max(own - 1, 1)) * float(max(own, 1)) * 4.0 * float(max(other, 1)) ** 2)

    one = each.agg(*[F.max(F.when(side, F.struct(*sums, "only_a", "only_b"))).alias(name) for name, side in (("p", F.col("t")), ("q", ~F.col("t")))])
    both = positives > 0 and negatives > 0
    enough = positives > 1 and negatives > 1
    area = {x: F.when(F.lit(both), F.col(f"p.s_{x}") / (2.0 * float(max(positives, 1)) * float(max(negatives, 1)))) for x in "ab"}
    covariance = {k: F.when(F.lit(enough), part("p", *k, positives, negatives) + part("q", *k, negatives, positives)) for k in ("aa", "bb", "ab")}
    zero = F.lit(0).cast("long")
    only = {x: sum((F.coalesce(F.col(f"{s}.only_{x}"), zero) for s in "pq"), zero) for x in "ab"}
    unscored = counted.agg(F.coalesce(F.sum(F.when(F.col("t").isNull(), F.col("n"))), zero).alias("n_unscored"))
    out = one.select(
        F.lit(positives).cast("long").alias("n_positive"), F.lit(negatives).cast("long").alias("n_negative"),
        area["a"].alias("champion_auc"), area["b"].alias("candidate_auc"), covariance["aa"].alias("champion_variance"),
        covariance["bb"].alias("candidate_variance"), covariance["ab"].alias("covariance"), only["a"].alias("only_champion_right"),
        only["b"].alias("only_candidate_right"))
    difference = F.col("champion_variance") + F.col("candidate_variance") - 2 * F.col("covariance")
    apart = F.col("only_champion_right") + F.col("only_candidate_right")
    out = out.withColumns({
        # Models that rank alike have a difference without variance, but for rounding.
        "z": F.when(difference > 1e-15, (F.col("candidate_auc") - F.col("champion_auc")) / F.sqrt(difference)),
        "mcnemar": F.when(apart > 0, F.pow(F.greatest(F.abs(F.col("only_champion_right") - F.col("only_candidate_right")) - 1, F.lit(0)), 2) / apart)})
    worse = (F.col("only_champion_right") > F.col("only_candidate_right")) & (F.col("mcnemar") > chi_limit)
    return out.withColumn("promote", F.coalesce(F.col("z") >= z_limit, F.lit(False)) & ~F.coalesce(worse, F.lit(False))).join(F.broadcast(unscored))
