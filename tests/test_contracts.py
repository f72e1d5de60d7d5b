import random
from collections import Counter

import pytest

from conftest import rows
from featureline.operators.contracts import (ColumnContract, Contract, ContractBroken, VIOLATIONS, broken, column_facts, heavy_values, report,
                                             with_violations)
from featureline.plans.publish import ingest
from pyspark.sql import functions as F

SCHEMA = "day int, id long, `a.b` double, kind string"
CONTRACT = Contract((
    ColumnContract("a.b", low=0.0, high=100.0, quantiles=((0.5, 0.0, 200.0),), max_null_share=0.5),
    ColumnContract("kind", listed=("x", "y"), required=True, max_share=0.9),
    ColumnContract("id", distinct=(1, 100_000))), unique=(("id",),))


def made(spark, n=4_000, seed=1):
    rng = random.Random(seed)
    data = [(k % 7, k, rng.choice([None, rng.random() * 100]), "x" if k % 3 else "y") for k in range(n)]
    return data, spark.createDataFrame(data, SCHEMA).repartition(5)


def test_every_reason_of_a_row(spark):
    data = [(1, 1, 5.0, "x"), (1, 2, -1.0, "z"), (1, 2, float("nan"), None), (1, None, None, "y"), (1, None, 100.0, "x"), (1, 3, 100.5, "x")]
    got = {(r["id"], r["kind"]): r[VIOLATIONS] for r in with_violations(spark.createDataFrame(data, SCHEMA), CONTRACT).collect()}
    assert got == {(1, "x"): [], (2, "z"): ["a.b: outside", "kind: not listed", "id: repeated"],
                   (2, None): ["a.b: outside", "kind: missing", "id: repeated"], (None, "y"): [], (None, "x"): [], (3, "x"): ["a.b: outside"]}


def test_no_rules_and_no_rows(spark):
    _, df = made(spark, 10)
    assert with_violations(df, Contract(())).where(F.size(VIOLATIONS) > 0).count() == 0
    empty = df.limit(0)
    lines = report(empty, column_facts(empty, CONTRACT), CONTRACT)
    assert broken(lines) == ["id: distinct is 0.0"]


def test_merged_facts_are_those_of_all_rows(spark):
    data, df = made(spark)
    apart, whole = column_facts(df, CONTRACT, F.col("day")), column_facts(df, CONTRACT)
    assert apart.count() == 21 and whole.count() == 3
    first, second = report(df, apart, CONTRACT), report(df, whole, CONTRACT)
    assert rows(first) == rows(second)
    seen = {(r["column"], r["rule"]): r["observed"] for r in first.collect()}
    known = sorted(v for _, _, v, _ in data if v is not None)
    assert abs(seen["a.b", "quantile 0.5"] / known[(len(known) + 1) // 2 - 1] - 1) <= 0.01
    assert abs(seen["id", "distinct"] / 4_000 - 1) <= 0.05
    assert seen["a.b", "null share"] == pytest.approx(1 - len(known) / 4_000)


@pytest.mark.parametrize("share", [0.001, 0.02, 0.3])
def test_heavy_values_are_exact(spark, share):
    rng = random.Random(5)
    values = [None] * 300 + ["hot"] * 2_000 + [f"v{int(rng.paretovariate(0.5))}" for _ in range(3_000)]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(6)
    contract = Contract((ColumnContract("v", max_share=share),))
    got = {r["value"]: r["n"] for r in heavy_values(df, column_facts(df, contract), "v", share).collect()}
    counts = Counter(v for v in values if v is not None)
    assert got == {v: n for v, n in counts.items() if n > 5_000 * share}


def test_good_rows_are_taken_in_and_the_rest_put_aside(spark, folder):
    data, df = made(spark, 500)
    bad = spark.createDataFrame([(9, 10_000, 500.0, "x"), (9, 10_001, 1.0, None)], SCHEMA)
    lines = ingest(spark, df.union(bad), CONTRACT, folder, "t", "1", F.col("day"))
    assert {(r["column"], r["rule"]) for r in lines.where(~F.col("holds")).collect()} == {("a.b", "outside"), ("kind", "missing")}
    assert rows(spark.read.parquet(f"{folder}/t/run=1"), "id", "kind") == sorted([(d[1], d[3]) for d in data], key=str)
    aside = spark.read.parquet(f"{folder}/t_quarantine/run=1")
    assert rows(aside, "id", VIOLATIONS) == [(10_000, ["a.b: outside"]), (10_001, ["kind: missing"])]


def test_a_broken_table_rule_takes_nothing_in(spark, folder):
    _, df = made(spark, 200)
    with pytest.raises(ContractBroken, match="kind: share of one value is 1.0"):
        ingest(spark, df.withColumn("kind", F.lit("x")), CONTRACT, folder, "t", "1")
    assert spark.read.parquet(f"{folder}/t_facts/run=1").count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(f"{folder}/t/run=1")


def test_an_empty_delivery(spark, folder):
    _, df = made(spark, 10)
    loose = Contract(CONTRACT.columns[:2], CONTRACT.unique)
    assert ingest(spark, df.limit(0), loose, folder, "t", "1").where(~F.col("holds")).count() == 0
    assert spark.read.parquet(f"{folder}/t/run=1").count() == 0
