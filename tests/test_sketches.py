from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from custodia.operators import sketches
from custodia.session import fresh_path
from tests.conftest import rows


def exact(values, q):
    ordered = sorted(values)
    return ordered[math.ceil(len(ordered) * q) - 1]


def test_quantiles_within_the_stated_error(spark):
    rng = random.Random(1)
    data = [("a", rng.lognormvariate(0, 3)) for _ in range(3000)] + [("b", rng.uniform(-50, 50)) for _ in range(3000)]
    data += [("b", 0.0)] * 40 + [("c", 7.5), ("d", None), ("e", float("nan"))]
    df = spark.createDataFrame([(g, v, i) for i, (g, v) in enumerate(data)], "g string, v double, id int")
    cut = [sketches.sketched(df.where(f"id % 3 = {n}"), ["g"], "v", "id") for n in range(3)]
    whole = sketches.merged(cut[0].unionByName(cut[1]).unionByName(cut[2]), ["g"])
    assert rows(whole, "g", "kind", "item") == rows(sketches.merged(sketches.sketched(df, ["g"], "v", "id"), ["g"]), "g", "kind", "item")
    found = {r["g"]: r for r in sketches.profile(whole, ["g"], (0.01, 0.5, 0.9, 0.99)).collect()}
    for g in "abc":
        values = [v for k, v in data if k == g]
        assert found[g]["n_values"] == len(values)
        for q in (0.01, 0.5, 0.9, 0.99):
            want, got = exact(values, q), found[g][f"q{round(100 * q)}"]
            assert abs(got - want) <= sketches.RELATIVE_ERROR * abs(want) * (1 + 1e-6) + 1e-12
    assert found["d"]["n_values"] is None and found["d"]["n_distinct"] == found["e"]["n_distinct"] == found["c"]["n_distinct"] == 1


def test_distinct_counts(spark):
    df = spark.range(60_000).select(F.lit("x").alias("g"), (F.col("id") % 20_000).alias("u"), F.lit(1.0).alias("v"))
    few = spark.range(900).select(F.lit("y").alias("g"), (F.col("id") % 500).alias("u"), F.lit(1.0).alias("v"))
    sketch = sketches.merged(sketches.sketched(df.unionByName(few), ["g"], "v", "u"), ["g"])
    found = {r["g"]: r["n_distinct"] for r in sketches.profile(sketch, ["g"], (0.5,)).collect()}
    assert found["y"] == 500 and abs(found["x"] - 20_000) < 4 * 20_000 / math.sqrt(sketches.LEAST_HASHES)


def test_days_replace_themselves_and_merge_without_the_rows(spark):
    path = fresh_path(spark, "days")
    df = spark.range(4000).select(
        F.expr("date_add(date'2024-01-01', cast(id % 4 as int))").alias("day"), F.lit("g").alias("g"), (F.col("id") + 1.0).alias("v"), "id"
    )
    for part in (df.where("id < 1000"), df, df.where("id % 4 = 1")):
        sketches.store_days(part, path, "day", ["g"], "v", "id")
    stored = sketches.read_days(spark, path, "day", "2024-01-02", "2024-01-03")
    assert {str(r["day"]) for r in stored.select("day").distinct().collect()} == {"2024-01-02", "2024-01-03"}
    assert "PartitionFilters: [isnotnull(day" in stored._jdf.queryExecution().executedPlan().toString()
    direct = sketches.sketched(df.where("id % 4 in (1, 2)"), ["g"], "v", "id")
    assert rows(sketches.merged(stored, ["g"]), "kind", "item") == rows(sketches.merged(direct, ["g"]), "kind", "item")


def test_nothing(spark):
    none = spark.createDataFrame([], "g string, v double, u string")
    assert sketches.profile(sketches.merged(sketches.sketched(none, ["g"], "v", "u"), ["g"]), ["g"], (0.5,)).collect() == []
