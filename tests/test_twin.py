from __future__ import annotations

from pyspark.sql import functions as F

from custodia.operators import twin
from tests.conftest import rows


def test_permutation_is_one(spark):
    df = spark.range(-3000, 3000).select("id", F.col("id").cast("int").alias("i"))
    made = df.select("id", twin.permuted(F.col("id"), 7).alias("p"), twin.permuted(F.col("i"), 7, 32).alias("q"), twin.permuted(F.col("id"), 8).alias("r"))
    found = made.collect()
    for c in "pqr":
        assert len({r[c] for r in found}) == 6000
    assert sum(r["p"] == r["id"] for r in found) == 0 and sum(r["p"] == r["r"] for r in found) == 0
    assert made.schema["q"].dataType.simpleString() == "int" and min(r["q"] for r in found) < 0 < max(r["q"] for r in found)
    ends = spark.createDataFrame([(2**63 - 1,), (-(2**63),), (None,)], "id long")
    assert [r[0] is None for r in ends.select(twin.permuted(F.col("id"), 7)).collect()] == [False, False, True]


def table(spark, n=6000):
    i = F.col("id")
    return spark.range(n).select(
        "id",
        F.when(i % 5 != 0, i % 90).alias("parent"),
        (F.pow(i % 100, F.lit(2)) / 3).alias("price"),
        F.when(i % 4 != 1, (i % 17).cast("int")).alias("age"),
        F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(id % 300 as int))").alias("at"),
        F.when(i % 10 != 0, F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("b"), F.lit("c")), (i % 4 + 1).cast("int"))).alias("kind"),
        F.concat(F.lit("User "), i.cast("string")).alias("name"),
        F.array(i).alias("list"),
    )


def test_shapes_shares_and_joins(spark):
    df = table(spark)
    made = twin.twin(df, ["id"], {"id": "row", "parent": "row"}, "s")
    assert made.schema.simpleString() == df.schema.simpleString()
    assert made.join(made.select(F.col("id").alias("up")), F.col("parent") == F.col("up")).count() == df.join(
        df.select(F.col("id").alias("up")), F.col("parent") == F.col("up")
    ).count()
    for c in ("age", "kind"):
        share = [x.where(F.col(c).isNull()).count() / 6000 for x in (df, made)]
        assert abs(share[0] - share[1]) < 0.03
    assert made.where("parent is null").count() == df.where("parent is null").count()
    kinds = {r["kind"]: r["count"] for r in made.groupBy("kind").count().collect()}
    real = {r["kind"]: r["count"] for r in df.groupBy("kind").count().collect()}
    assert set(kinds) == set(real) and all(abs(kinds[k] - real[k]) < 300 for k in real)
    for c in ("price", "age"):
        a, b = (x.agg(F.percentile(c, F.lit(0.5)), F.percentile(c, F.lit(0.9))).first() for x in (df, made))
        assert all(abs(x - y) <= 0.06 * max(1, abs(x)) + 0.5 for x, y in zip(a, b, strict=True))
    assert {r["name"] for r in made.select(F.left("name", F.lit(5)).alias("name")).distinct().collect()} == {"Xxxx "}
    assert made.where("list is not null").count() == 0


def test_made_again_and_empty(spark):
    df = table(spark, 300)
    made = [rows(twin.twin(x, ["id"], {"id": "row"}, "s"), "id") for x in (df, df.repartition(3))]
    assert made[0] == made[1]
    assert rows(twin.twin(df, ["id"], {"id": "row"}, "other"), "id") != made[0]
    assert twin.twin(df.limit(0), ["id"], {"id": "row"}, "s").collect() == []
