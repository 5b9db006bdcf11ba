from pyspark.sql import functions as F

from auger.operators.joins import salted_join


def test_salted_join_equals_plain_join(spark):
    big = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}") for i in range(3000)], "id long, key string")
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3), ("k3", 4), ("none", 5)], "key string, v int")
    plain = sorted(tuple(r) for r in big.join(small, "key").select("id", "key", "v").collect())
    salted_df = salted_join(big, small, "key", ["id"], min_hot_rows=50, max_hot_keys=4)
    assert sorted(tuple(r) for r in salted_df.select("id", "key", "v").collect()) == plain
    # the hot key really is spread: more than one salt bucket carries it
    plan = salted_df._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan
    left = salted_join(big, small, "key", ["id"], how="left", min_hot_rows=50, max_hot_keys=4)
    assert left.count() == big.join(small, "key", "left").count()
    assert left.where(F.col("v").isNull()).count() == big.join(small, "key", "left").where(F.col("v").isNull()).count()
