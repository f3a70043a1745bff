"""Weight tables that stand in or don't, and checks that stop the job."""

import pytest
from pyspark.sql import functions as F

from ballast.operators import build, checks
from ballast.sources.tables import scratch, table


def test_table_or_on_the_fly(spark, sf):
    features, at = table(spark, sf, "embeddings"), scratch(spark, "weights")
    settings = build.Settings(least=5)
    first, source = build.build_weights(features, at, settings)
    rows = sorted(map(tuple, first.collect()))
    assert source == "computed" and any(r[2] >= 0 for r in rows) and any(r[2] < 0 for r in rows)
    again, source = build.build_weights(features.repartition(7), at, settings)  # other order, same features
    assert source == "table" and sorted(map(tuple, again.collect())) == rows
    said = build.manifest(spark, at)
    assert said["summary"]["outliers"] == sum(r[2] < 0 for r in rows)
    # Other features, other settings, data that aren't what the manifest says, no manifest: computed anew.
    changed = features.withColumn("embedding", F.when(F.col("vec_id") == 3, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding")))
    assert build.build_weights(changed, at, settings)[1] == "computed"
    assert build.build_weights(features, at, settings)[1] == "computed"
    assert build.build_weights(features, at, build.Settings(least=6))[1] == "computed"
    data = build.manifest(spark, at)["data"]
    spark.read.parquet(f"{at}/{data}").limit(9).write.mode("append").parquet(f"{at}/{data}")
    assert build.build_weights(features, at, build.Settings(least=6))[1] == "computed"
    assert build.build_weights(features, at, build.Settings(least=6))[1] == "table"
    assert build.manifest(spark, f"{at}/nowhere") is None


def test_batch_policy(spark, sf):
    features = table(spark, sf, "embeddings")
    for kw in ({"train_batch": 64}, {"extraction_batch": 64}):
        with pytest.raises(ValueError, match="batches of"):
            build.build_weights(features, scratch(spark, "weights"), **kw)
    with pytest.raises(ValueError, match="not known"):
        checks.coupled(8, 8, None)
    with pytest.raises(ValueError, match="no features"):
        build.build_weights(features.limit(0), scratch(spark, "weights"))


def test_planted_faults_stop_the_write(spark):
    df = spark.createDataFrame([(i, i % 3, 1.0) for i in range(50)], "i long, label int, weight double")
    ok = checks.usable_weights(checks.labels_in_range(df, "label", 3))
    assert ok.count() == 50
    for bad, rule in (
        (df.withColumn("label", F.when(F.col("i") == 9, 3).otherwise(F.col("label"))), "outside of 0 to 2"),
        (df.withColumn("label", F.when(F.col("i") == 9, F.lit(None)).otherwise(F.col("label"))), "outside of 0 to 2"),
        (df.withColumn("weight", F.when(F.col("i") == 9, float("nan")).otherwise(1.0)), "not a number"),
        (df.withColumn("weight", F.when(F.col("i") == 9, float("inf")).otherwise(1.0)), "infinite"),
        (df.withColumn("weight", F.when(F.col("i") == 9, -1.0).otherwise(1.0)), "negative"),
    ):
        with pytest.raises(Exception, match=rule):
            checks.usable_weights(checks.labels_in_range(bad, "label", 3)).write.parquet(scratch(spark, "never"))
    with pytest.raises(ValueError, match="positive"):
        checks.labels_in_range(df, "label", 0)
    three = [df.select("i", F.lit(k).alias(f"c{k}")) for k in range(3)]
    assert checks.aligned(*three, "i").count() == 50
    for k, name in enumerate(("features", "labels", "paths")):
        short = [x.filter("i <> 7") if j == k else x for j, x in enumerate(three)]
        with pytest.raises(Exception, match=f"no {name}"):
            checks.aligned(*short, "i").collect()
    with pytest.raises(ValueError, match="too few"):
        checks.written_checked(df, lambda x: x.write.parquet(scratch(spark, "few")), {"n": F.count(F.lit(1))}, {"too few": lambda t: t["n"] > 50})
