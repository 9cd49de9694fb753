"""The arms of a forecast share what they come from."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import forecast
from tidemark.operators.scan import Series


def test_arms_work_their_input_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    rows = [(i % 2, i, datetime(2024, 3, 1) + timedelta(hours=i), 100.0 + (i * 7) % 13, float(i % 5)) for i in range(120)]
    df = spark.createDataFrame(rows, "k long, id long, ts timestamp, v double, x double").withColumn("x", counted("x"))
    out = forecast.arms(df.withColumn("covered", F.col("id") % 3 != 0), Series(("k",), ("ts", "id")), "v", ["x"], ["x"], "covered", [1, 3])
    assert out.count() == 120 * 8 and out.agg(F.sum("x")).first()[0] == 8 * sum(i % 5 for i in range(120))
    assert seen.value == 120
