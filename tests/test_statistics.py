"""Statistics of a step as JSON, without a map built for each of them."""

from pyspark.sql import functions as F

from pulseframe.sources import xml


def test_statistics_are_told_in_order_and_the_last_of_a_name_stands(spark):
    fields = [f.name for f in xml.STATISTIC]
    one = lambda **given: tuple(given.get(f[1:]) for f in fields)
    rows = [
        ([one(type="HKQuantityTypeIdentifierStepCount", sum="5", unit="count"), one(type="HKQuantityTypeIdentifierHeartRate", unit="a", average="1"), one(type="HKQuantityTypeIdentifierStepCount", maximum="x", average="y"), one(sum="2")],),
        ([one(type="Other")],), ([],), (None,),
    ]
    raw = spark.createDataFrame(rows, xml.T.StructType([xml.many("s", xml.STATISTIC)]))
    got = raw.select(xml.statistics_json(F.col("s")).alias("told"))
    assert [r.told for r in got.collect()] == ['{"":{"sum":"2"},"HeartRate":{"average":"1","unit":"a"},"StepCount":{"average":"y","maximum":"x"}}', '{"Other":{}}', None, None]
    assert "map_concat" not in got._jdf.queryExecution().optimizedPlan().toString()
